"""What the crawl did, over a table of pages instead of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import framed, html_text, html_title, text_lines


def grid(spark: SparkSession, books: dict[int, str], last: int = 190) -> DataFrame:
    """(book, n, url) for n = 1 .. last of each book's prefix."""
    prefixes = spark.createDataFrame(sorted(books.items()), "book int, prefix string")
    pages = prefixes.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(last))))
    return pages.select("book", "n", F.format_string("%s%03d.htm", "prefix", "n").alias("url"))


def ends(status: DataFrame, sure: int = 10, ahead: int = 5, enough: int = 4) -> DataFrame:
    """(book, stop_at): the first missing page past ``sure`` with at least ``enough`` missing
    among the next ``ahead``.  status: (book, n, status) without gaps up to ahead past the
    last page."""
    w = Window.partitionBy("book").orderBy("n").rowsBetween(1, ahead)
    rows = status.withColumn("__ahead__", F.sum((F.col("status") != 200).cast("int")).over(w))
    over = rows.filter((F.col("status") == 404) & (F.col("n") > sure) & (F.col("__ahead__") >= enough))
    return over.groupBy("book").agg(F.min("n").alias("stop_at"))


def fetched(status: DataFrame, stops: DataFrame) -> DataFrame:
    """The pages that a crawl reads: status 200, before its book's end."""
    rows = status.join(stops.withColumnRenamed("book", "__book__"), F.col("book") == F.col("__book__"), "left")
    return rows.filter((F.col("status") == 200) & (F.col("stop_at").isNull() | (F.col("n") < F.col("stop_at")))).drop("__book__", "stop_at")


def page_texts(pages: DataFrame, number: str = "page_id", html: str = "html", stripped: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``pages[keep]`` with (number, title, body, framed) of each page."""
    title = html_title(F.col(html), F.format_string("Hymn %d", F.col(number)))
    rows = pages.select(*keep, number, title.alias("title"), F.array_join(text_lines(html_text(F.col(html)), 2, stripped), "\n").alias("body"))
    return rows.withColumn("framed", framed(F.col(number), F.col("title"), F.col("body")))


def sizes(pages: DataFrame, by: str, text: str) -> DataFrame:
    """Pages, characters and UTF-8 bytes by group."""
    return pages.groupBy(by).agg(F.count("*").alias("pages"), F.sum(F.char_length(text)).alias("characters"), F.sum(F.octet_length(text)).alias("bytes"))
