"""Plain text of a translation to numbered verses.

Headings and numbers carry forward over a document's paragraphs; running windows, all
of them within a document, take the place of a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import book_heading, hymn_heading, is_junk_paragraph, newlines, normalize_line, strip, verse_mark

MIN_LENGTH = 10


def paragraphs_of(text: Column) -> Column:
    """Runs of lines that aren't blank, stripped and joined by a space."""
    stripped = F.array_join(F.transform(F.split(newlines(F.coalesce(text, F.lit(""))), "\n"), strip), "\n")
    pieces = F.filter(F.split(stripped, "\n{2,}"), lambda x: F.replace(x, F.lit("\n"), F.lit("")) != "")
    return F.transform(pieces, lambda x: F.replace(F.btrim(x, F.lit("\n")), F.lit("\n"), F.lit(" ")))


def split_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, para) in order of position."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col(text))).alias("pos", "para"))


def classify(paragraphs: DataFrame, min_length: int = MIN_LENGTH, allow_roman: bool = False) -> DataFrame:
    """(doc_id, pos, kind, number, text) of the paragraphs that aren't junk.

    kind: B book heading, H hymn heading, E verse with a number, I verse without.  text
    is what a verse would emit, null if it is shorter than min_length.
    """
    rows = paragraphs.withColumn("line", normalize_line(F.col("para"))).filter(~is_junk_paragraph(F.col("line")))
    number, rest = verse_mark(strip(F.col("para")), allow_roman)
    rows = rows.select("doc_id", "pos", "line", strip(F.col("para")).alias("para"), book_heading(F.col("line")).alias("b"), hymn_heading(F.col("line")).alias("h"), number.alias("e"), rest.alias("rest"))
    kind = F.when(F.col("b").isNotNull(), "B").when(F.col("h").isNotNull(), "H").when(F.col("e").isNotNull(), "E").otherwise("I")
    long = lambda c: F.when(F.char_length(c) >= min_length, c)
    explicit = F.coalesce(F.when(F.col("rest") != "", long(F.col("rest"))), long(F.col("para")))
    text = F.when(kind == "E", explicit).when(kind == "I", long(F.col("line")))
    return rows.select("doc_id", "pos", kind.alias("kind"), F.coalesce("b", "h", "e").alias("number"), text.alias("text"))


def carry_forward(events: DataFrame) -> DataFrame:
    """(doc_id, pos, mandala, sukta, verse_index, translation_text) of the verses in events
    (doc_id, pos, kind, number, text).

    A book heading sets the book and clears the hymn, a hymn heading sets the hymn; both
    clear the counter, an explicit number sets it, and a verse without one adds 1 even if
    its own text is left out.
    """
    up_to_here = lambda *by: Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda kinds: F.col("kind").isin(*kinds).cast("int")
    whole = up_to_here("doc_id")
    rows = events.withColumns({
        "mandala": F.coalesce(F.last(F.when(F.col("kind") == "B", F.col("number")), ignorenulls=True).over(whole), F.lit(0)),
        "__book__": F.sum(is_("B")).over(whole),
        "__run__": F.sum(is_("BHE")).over(whole),
    })
    rows = rows.withColumn("sukta", F.coalesce(F.last(F.when(F.col("kind") == "H", F.col("number")), ignorenulls=True).over(up_to_here("doc_id", "__book__")), F.lit(0)))
    run = up_to_here("doc_id", "__run__")
    base = F.coalesce(F.first(F.when(F.col("kind") == "E", F.col("number")), ignorenulls=True).over(run), F.lit(0))
    rows = rows.withColumn("verse_index", (base + F.sum(is_("I")).over(run)).cast("int"))
    verses = rows.filter(F.col("kind").isin("E", "I") & F.col("text").isNotNull())
    return verses.select("doc_id", "pos", F.col("mandala").cast("int").alias("mandala"), F.col("sukta").cast("int").alias("sukta"), "verse_index", F.col("text").alias("translation_text"))


def parse_text(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, allow_roman: bool = False) -> DataFrame:
    return carry_forward(classify(split_paragraphs(docs, text), min_length, allow_roman))


def entries_per_hymn(entries: DataFrame, top: int | None = 20) -> DataFrame:
    """Entries of each (mandala, sukta), the most first."""
    counted = entries.groupBy("mandala", "sukta").agg(F.count("*").alias("entries"))
    ordered = counted.orderBy(F.desc("entries"), "mandala", "sukta")
    return ordered.limit(top) if top else ordered


def preview(entries: DataFrame, n: int = 40, width: int = 160) -> DataFrame:
    """The first n entries by position, cut to width characters."""
    return entries.orderBy("doc_id", "pos").limit(n).withColumn("translation_text", F.substring("translation_text", 1, width))


