"""The stages as jobs: files in, files out.  Outputs are Spark folders.

What several outputs share is kept on the executors' disks meanwhile; if an executor is
lost, its part is computed again.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.coerce import numeric_fill
from .functions.text import book_banner
from .operators import browse, clean, crawl, merge, paragraphs, parse, split
from .schema import KEY, VERSE, ensure_columns, one_row
from .sources import readers, sinks


@contextmanager
def _kept(df: DataFrame):
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


def parse_job(spark: SparkSession, pages: str, output: str, page_helper: str | None = None, max_suktas: int | None = None) -> DataFrame:
    """Files of raw pages to verses (JSON lines), <output>_summary and <output>_duplicates
    (id, n).  Returns the summary."""
    numbers = readers.page_numbers(spark, page_helper) if page_helper else None
    with _kept(parse.explode_pages(readers.raw_pages(spark, pages), max_suktas)) as stanzas:
        sinks.json_lines(parse.unique_verses(stanzas, numbers), output)
        verses = spark.read.schema(VERSE).json(output)
        summary = parse.parse_summary(verses, stanzas).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.lit(pages).alias("input_pattern"), "*")
        sinks.summary_json(summary, f"{output}_summary")
        sinks.json_lines(parse.duplicate_ids(stanzas), f"{output}_duplicates")
    return spark.read.json(f"{output}_summary")


def paragraphs_job(spark: SparkSession, text: str, output: str | None, min_length: int = paragraphs.MIN_LENGTH, allow_roman: bool = False) -> DataFrame:
    """Plain text of a translation to <output>/csv and <output>/jsonl; without an output
    only the frame comes back, for a preview."""
    docs = readers.text_lines(spark, text).withColumn("doc_id", F.xxhash64("source_file"))
    entries = paragraphs.parse_text(docs, min_length=min_length, allow_roman=allow_roman)
    if output:
        with _kept(entries.select(*KEY, "translation_text", "doc_id", "pos").orderBy("doc_id", "pos").drop("doc_id", "pos")) as rows:
            sinks.csv(rows, f"{output}/csv")
            sinks.json_lines(rows, f"{output}/jsonl")
    return entries


def clean_job(spark: SparkSession, source: str, prefix: str, min_length: int = clean.MIN_LENGTH) -> DataFrame:
    """<prefix>_clean, <prefix>_review and <prefix>_stats of a translation map.  Returns the stats."""
    with _kept(clean.judge(clean.prepare(readers.translations_frame(spark, source)), min_length)) as judged:
        cleaned, review = clean.clean(judged, min_length, judged=True)
        sinks.cleaned_csv(cleaned, f"{prefix}_clean")
        sinks.review_csv(review, f"{prefix}_review")
        sinks.summary_json(clean.clean_stats(judged, min_length, judged=True), f"{prefix}_stats")
    return spark.read.json(f"{prefix}_stats")


def split_job(spark: SparkSession, source: str, output: str | None, jsonl: str | None = None, modernize: bool = False, min_length: int = 10, min_text: int = split.MIN_TEXT) -> DataFrame:
    """Run-together verses apart, and <output>_stats with the share of texts over min_length;
    without an output only the frame comes back, for a preview."""
    made = split.split_verses(readers.translations_frame(spark, source), modernize, min_text).select(*KEY, "translation_text")
    if output:
        with _kept(made) as rows:
            sinks.csv(rows, output, KEY)
            if jsonl:
                sinks.json_lines(rows.orderBy(*KEY), jsonl)
            stats = one_row(rows.agg(F.count("*").alias("total_rows")), split.long_share(rows, min_length))
            sinks.summary_json(stats.withColumn("modernized", F.lit(modernize)), f"{output}_stats")
    return made


def merge_job(spark: SparkSession, dataset: str, translations: str, output: str, overwrite: bool = False, fuzzy: bool = False, backup: bool = False, report: str | None = None) -> DataFrame:
    """Translations into verses: <output>, <output>_merge_summary, and with ``report`` that and
    <report>_unmatched.  Returns the summary."""
    saved = sinks.next_backup(spark, dataset) if backup else None
    verses = readers.json_lines(spark, dataset, VERSE, strict=True)
    verses = verses.withColumns({k: numeric_fill(F.col(k)) for k in KEY})
    table = readers.translations(spark, translations)
    with _kept(merge.merge(verses, table, overwrite, fuzzy)) as merged:
        sinks.json_lines(merged.orderBy("row_idx").select(*[f.name for f in VERSE]), output)
        sinks.summary_json(merge.merge_report(merged, table, fuzzy, verses, dataset, translations, output, saved), f"{output}_merge_summary")
        if report:
            sinks.csv(merge.delta_report(merged), report, ("dataset_index",))
            lost = merge.residual_unmatched(merged, table, fuzzy, verses)
            sinks.csv(lost.select(*KEY, F.substring("translation_text", 1, 200).alias("translation_snip"), "position").orderBy("position").drop("position"), f"{report}_unmatched")
    return spark.read.json(f"{output}_merge_summary")


def load_verses(spark: SparkSession, datasets: list[str]) -> DataFrame:
    """The verses of the first dataset that exists, as browsing needs them."""
    return browse.to_frame(ensure_columns(readers.json_lines(spark, readers.first_existing(spark, *datasets)), VERSE))


def browse_job(spark: SparkSession, datasets: list[str], mandala=None, sukta=None, verse=None, deity=None, text=None, export: str | None = None) -> DataFrame:
    """The verses that filters and searches leave, in order, of the first dataset that exists."""
    rows = load_verses(spark, datasets)
    found = browse.in_order(browse.search(browse.cascade(rows, mandala=mandala, sukta=sukta, verse_index=verse), deity, text))
    if export:
        verses = found.select(*[f.name for f in VERSE])
        sinks.json_lines(verses, f"{export}/jsonl")
        sinks.csv(sinks.flat_lists(verses), f"{export}/csv")
    return found


def one_verse(found: DataFrame, page: int | None = None, at_random: bool = False, seed: int | None = None, first: bool = False, record: str | None = None) -> DataFrame:
    """A single verse of those found: at a place in order, at random, or the first of the
    first mandala; with ``record`` it is written there."""
    if at_random:
        verse = browse.random_verse(found, seed)
    elif first:
        verse = browse.first_verse(found)
    else:
        verse = browse.page(found, page or 0)
    verse = verse.select(*[f.name for f in VERSE])
    if record:
        with _kept(verse) as chosen:
            sinks.one_record(chosen, record)
    return verse


def crawl_text_job(spark: SparkSession, pages: DataFrame, output: str, book: int = 1, limit: int | None = None, header: str = "", one_file: bool = True, fallback: str | None = None) -> DataFrame:
    """Pages (page_id, html, and book where there are several) as one text: the header, then
    of each book a banner and its pages.  limit: the first pages of each book only;
    fallback: the folder written where ``output`` can't be."""
    rows = pages if "book" in pages.columns else pages.withColumn("book", F.lit(book))
    rows = rows if limit is None else rows.filter(F.col("page_id") <= limit)
    rows = rows.select(F.col("book").cast("int").alias("book"), F.col("page_id").cast("bigint").alias("page_id"), "html")
    texts = crawl.page_texts(rows, keep=("book",))
    framed = texts.select("book", "page_id", F.concat("framed", F.lit("\n")).alias("framed"))
    banners = rows.select("book").distinct().select("book", F.lit(-1).cast("bigint").alias("page_id"), book_banner(F.col("book")).alias("framed"))
    made = framed.unionByName(banners)
    if header:
        made = made.unionByName(spark.range(1).select(F.lit(-1).alias("book"), F.lit(-2).cast("bigint").alias("page_id"), F.lit(header).alias("framed")))
    sinks.text_file(made, output, "framed", ("book", "page_id"), one_file, fallback)
    return texts
