"""Command line: python -m versewright parse | paragraphs | clean | split | merge | browse | crawl-text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import jobs
from .operators import browse, paragraphs, split


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="versewright", description=__doc__)
    p.add_argument("--verbose", action="store_true", help="let Spark's own log say more than warnings")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("parse", help="turn raw pages into verses")
    a.add_argument("--input", default="data/raw/rigveda_mandala_*.json", help="a path or glob of JSON arrays of pages")
    a.add_argument("--output", default="data/processed/rigveda_mandalas_1-10.jsonl")
    a.add_argument("--page-helper", help="a JSON object from verse keys to page numbers")
    a.add_argument("--max-suktas", type=int, help="leave out hymns with a larger number")
    a = sub.add_parser("paragraphs", help="turn plain text into a translation map")
    a.add_argument("--input", required=True)
    a.add_argument("--output", default="data/translations/griffith_map_v2")
    a.add_argument("--min-length", type=int, default=paragraphs.MIN_LENGTH)
    a.add_argument("--allow-roman", action="store_true")
    a.add_argument("--dry-run", action="store_true", help="show the first entries and the largest hymns; write nothing")
    a = sub.add_parser("clean", help="choose the best text of each key; doubtful keys go to a review queue")
    a.add_argument("--input", required=True)
    a.add_argument("--prefix", help="start of the outputs' names (the input without its extension)")
    a.add_argument("--min-length", type=int, default=20)
    a = sub.add_parser("split", help="take run-together verses apart")
    a.add_argument("--input", required=True)
    a.add_argument("--output", default="data/translations/griffith_map_clean.csv")
    a.add_argument("--jsonl")
    a.add_argument("--modernize", action="store_true")
    a.add_argument("--min-length", type=int, default=10)
    a.add_argument("--dry-run", action="store_true", help="show the first verses; write nothing")
    a = sub.add_parser("merge", help="put translations into verses")
    for name in ("--dataset", "--translations", "--output"):
        a.add_argument(name, required=True)
    for name in ("--overwrite", "--fuzzy", "--backup"):
        a.add_argument(name, action="store_true")
    a.add_argument("--report")
    a = sub.add_parser("browse", help="filter, search, page and export")
    a.add_argument("--dataset", required=True, nargs="+", help="the first that exists is read")
    for name in ("--mandala", "--sukta", "--verse"):
        a.add_argument(name, type=int)
    for name in ("--deity", "--text", "--export"):
        a.add_argument(name)
    what = a.add_mutually_exclusive_group()
    what.add_argument("--page", type=int, help="one verse by its place among those found, from 0")
    what.add_argument("--random", action="store_true", help="one verse at random")
    what.add_argument("--first", action="store_true", help="the first verse")
    what.add_argument("--options", choices=("mandala", "sukta", "verse_index"), help="the values to choose from under the filters")
    what.add_argument("--counts", action="store_true", help="how many verses each mandala has, and all")
    a.add_argument("--seed", type=int, help="with --random: the same verse every time")
    a.add_argument("--record", help="with --page, --random or --first: a folder for the verse as JSON and CSV")
    a = sub.add_parser("crawl-text", help="turn a table of fetched pages into one text")
    a.add_argument("--pages", required=True, help="Parquet with page_id, html and, for several books, book")
    a.add_argument("--output", required=True)
    a.add_argument("--book", type=int, default=1)
    a.add_argument("--limit", type=int, help="only pages up to this number")
    a.add_argument("--header", default="")
    a.add_argument("--fallback", help="a folder for the text if the output can't be written")
    return p


def _browse(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.counts:
        rows = jobs.load_verses(spark, args.dataset)
        browse.value_counts(rows, "mandala").show(100)
        print(f"verses: {rows.count()}")
    elif args.options:
        browse.options(jobs.load_verses(spark, args.dataset), args.options, mandala=args.mandala, sukta=args.sukta).show(1000)
    else:
        found = jobs.browse_job(spark, args.dataset, args.mandala, args.sukta, args.verse, args.deity, args.text, args.export)
        if args.page is not None or args.random or args.first:
            jobs.one_verse(found, args.page, args.random, args.seed, args.first, args.record).show(vertical=True, truncate=False)
        else:
            found.show(truncate=60)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("versewright").getOrCreate()
    if args.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if args.job == "parse":
        summary = jobs.parse_job(spark, args.input, args.output, args.page_helper, args.max_suktas).first()
        print(f"{summary['total_records']} records; {summary['duplicate_count']} ids met more than once, first: {(summary['duplicates'] or [])[:5]}")
    elif args.job == "paragraphs":
        entries = jobs.paragraphs_job(spark, args.input, None if args.dry_run else args.output, args.min_length, args.allow_roman)
        if args.dry_run:
            paragraphs.preview(entries).show(40, truncate=False)
            paragraphs.entries_per_hymn(entries).show(20)
    elif args.job == "clean":
        jobs.clean_job(spark, args.input, args.prefix or args.input.rpartition(".")[0] or args.input, args.min_length).show(truncate=False)
    elif args.job == "split":
        made = jobs.split_job(spark, args.input, None if args.dry_run else args.output, args.jsonl, args.modernize, args.min_length)
        if args.dry_run:
            split.preview(made).show(truncate=False)
    elif args.job == "merge":
        jobs.merge_job(spark, args.dataset, args.translations, args.output, args.overwrite, args.fuzzy, args.backup, args.report)
    elif args.job == "browse":
        _browse(spark, args)
    else:
        jobs.crawl_text_job(spark, spark.read.parquet(args.pages), args.output, args.book, args.limit, args.header, fallback=args.fallback)


if __name__ == "__main__":
    main()
