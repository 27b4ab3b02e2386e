"""Validation of verse records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc, strip
from ..schema import REQUIRED
from .parse import coverage


def missing_required(df: DataFrame, required=REQUIRED, key: str = "id") -> DataFrame:
    """(rule, id) of every null in a required column: one scan, a row for each violation."""
    flags = F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required])
    return df.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("rule"), F.col(key).cast("string").alias("id"))


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    again = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return again.select(F.lit("repeated_id").alias("rule"), F.col(key).cast("string").alias("id"))


def violations(df: DataFrame) -> DataFrame:
    """Required fields, unique ids, positive page numbers, trimmed and normalized text."""
    rule = lambda name, condition: df.filter(condition).select(F.lit(name).alias("rule"), "id")
    found = [missing_required(df), repeated_ids(df), rule("page_number", F.col("page_number") <= 0)]
    found += [rule(f"untrimmed_{c}", F.col(c) != strip(F.col(c))) for c in ("sanskrit", "translation")]
    found += [rule("not_nfc_sanskrit", F.col("sanskrit") != nfc(F.col("sanskrit")))]
    return reduce(DataFrame.unionByName, found)


def poor_coverage(verses: DataFrame, least: float = 50.0) -> DataFrame:
    """Mandalas where less than ``least`` percent of the verses have a deity."""
    return coverage(verses).filter(F.col("deity_pct") < least)
