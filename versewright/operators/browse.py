"""Filters, search, paging and counts over the merged verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import numeric_fill
from ..schema import KEY, VERSE, ensure_columns


def to_frame(records: DataFrame) -> DataFrame:
    """Records with every column of a verse and whole-number keys."""
    return ensure_columns(records, VERSE).withColumns({k: numeric_fill(F.col(k)) for k in KEY})


def cascade(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the columns that are given a value; None means all."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def matches(c: Column, pattern: str) -> Column:
    """Whether a regex occurs, case ignored; a null text counts as empty."""
    return F.coalesce(c, F.lit("")).rlike("(?iu)" + pattern)


def search(df: DataFrame, deity: str | None = None, text: str | None = None) -> DataFrame:
    if deity:
        df = df.filter(matches(F.col("deity"), deity))
    if text:
        df = df.filter(matches(F.col("sanskrit"), text) | matches(F.col("translation"), text))
    return df


def in_order(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy(*KEY, *more)


def options(df: DataFrame, column: str, **parents) -> DataFrame:
    """Distinct values, sorted, under the parents' selection."""
    return cascade(df, **parents).select(column).distinct().orderBy(column)


def page(df: DataFrame, index: int, *order: str) -> DataFrame:
    """The row at an index in order; an index outside moves to the nearest end."""
    n = df.count()
    at = max(0, min(index, n - 1))
    return df.orderBy(*(order or KEY)).offset(at).limit(1)


def neighbours(df: DataFrame, label: str, order=KEY, by=()) -> DataFrame:
    """The label of the row before and after each, within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.lag(label).over(w), "next": F.lead(label).over(w)})


def random_verse(df: DataFrame, seed: int | None = None, key: str = "id") -> DataFrame:
    """One row at random; by a hash of its key for a seed, so the same one every time."""
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    return df.orderBy(order).limit(1)


def first_verse(df: DataFrame, mandala: int | None = None) -> DataFrame:
    return in_order(cascade(df, mandala=mandala)).limit(1)


def short_label(m: Column, s: Column, v: Column) -> Column:
    return F.format_string("M%d S%d V%d", m, s, v)


def result_table(df: DataFrame) -> DataFrame:
    label = short_label(*[F.col(k) for k in KEY])
    return df.select(label.alias("label"), *KEY, "deity", "translation")


def metadata(df: DataFrame, *columns: str) -> DataFrame:
    """id and a map of the columns that have a value."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select("id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def totals(df: DataFrame, text: str) -> DataFrame:
    """One row: documents, characters, UTF-8 bytes and distinct texts."""
    return df.agg(F.count("*").alias("n_docs"), F.sum(F.char_length(text)).alias("n_chars"), F.sum(F.octet_length(text)).alias("n_bytes"), F.count_distinct(text).alias("n_texts"))


def key_counts(df: DataFrame, key=KEY) -> DataFrame:
    """One row: rows and distinct keys."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("keys"))


def first_value(df: DataFrame, column: str) -> DataFrame:
    """The smallest value of a column."""
    return df.agg(F.min(column).alias(column))
