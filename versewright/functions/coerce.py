"""Integers out of text, three ways, and the first usable of several columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI = "०१२३४५६७८९"


def digits(c: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(c, DEVANAGARI, "0123456789")


def int_or_zero(c: Column) -> Column:
    """Whole numbers only: '12' and ' 12 ' are 12; '1.0', '' and null are 0."""
    return F.coalesce(digits(c.cast("string")).try_cast("int"), F.lit(0))


def canonical_int(c: Column) -> Column:
    """Numbers cut toward zero: '1.7' is 1, '1e2' is 100; nan, infinity and text are 0."""
    return F.coalesce(digits(c.cast("string")).try_cast("double").try_cast("int"), F.lit(0))


#: Columns of a loaded frame: not a number counts as missing, missing as 0.
numeric_fill = canonical_int


def first_usable(*columns: Column) -> Column:
    """The first column that is neither null, empty nor (as a number) zero."""
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0"), c.cast("string")) for c in columns])


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
