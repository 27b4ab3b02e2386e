"""Verses that were run together, apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import canonical_int, digits
from ..functions.text import SPACE, correct, strip
from .parse import keep_first

MIN_TEXT = 10
FIRST = rf"(?s)^.*?(\p{{Nd}}+){SPACE}+(.*)$"
NEXT = rf"{SPACE}+(\p{{Nd}}+){SPACE}+"


def numbered_parts(text: Column) -> Column:
    """array<struct<num, text>>: 'number text' up to the next number between spaces.
    Text before the first number is left out.

    What follows the first number is split at the others, which is linear; a lazy match
    with a look-ahead would try it at every character."""
    rest = F.regexp_extract(text, FIRST, 2)
    numbers = F.concat(F.array(F.regexp_extract(text, FIRST, 1)), F.regexp_extract_all(rest, F.lit(NEXT), 1))
    made = F.zip_with(numbers, F.split(rest, NEXT), lambda n, t: F.struct(digits(n).try_cast("int").alias("num"), strip(t).alias("text")))
    return F.when(text.rlike(rf"\p{{Nd}}{SPACE}"), made)


def split_verses(rows: DataFrame, modernize: bool = True, min_text: int = MIN_TEXT, whole_words: bool = False) -> DataFrame:
    """(mandala, sukta, verse_index, translation_text): parts of more than min_text
    characters, corrected, the first of each key by (row_idx, position)."""
    parts = rows.select(canonical_int(F.col("mandala")).alias("mandala"), canonical_int(F.col("sukta")).alias("sukta"), "row_idx", F.posexplode(numbered_parts(F.col("translation_text"))).alias("part", "p"))
    kept = parts.filter(F.char_length("p.text") > min_text)
    made = kept.select("mandala", "sukta", F.col("p.num").alias("verse_index"), correct(F.col("p.text"), modernize, whole_words).alias("translation_text"), "row_idx", "part")
    return keep_first(made, ["mandala", "sukta", "verse_index"], [F.col("row_idx"), F.col("part")]).drop("row_idx", "part")


def preview(made: DataFrame, n: int = 5, width: int = 160) -> DataFrame:
    """The first n of the split verses in order, cut to width characters."""
    return made.orderBy("mandala", "sukta", "verse_index").limit(n).withColumn("translation_text", F.substring("translation_text", 1, width))


def long_share(rows: DataFrame, min_length: int = 20) -> DataFrame:
    """One row: percentage of texts longer than min_length."""
    return rows.agg((F.avg((F.char_length("translation_text") > min_length).cast("int")) * 100).alias("coverage_pct"))
