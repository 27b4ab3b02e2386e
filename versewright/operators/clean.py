"""Cleaning of translations: junk out, the best text of each key, doubtful keys to review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import canonical_int
from ..functions.text import clean_text, is_junk, signs, text_score
from ..schema import KEY

MIN_LENGTH = 20
LOW_SCORE, SMALL_GAP = 10.0, 5.0


def prepare(rows: DataFrame) -> DataFrame:
    """Cleaned text and whole-number keys of (mandala, sukta, verse_index, translation_text, row_idx)."""
    return rows.select(*[canonical_int(F.col(k)).alias(k) for k in KEY], clean_text(F.col("translation_text")).alias("translation_text"), "row_idx")


def fate(min_length: int = MIN_LENGTH, seen: dict | None = None):
    """Why a prepared row is dropped: key, junk or short; else 'candidate'."""
    text = F.col("translation_text")
    short = F.char_length(text) < min_length
    return F.when((F.col("mandala") <= 0) | (F.col("sukta") <= 0), "key").when(is_junk(text, seen), "junk").when(short, "short").otherwise("candidate")


def judge(prepared: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Prepared rows with ``score``: null for those that are dropped.  What junk and score
    both ask of a text is found once."""
    asked = signs(F.col("translation_text"))
    rows = prepared.withColumns({f"__{k}__": c for k, c in asked.items()})
    seen = {k: F.col(f"__{k}__") for k in asked}
    score = F.when(fate(min_length, seen) == "candidate", text_score(F.col("translation_text"), seen))
    return rows.withColumn("score", score).select(*prepared.columns, "score")


def candidates(prepared: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows worth keeping, with their score."""
    return judge(prepared, min_length).filter(F.col("score").isNotNull())


def ranked(scored: DataFrame, key=KEY) -> DataFrame:
    """rank (1 is best, the earliest of equal ones), size, best and second score of the key."""
    by = Window.partitionBy(*key)
    order = by.orderBy(F.desc("score"), "row_idx")
    rows = scored.withColumn("rank", F.row_number().over(order)).withColumn("__next__", F.lead("score").over(order))
    first = F.col("rank") == 1
    return rows.withColumns({"size": F.count("*").over(by), "best": F.max("score").over(by), "second": F.max(F.when(first, F.col("__next__"))).over(by)}).drop("__next__")


def ambiguous(low: float = LOW_SCORE, gap: float = SMALL_GAP):
    """Keys of several rows whose best is poor or hardly better than the second."""
    return (F.col("size") > 1) & ((F.col("best") < low) | (F.col("best") - F.col("second") < gap))


def best_per_key(scored: DataFrame, key=KEY) -> DataFrame:
    return ranked(scored, key).filter("rank = 1").drop("rank", "size", "best", "second")


def review_queue(scored: DataFrame, key=KEY, low: float = LOW_SCORE, gap: float = SMALL_GAP) -> DataFrame:
    """All rows of ambiguous keys with their scores."""
    return ranked(scored, key).filter(ambiguous(low, gap)).drop("rank", "size", "best", "second")


def clean(rows: DataFrame, min_length: int = MIN_LENGTH, low: float = LOW_SCORE, judged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned, review) of raw translation rows, or of judged ones."""
    scored = rows.filter(F.col("score").isNotNull()) if judged else candidates(prepare(rows), min_length)
    return best_per_key(scored).select(*KEY, "translation_text"), review_queue(scored, low=low).select(*KEY, "score", "translation_text")


def clean_stats(rows: DataFrame, min_length: int = MIN_LENGTH, key=KEY, low: float = LOW_SCORE, gap: float = SMALL_GAP, judged: bool = False) -> DataFrame:
    """One row of counters, in one pass: each text is cleaned and judged once (or was
    before), and what is left of it (its key and its score) is dealt by key."""
    judged = (rows if judged else judge(prepare(rows), min_length)).drop("translation_text")
    order = Window.partitionBy(*key).orderBy(F.col("score").desc_nulls_last(), "row_idx")
    turn, second, size = F.row_number().over(order), F.lead("score").over(order), F.count("score").over(Window.partitionBy(*key))
    best = judged.select("score", turn.alias("rank"), second.alias("second"), size.alias("size"), F.col("score").alias("best"))
    first = (F.col("rank") == 1) & F.col("score").isNotNull()
    made = best.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("score").isNull()).alias("dropped_junk"),
        F.count_if(first).alias("kept"),
        F.count_if(first).alias("dedup_groups"),
        F.count_if(first & ambiguous(low, gap)).alias("ambiguous_groups"),
    )
    return made.withColumn("total_input_rows", F.col("total_rows"))
