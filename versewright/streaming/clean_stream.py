"""Streaming form of the cleaning filters (beyond the batch reference).

Translation rows that arrive as files are cleaned, filtered and deduplicated by key and
text within a watermark; the choice of the best text of a key needs all rows and stays
a batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import MIN_LENGTH, fate, prepare
from ..schema import KEY


def clean_stream(rows: DataFrame, min_length: int = MIN_LENGTH, event_time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """rows: (mandala, sukta, verse_index, translation_text, row_idx, <event_time>)."""
    stamped = rows.withColumn("row_idx", F.struct("row_idx", F.col(event_time).alias("ts")))
    ready = prepare(stamped).select(*KEY, "translation_text", F.col("row_idx.row_idx").alias("row_idx"), F.col("row_idx.ts").alias(event_time))
    kept = ready.filter(fate(min_length) == "candidate").withWatermark(event_time, lateness)
    return kept.dropDuplicatesWithinWatermark([*KEY, "translation_text"])
