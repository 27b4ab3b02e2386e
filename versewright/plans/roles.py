"""The driver's tables in the roles of the corpus, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import verse_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(shift) -> list:
    return [
        (F.lit(1) + F.col("conv_id") % 10).cast("int").alias("mandala"),
        (F.col("conv_id") + 1).cast("int").alias("sukta"),
        shift.cast("int").alias("verse_index"),
        (F.col("conv_id") * 100000 + F.col("turn")).alias("row_idx"),
    ]


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that aren't the assistant's; every fifth conversation has a translation already."""
    rows = table(spark, sf_dir, "conversations").filter("role <> 'assistant'")
    rows = rows.select(
        *_keys(F.col("turn") + 1),
        F.col("text").alias("sanskrit"),
        F.nullif(F.col("role"), F.lit("system")).alias("deity"),
        F.when(F.col("conv_id") % 5 == 0, "seed").alias("translation"),
        F.when(F.col("conv_id") % 3 == 0, "metre_missing").alias("notes"),
        F.lit("conversations").alias("source_file"),
    )
    return rows.withColumn("id", verse_id(F.col("mandala"), F.col("sukta"), F.col("verse_index")))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns point at the turn before; every seventh conversation's point nowhere."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    shift = F.col("turn") + F.when(F.col("conv_id") % 7 == 0, 1000).otherwise(0)
    return rows.select(*_keys(shift), F.col("text").alias("translation_text"))


V_SQL = """
V AS (
  SELECT (1 + conv_id % 10)::INTEGER AS mandala, (conv_id + 1)::INTEGER AS sukta, (turn + 1)::INTEGER AS verse_index,
         conv_id * 100000 + turn AS row_idx, text AS sanskrit, nullif(role, 'system') AS deity,
         CASE WHEN conv_id % 5 = 0 THEN 'seed' END AS translation,
         CASE WHEN conv_id % 3 = 0 THEN 'metre_missing' END AS notes, 'conversations' AS source_file,
         printf('RV-%02d-%03d-%02d', 1 + conv_id % 10, conv_id + 1, turn + 1) AS id
  FROM conversations WHERE role <> 'assistant')
"""
T_SQL = """
T AS (
  SELECT (1 + conv_id % 10)::INTEGER AS mandala, (conv_id + 1)::INTEGER AS sukta,
         (turn + CASE WHEN conv_id % 7 = 0 THEN 1000 ELSE 0 END)::INTEGER AS verse_index,
         conv_id * 100000 + turn AS row_idx, text AS translation_text
  FROM conversations WHERE role = 'assistant')
"""

# White space and words for RE2, whose classes are ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def words_sql(words) -> str:
    return f"(?i){LEFT}(?:{'|'.join(words)}){RIGHT}"


# The entities that the SQL resolves, "amp" last so that what it gives isn't read again.
ENTITIES = {"quot": '"', "lt": "<", "gt": ">", "copy": "©", "middot": "·", "nbsp": "\xa0", "amp": "&"}


def unescape_sql(x: str) -> str:
    for name, character in ENTITIES.items():
        x = f"replace({x}, '&{name};', '{character}')"
    return x
