"""Record types of the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "array<string>": T.ArrayType(T.StringType())}

KEY = ("mandala", "sukta", "verse_index")


def _struct(text: str) -> T.StructType:
    """'name kind, ...' as a type; parsed here, since Spark's own parser needs a session."""
    return T.StructType([T.StructField(*pair, True) for pair in ((n, _KINDS[k]) for n, k in (f.split() for f in text.split(",")))])


VERSE = _struct(
    "id string, mandala int, sukta int, verse_index int, verse_id string, deity string, rishi string, sanskrit string,"
    " transliteration string, translation string, metre string, padas array<string>, source_file string, page_number int, notes string"
)
TRANSLATION = _struct("mandala int, sukta int, verse_index int, translation_text string")
PARAGRAPH = _struct("doc_id bigint, pos int, para string")
REQUIRED = ("id", "mandala", "sukta", "verse_index", "sanskrit", "source_file")


def ensure_columns(df: DataFrame, schema: T.StructType = VERSE) -> DataFrame:
    """df with the missing columns of schema as typed nulls; others stay as they are."""
    there = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in there})


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names; arrays and maps stay."""

    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())])


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without joining them."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
