"""Readers: JSON lines, JSON arrays, delimited and plain text."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import first_text, first_usable, int_or_zero
from ..functions.text import strip
from ..schema import VERSE

# Names under which files have the columns, the usual one first.
CSV_NAMES = {
    "mandala": ("mandala", "mandal", "m"),
    "sukta": ("sukta", "hymn", "s"),
    "verse_index": ("verse_index", "verse", "verse_no"),
    "translation_text": ("translation_text", "translation", "text"),
}
JSON_NAMES = {
    "mandala": ("mandala", "m"),
    "sukta": ("sukta", "hymn"),
    "verse_index": ("verse_index", "verse"),
    "translation_text": ("translation_text", "translation", "text"),
}
CORRUPT = "_corrupt_record"


_FILE, _BLOCK, _PLACE = "__file__", "__block__", "__place__"
_PLACE_BITS = 33


def _placed(df: DataFrame) -> DataFrame:
    """A frame straight from a reader with each row's file (a hash), block of the file and
    place in its partition, which rises within a block."""
    file, block = F.xxhash64("_metadata.file_path"), F.col("_metadata.file_block_start")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return df.select("*", file.alias(_FILE), block.alias(_BLOCK), place.alias(_PLACE))


def with_row_index(df: DataFrame) -> DataFrame:
    """row_idx by (path of the file, place in the file): rising in input order, with gaps.
    df: straight from a reader.

    Spark packs blocks of files into partitions by size, so the number of a partition tells
    nothing; a small table ranks the blocks by path and offset instead.  No row has to pass
    a single task, only a row for each block of some 100 MB."""
    blocks = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).distinct()
    rank = (F.row_number().over(Window.orderBy("path", "start")) - 1).cast("bigint")
    ranked = blocks.select(F.xxhash64("path").alias(_FILE), F.col("start").alias(_BLOCK), rank.alias("__rank__"))  # 24 bytes a block
    rows = _placed(df).join(F.broadcast(ranked), [_FILE, _BLOCK])
    row_idx = F.shiftleft("__rank__", _PLACE_BITS) + F.col(_PLACE)
    return rows.withColumn("row_idx", row_idx).drop(_FILE, _BLOCK, _PLACE, "__rank__")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, value) of text files, lines from 1."""
    rows = _placed(spark.read.text(path).select("value", "_metadata", F.col("_metadata.file_path").alias("source_file")))
    blocks = rows.groupBy("source_file", _BLOCK).agg(F.count("*").alias("rows"), F.min(_PLACE).alias("first"))
    before = Window.partitionBy("source_file").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source_file", _BLOCK, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["source_file", _BLOCK]).select("source_file", (F.col(_PLACE) + F.col("shift")).alias("line_no"), "value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, value) of the lines that are neither blank nor JSON objects."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    return rows.filter(F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType = VERSE, strict: bool = False) -> DataFrame:
    """One record a line; blank lines don't count.  Tolerant: bad bytes are replaced and
    lines that still don't parse are kept in _corrupt_record.  Strict: the first of those
    raises here, with its file and number."""
    if strict:
        bad = bad_lines(spark, path).orderBy("source_file", "line_no").first()
        if bad:
            raise ValueError(f"{bad['source_file']}, line {bad['line_no']}: no JSON object: {bad['value'][:80]!r}")
    lines = with_row_index(spark.read.text(path))
    rows = lines.select(F.make_valid_utf8("value").alias("value"), "row_idx").filter(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return rows.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "row_idx").select("r.*", "row_idx")


def _named(df: DataFrame, names: dict, text: str) -> DataFrame:
    there = {c.lower(): c for c in df.columns}
    found = lambda key: [F.col(f"`{there[n]}`") for n in names[key] if n in there]
    number = lambda key: int_or_zero(first_usable(*found(key))) if found(key) else F.lit(0)
    body = F.coalesce(first_text(*[c.cast("string") for c in found(text)]), F.lit("")) if found(text) else F.lit("")
    return df.select(*[number(k).alias(k) for k in ("mandala", "sukta", "verse_index")], body.alias("translation_text"), "row_idx")


def translations_csv(spark: SparkSession, path: str) -> DataFrame:
    """(mandala, sukta, verse_index, translation_text, row_idx) under any of the usual names."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    return _named(with_row_index(raw), CSV_NAMES, "translation_text")


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank opens an array."""
    line = strip(F.col("value"))
    first = spark.read.text(path).filter(line != "").select(F.substring(line, 1, 1)).limit(1).collect()  # a line may be the whole file
    return bool(first) and first[0][0] == "["


def translations_json(spark: SparkSession, path: str) -> DataFrame:
    """As translations_csv, of a JSON array or JSON lines."""
    raw = spark.read.option("multiLine", is_json_array(spark, path)).option("primitivesAsString", True).json(path)
    return _named(with_row_index(raw), JSON_NAMES, "translation_text")


def translations(spark: SparkSession, path: str) -> DataFrame:
    return translations_csv(spark, path) if path.lower().endswith(".csv") else translations_json(spark, path)


def translations_frame(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty cells kept.  Headers match without regard to case, else
    by their first three letters; the text is the last column where none matches."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    raw = with_row_index(raw).na.fill("")
    columns = [c for c in raw.columns if c != "row_idx"]

    def source(name: str) -> str | None:
        same = [c for c in columns if c.lower() == name]
        near = [c for c in columns if c.lower().startswith(name[:3])]
        return (same or near or [None])[0]

    made = []
    for name in ("mandala", "sukta", "verse_index", "translation_text"):
        from_ = source(name) or (columns[-1] if name == "translation_text" else None)
        made.append((F.col(f"`{from_}`") if from_ else F.lit("")).alias(name))
    return raw.select(*made, "row_idx")


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of known columns; malformed lines are left out."""
    return with_row_index(spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(mandala, sukta, text, source_file, pos) of files with arrays of pages, in file order.

    text may be a string or a list of strings (joined by newlines).  A file that can't be
    read as JSON gives what comes before the fault."""
    schema = "mandala int, sukta int, text string"
    raw = spark.read.schema(schema + f", {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = _placed(raw.select("*", "_metadata", F.col("_metadata.file_name").alias("source_file")))
    rows = rows.filter("mandala is not null and sukta is not null")
    listed = F.from_json("text", "array<string>")
    text = F.when(F.col("text").startswith("["), F.coalesce(F.array_join(listed, "\n"), F.col("text"))).otherwise(F.col("text"))
    order = Window.partitionBy(_FILE).orderBy(_BLOCK, _PLACE)
    return rows.select("mandala", "sukta", text.alias("text"), "source_file", (F.row_number().over(order) - 1).alias("pos"))


def page_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(key, page_number) of one JSON object that maps 'm-s-v' to page numbers."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("key", "page_number"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole text files, bad bytes replaced."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), F.make_valid_utf8("value").alias("text"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


class Cached:
    """A frame kept until it is dropped by hand, or older than ``seconds``."""

    def __init__(self, df: DataFrame, seconds: float = 3_600.0, clock=time.monotonic):
        self._df, self._seconds, self._clock = df, seconds, clock
        self._since = None

    @property
    def df(self) -> DataFrame:
        """The kept frame, read anew once its time is up."""
        if self._since is not None and self._clock() - self._since > self._seconds:
            self.invalidate()
        if self._since is None:
            self._df.persist()
            self._since = self._clock()
        return self._df

    def invalidate(self) -> None:
        self._df.unpersist()
        self._since = None
