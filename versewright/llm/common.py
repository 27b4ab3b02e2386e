"""What the operators share: shared storage, code shipping, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

#: Texts handed to a kernel at once, in bytes; bounds a Python worker's memory.
SLICE_BYTES = 8 << 20


def col(name: str):
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that no column of the frames has."""
    there = {c.lower() for df in frames for c in df.columns}
    while name in there:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_bytes(path: str) -> bytes:
    """A tokenizer file read on the driver; it is broadcast, so executors need no copy."""
    return Path(path).read_bytes()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- shared storage ------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only where that is unset and all tasks
    run in this process, a local one; a cluster without a shared folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        root = "file://" + os.path.join(tempfile.gettempdir(), "versewright-checkpoints")
    return root.rstrip("/")


@contextmanager
def sorted_buckets(spark: SparkSession, buckets: int | None = None):
    """While plans are made in here, bucketed tables count as partitioned and sorted by
    their keys, so joins and merges of them need neither an exchange nor a sort; with
    ``buckets``, groupings make so many partitions, so their results are in buckets already."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    if buckets:
        wanted["spark.sql.shuffle.partitions"] = str(buckets)
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Rows of small tables for each file, and files at least.
FILE_ROWS, LEAST_FILES = 250_000, 8


class Scratch:
    """Tables of one run in the shared folder.

    ``save`` cuts the lineage: the rows are written as Parquet, so the loss of an
    executor costs a re-read of files and no recomputation.  The folder is removed
    when the driver ends, or by ``drop`` as soon as a table is no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/versewright/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None, rows: int | None = None) -> DataFrame:
        """by: a column whose values get folders of their own.  rows: about how many there are
        at most; few rows are written by few tasks, so many partitions don't make many files."""
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
        df.write.parquet(path, partitionBy=by)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._versewright_path = path
        return saved

    def save_buckets(self, df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
        """As ``save``, in buckets of the keys' hash and sorted by the keys in each: one file a
        bucket, if ``df`` is partitioned by the keys.  The catalog keeps no entry."""
        path, known_as = self.path(name), f"versewright_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(known_as)
        saved = self.spark.table(known_as)
        self.spark.sql(f"DROP TABLE {known_as}")  # the files stay: the path makes it external
        saved._versewright_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            self._remove(df._versewright_path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the JVM may have gone first; the shared folder is the cluster's to clean
            pass


#: A key with at least one in so many of all rows is hot; there can be no more of them.
HOT_SHARE = 2_048


def join_hot(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``found`` by ``key``, where few keys may hold most of ``rows``:
    those of ``hot``, a part of ``found`` of at most HOT_SHARE rows, are looked up in a
    broadcast table, so their rows are not shuffled."""
    looked_up = rows.join(F.broadcast(hot), key)
    return looked_up.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found, key))


# -- Arrow batches -------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that no part but a single row holds over ``limit`` bytes of text."""
    rows = batch.num_rows
    size = batch.column(column).nbytes
    if size <= limit or rows <= 1:
        if rows:
            yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), column, limit)
    yield from slices(batch.slice(half), column, limit)


def map_texts(
    df: DataFrame,
    make_kernel: Callable[[], Callable[[list], Sequence]],
    fields: Sequence[tuple[str, T.DataType, pa.DataType]],
    keep: Sequence[str],
    text: str = "text",
    as_array: bool = False,
) -> DataFrame:
    """``df[keep]`` with the columns that a kernel makes from each text.

    ``make_kernel()`` runs once per task and returns a function from a list of texts
    (str or None; with ``as_array`` an Arrow array) to one sequence per field.  A kept column with the name of a new
    field gives way to the new one.  Only ``keep`` and ``text`` reach Python.
    """
    ship(df.sparkSession)
    new = {name.lower() for name, _, _ in fields}
    kept = [c for c in keep if c.lower() not in new]
    source = own("__text__", df)
    rows = df.select(*[col(c) for c in kept], col(text).cast("string").alias(source))
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t, _ in fields])
    names = kept + [n for n, _, _ in fields]
    arrow = [t for _, _, t in fields]

    def run(batches):
        kernel = make_kernel()
        for whole in batches:
            for part in slices(whole, source):
                texts = part.column(source)
                made = kernel(texts if as_array else texts.to_pylist())
                arrays = [part.column(c) for c in kept]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)
