"""Writers.  Each takes an order where the file's order matters; small reports go to one
part, everything else keeps its partitions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY


def json_lines(df: DataFrame, path: str) -> None:
    """One record a line, nulls written, characters as they are."""
    df.write.option("ignoreNullFields", False).json(path)


def json_arrays(df: DataFrame, path: str, record: Column, least: int = 16, size: int = 16 << 20) -> None:
    """Files of one JSON array each, of the records (JSON text) in no order.  A file is
    written and read by one task, so there are more of them as the table grows: each takes
    about ``size`` bytes, and small tables are dealt into ``least``."""
    rows = df.select(record.alias("value"))
    total = rows.agg(F.sum(F.octet_length("value").cast("bigint") + 1)).first()[0] or 0
    files = max(least, ceil(total / size))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(files)).cast("int")).repartitionById(files, "part")  # a task for each file
    arrays = dealt.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def csv(df: DataFrame, path: str, order=(), one_file: bool = False) -> None:
    rows = df.orderBy(*order) if order else df
    rows = rows.coalesce(1) if one_file else rows
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def cleaned_csv(cleaned: DataFrame, path: str) -> None:
    csv(cleaned, path, KEY)


def review_csv(review: DataFrame, path: str) -> None:
    csv(review, path, (*KEY, F.desc("score")))


def summary_json(one_row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    json_lines(one_row.coalesce(1), path)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object with its nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def one_record(record: DataFrame, path: str) -> None:
    """A single record for download: <path>/json and <path>/csv, lists as JSON in the latter."""
    json_lines(record.coalesce(1), f"{path}/json")
    csv(flat_lists(record), f"{path}/csv", one_file=True)


def flat_lists(df: DataFrame) -> DataFrame:
    """Lists as JSON text, which a CSV can hold."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.to_json(c) if kinds[c].startswith("array") else F.col(c)).alias(c) for c in df.columns])


def text_file(df: DataFrame, path: str, column: str, order=(), one_file: bool = True, fallback: str | None = None) -> str:
    """The column's texts one after another, in order, in one part, or (for large corpora) in
    parts that follow each other by name.  Returns the folder: where ``path`` can't be
    written, ``fallback``."""
    rows = (df.orderBy(*order) if order else df).select(F.col(column).alias("value"))
    rows = rows.coalesce(1) if one_file else rows
    try:
        rows.write.text(path)
    except Exception as refused:
        if fallback is None or _rows_failed(refused):
            raise
        rows.write.text(fallback)
        return fallback
    return path


def _rows_failed(error: Exception) -> bool:
    """Whether the rows could not be made, so no other folder would help."""
    return "Task failed" in str(error) or "Job aborted" in str(error)


def next_backup(spark: SparkSession, path: str) -> str:
    """Copies path to the first free one of path.bak, path.bak1, ... and returns that."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs, n = where.getFileSystem(conf), 0
    while True:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}.bak{n or ''}")
        if not fs.exists(target):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, fs, target, False, conf)
            return target.toString()
        n += 1
