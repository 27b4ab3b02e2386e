"""Line dedup over levelled sorted runs of line hashes.

A store keeps the keys of all lines seen so far as runs: tables of (key, owner), in
buckets of the key's hash and sorted by key.  A batch of documents

1. gets its distinct keys (grouped, so a key of very many lines is summed up before
   the shuffle),
2. merge-anti-joins them with the runs, one after the other; the runs need neither an
   exchange nor a sort for it.  What is left is new and becomes a run of level 0, its
   owner the smallest document of the batch that holds it,
3. loses the lines whose key the new run does not give to their document.

When a level holds FANOUT runs they are merged, bucket by bucket, into one run of the
next, so a store of n batches has O(log n) runs.  Everything is DataFrame operations.
Runs are written to the shared folder and never recomputed.

A line that very many documents hold would send all its places to one task in step 3.
Keys with at least one in HOT_SHARE of all lines, so HOT_SHARE keys at most, are looked
up in a broadcast table of their owners and take no part in the runs.

Keys are compared by two 64-bit hashes with different seeds; texts never leave the
two scans that cut them into lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, Scratch, col, own, sorted_buckets

#: White space stripped from the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
MIN_KEY = 10
FANOUT = 2
#: Batches that ``dedup_lines`` cuts a whole table into, by ranges of doc_id: more than
#: FANOUT, so the runs are compacted and the last batch meets the compacted one.  The
#: number doesn't grow with the table: each batch reads all runs before it, so that
#: would make the work quadratic.
BATCHES = FANOUT + 1
#: Lines of a batch for each bucket, and the bounds of the number of buckets.
BUCKET_LINES, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 8, 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z (only) lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is much faster than translate(), and the same unless other characters have a lower case
    other = bare.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))


def _lines(docs: DataFrame, text: str) -> Column:
    return F.split(F.coalesce(col(text).cast("string"), F.lit("")), "\n")


def line_hashes(docs: DataFrame, text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, version, pos, a, b) of each line with a key of min_key code points or more.
    version tells rows of one doc_id with different texts apart.  Documents without an
    id take no part."""
    rows = docs.select(col("doc_id"), F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))).alias("version"), F.posexplode(_lines(docs, text)).alias("pos", "line"))
    keyed = rows.filter("doc_id is not null").withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_key)
    return keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


class LineRuns:
    """The levelled store.  Batches must come in ascending order of doc_id if the
    smallest document is to own a line that several batches hold.  lines: how many a
    batch has or so, which sets the number of buckets."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, lines: int = 0):
        self.scratch, self.fanout = scratch, fanout
        wanted = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-lines // BUCKET_LINES)))
        with sorted_buckets(scratch.spark, wanted):
            self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.spent: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def fresh(self, held: DataFrame) -> DataFrame:
        """The keys that no run has: sorted tables, merged."""
        for run in self.runs():
            held = held.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return held

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Rows (doc_id, version, pos) of the batch's lines to drop; adds the batch's run.
        They are not computed yet: save them within ``sorted_buckets`` before ``clear``."""
        with sorted_buckets(self.scratch.spark, self.buckets):
            held = lines.groupBy("a", "b").agg(F.min("doc_id").alias("owner"))
            run = self.scratch.save_buckets(self.fresh(held), "run-0", ["a", "b"], self.buckets)
            keys = run.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "owner").hint("merge")
            # the owner is the smallest, so a line that its document doesn't own has a larger id
            lost = lines.join(keys, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (F.col("doc_id") <= F.col("owner")), "left_anti")
            self._add(run)
        return lost.select("doc_id", "version", "pos")

    def clear(self) -> None:
        """Free what only the batches so far needed."""
        self.scratch.drop(*self.spent)
        self.spent = []

    def _add(self, run: DataFrame) -> None:
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        """Merge full levels into the next, each bucket by itself.  Runs of different
        batches share no key."""
        at = 0
        while at < len(self.levels):
            level = self.levels[at]
            if len(level) >= self.fanout:
                merged = self.scratch.save_buckets(self._merged(level), f"run-{at + 1}", ["a", "b"], self.buckets)
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at] = []
                self.levels[at + 1].append(merged)
                self.spent += level
            at += 1

    def _merged(self, level: list[DataFrame]) -> DataFrame:
        whole = reduce(DataFrame.unionByName, level)  # of the same partitions, so nothing moves
        return whole.repartition(self.buckets, "a", "b").sortWithinPartitions("a", "b")


def frequent_keys(hashes: DataFrame, total: int) -> DataFrame:
    """(a, b, owner) of the keys that at least one in HOT_SHARE of all lines has: HOT_SHARE
    rows at most."""
    counted = hashes.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    return counted.filter(F.col("n") >= max(2, total / HOT_SHARE)).drop("n")


def lines_to_drop(docs: DataFrame, scratch: Scratch, text: str = "text", min_key: int = MIN_KEY, batches: int = BATCHES) -> DataFrame:
    """(doc_id, version, pos) of all lines that lose against a smaller doc_id."""
    cuts = [k / batches for k in range(1, batches)]
    edges = sorted({int(e) for e in docs.select(col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", cuts, 0.02)}) if cuts else []
    batch = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    hashes = scratch.save(line_hashes(docs, text, min_key).withColumn("batch", batch), "lines", by="batch")
    sizes = {r["batch"]: r["count"] for r in hashes.groupBy("batch").count().collect()}
    if not sizes:
        return hashes.select("doc_id", "version", "pos")
    total = sum(sizes.values())
    hot = scratch.save(frequent_keys(hashes, total), "hot", rows=HOT_SHARE)
    place = ["doc_id", "version", "pos"]
    drops = [hashes.join(F.broadcast(hot), ["a", "b"]).filter("doc_id > owner").select(*place)]
    rest = hashes.join(F.broadcast(hot), ["a", "b"], "left_anti")
    store = LineRuns(scratch, lines=max(sizes.values()))
    drops += [store.ingest(rest.filter(F.col("batch") == at).drop("batch")) for at in sorted(sizes)]
    with sorted_buckets(docs.sparkSession, store.buckets):
        saved = scratch.save(reduce(DataFrame.unionByName, drops), "drops", rows=total)
    store.clear()
    scratch.drop(hashes, hot, *store.runs())
    return saved


def dedup_lines(docs: DataFrame, scratch: Scratch, text: str = "text", min_key: int = MIN_KEY, batches: int = BATCHES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of ``docs`` with two counts (long), of the lines before and of those
    dropped, and the text without the lines whose key (of min_key code points or more) a
    smaller doc_id holds too.

    A null or empty text is one empty line.  Rows with a null doc_id stay whole and own
    nothing.  Rows of the same doc_id are one document: they don't cost each other
    lines.  An empty table gives an empty result.  Columns with the names of the counts
    are replaced; others stay, whatever their names.
    """
    drops = lines_to_drop(docs, scratch, text, min_key, batches)
    lists = drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("pos"))
    i, v, p, ls, n = (own(name, docs) for name in ("__id__", "__version__", "__pos__", "__lines__", "__n__"))
    ours = lists.select(F.col("doc_id").alias(i), F.col("version").alias(v), F.col("pos").alias(p))
    keep = [c for c in docs.columns if c.lower() not in counts]
    rows = docs.select(*[col(c) for c in keep])
    version = F.xxhash64(F.coalesce(col(text).cast("string"), F.lit("")))
    joined = rows.join(ours, (col("doc_id") == F.col(i)) & (version == F.col(v)), "left")
    cut = joined.withColumn(ls, _lines(joined, text)).withColumn(n, F.size(ls))
    # array_except works by hashing, so a document of many lines and drops stays linear
    left = F.array_except(F.sequence(F.lit(0), F.col(n) - 1), F.col(p))
    kept = F.array_join(F.transform(left, lambda at: F.get(F.col(ls), at)), "\n")
    whole = F.coalesce(col(text).cast("string"), F.lit(""))
    new = F.when(F.col(p).isNull(), whole).otherwise(kept)
    return cut.select(
        *[new.alias(c) if c == text else col(c) for c in keep],
        F.col(n).cast("long").alias(counts[0]),
        F.coalesce(F.size(p), F.lit(0)).cast("long").alias(counts[1]),
    )


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row; cases as in ``dedup_lines``."""
    made = dedup_lines(docs.select(col("doc_id"), col("text")), Scratch(docs.sparkSession, "line-dedup"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("kept_sha256"))


def deduped_documents(docs: DataFrame) -> DataFrame:
    """The documents with deduped text and its length in ``n_chars``; no row goes, and all
    other columns stay as they are.  Cases as in ``dedup_lines``; a null text becomes empty."""
    counts = (own("__n_lines__", docs), own("__n_dropped__", docs))
    made = dedup_lines(docs, Scratch(docs.sparkSession, "line-dedup"), counts=counts)
    return made.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])
