"""Quality classification by hierarchical empirical Bayes.

A logistic classifier gives each document's own evidence, from measures of its text and
from what its hashed words, word pairs and byte 4-grams say: the mean log-ratio of their
shares among the good and the bad labelled documents.  Those log-ratios are counted in two
folds, so the logistic's weights are fitted on ratios that haven't seen the document.

Sites (hosts, and paths within hosts) get posteriors of the evidence: a site's mean is
shrunk toward its parent's (path to host, host to the corpus) by n / (n + strength),
where the strength is the variance of documents within sites over that between the sites
of one parent, estimated from grouped sums.  A site of few documents so stays near its
parent, and so do all sites that don't differ.  A document's quality adds, in log-odds,
what its site says beyond the corpus to its own evidence; the site's posterior leaves the
document itself out.

A fifth of the labelled documents, told by a hash of their id, is held out of the fit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, col, map_texts, ship, slices
from .language import held_out

#: Expected number of labelled documents that the classifier is fitted on, at most.
MAX_TRAINING = 20_000
#: Weight of the site's log-odds.
SITE_WEIGHT = 1.0
THRESHOLD = 0.5
#: Up to so many sites their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SITES = 20_000

_SYMBOLS = "#*$%&|<>=_~^{}[]\\"
_END = re.compile(r"[.!?…][\"')\]]*\s*$")


def measures(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words) or 1, len(text) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines) or 1
    distinct = len(set(words))
    upper = sum(1 for x in lines if x.isupper())
    symbols = sum(map(text.count, _SYMBOLS))
    stops = sum(map(text.count, ".!?"))
    return [
        np.log1p(len(words)),
        size / n / 10,
        min(symbols / n, 3.0),
        min(text.count("|") / n, 1.0),
        min(text.count("!") / n, 2.0),
        upper / m,
        1 - distinct / n,
        (1 - distinct / n) ** 2,
        (len(lines) - len(set(lines))) / m,
        sum(1 for x in lines if _END.search(x)) / m,
        min(stops / n, 2.0),
        min(text.count(",") / n, 1.0),
        min(sum(map(text.count, "0123456789")) / size * 10, 3.0),
        min(text.count("http") / n * 10, 3.0),
        np.log1p(size / m),
        len(raw) / size - 1,
    ]


#: Buckets of words and word pairs, and of 4-grams of bytes.
BITS = 16
BUCKETS = 1 << BITS
#: Bytes hashed at once.  A longer text is cut there; what crosses a cut isn't counted.
BLOCK = 1 << 20
SMOOTHING = 1.0
#: Means of the log-ratios of words, word pairs and 4-grams.
KINDS = 3
N_FEATURES = len(measures("x")) + KINDS

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_POWER = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _hashes(data: np.ndarray, of: np.ndarray):
    """(buckets, texts) of the words, word pairs and 4-grams of bytes that belong to the
    texts ``of``.  Words are what bytes up to 32 part; texts end with one."""
    data = _FOLD[data]
    solid = data > 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    starts = np.flatnonzero(begins)
    if len(starts):
        place = np.arange(len(data))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        worth = np.where(solid, data, 0).astype(np.uint64) * _POWER[np.minimum(place, 63)]
        words, mine = np.add.reduceat(worth, starts), of[starts]
        yield _bucket(words), mine
        same = mine[1:] == mine[:-1]
        yield _bucket((words[:-1] * _MIX + words[1:])[same]), mine[1:][same]
    else:
        yield np.zeros(0, dtype=np.int64), starts
        yield np.zeros(0, dtype=np.int64), starts
    wide = data.astype(np.uint64)
    grams = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
    same = of[3:] == of[: max(0, len(of) - 3)]
    yield _bucket(grams[same]), of[3:][same]


def gram_blocks(texts: list):
    """The buckets of a batch of texts, block by block."""
    held, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), BLOCK):
            part = raw[at : at + BLOCK] + b" "
            if held and size + len(part) > BLOCK:
                yield _hashes(np.frombuffer(b"".join(held), dtype=np.uint8), np.repeat(numbers, list(map(len, held))))
                held, numbers, size = [], [], 0
            held.append(part)
            numbers.append(i)
            size += len(part)
    if held:
        yield _hashes(np.frombuffer(b"".join(held), dtype=np.uint8), np.repeat(numbers, list(map(len, held))))


def features(texts: list, ratios: np.ndarray) -> np.ndarray:
    """The measures, and the mean of ``ratios`` (KINDS x BUCKETS) over each kind of gram."""
    total, count = np.zeros((KINDS, len(texts))), np.zeros((KINDS, len(texts)))
    for block in gram_blocks(texts):
        for kind, (bucket, of) in enumerate(block):
            total[kind] += np.bincount(of, weights=ratios[kind][bucket], minlength=len(texts))
            count[kind] += np.bincount(of, minlength=len(texts))
    return np.hstack([np.array([measures(t) for t in texts], dtype=np.float64), (total / np.maximum(count, 1)).T])


class Logistic:
    """Ridge logistic regression by Newton's method on standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> "Logistic":
        if not len(x):
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def _count_grams(batches):
    """Rows (fold, y, kind, bucket, n): what the task's documents add to the counts."""
    total = np.zeros((2, 2, KINDS, BUCKETS), dtype=np.int64)
    for whole in batches:
        for part in slices(whole, "text"):
            fold, y = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
            for block in gram_blocks(part.column("text").to_pylist()):
                for kind, (bucket, of) in enumerate(block):
                    for f in (0, 1):
                        for label in (0, 1):
                            total[f, label, kind] += np.bincount(bucket[(fold[of] == f) & (y[of] == label)], minlength=BUCKETS)
    at = np.nonzero(total)
    columns = [pa.array(a, type=pa.int32()) for a in at] + [pa.array(total[at], type=pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["fold", "y", "kind", "bucket", "n"])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Of counts (2 labels x KINDS x BUCKETS); 0 where one of the labels has none at all."""
    shares = np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=2, keepdims=True))
    return (shares[1] - shares[0]) * (counts.sum(axis=2) > 0).all(axis=0)[:, None]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y, fold) of the labelled documents that aren't held out: all up to
    MAX_TRAINING, beyond that those whose id's hash falls into the share that gives so
    many.  Several labels of one document count as their majority, a tie as good; null
    labels and ids don't count; of several texts of one document the smallest counts."""
    marks = labels.select(col("doc_id").alias("doc_id"), col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
    marks = marks.filter(~held_out(F.col("doc_id")))
    there = marks.count()
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    if there > MAX_TRAINING:
        marks = marks.filter(hashed.bitwiseAND(F.lit((1 << 32) - 1)) < F.lit(int(MAX_TRAINING / there * (1 << 32))))
    marks = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = docs.select(col("doc_id"), F.coalesce(col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")  # MAX_TRAINING rows or so
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))


class Classifier:
    """ratios: of the grams; logistic: over all features."""

    def __init__(self, ratios: np.ndarray, logistic: Logistic):
        self.ratios, self.logistic = ratios, logistic

    def predict(self, texts: list) -> np.ndarray:
        return self.logistic.predict(features(texts, self.ratios))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Classifier:
    """The classifier of ``training_rows``.  What reaches the driver is a row for each
    bucket, fold and label, and one of N_FEATURES numbers for each training row."""
    spark = docs.sparkSession
    ship(spark)
    rows = scratch.save(training_rows(docs, labels), "training")
    made = rows.select("text", "y", "fold").mapInArrow(_count_grams, "fold int, y int, kind int, bucket int, n bigint")
    counted = made.groupBy("fold", "y", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 2, KINDS, BUCKETS))
    counts[tuple(counted[c].to_numpy() for c in ("fold", "y", "kind", "bucket"))] = counted["n"].to_numpy()
    # a document's features come from the ratios of the other fold
    folds = spark.sparkContext.broadcast([log_ratios(counts[1]).astype(np.float32), log_ratios(counts[0]).astype(np.float32)])

    def measure(batches):
        for whole in batches:
            for part in slices(whole, "text"):
                fold, texts = part.column("fold").to_numpy(zero_copy_only=False), part.column("text").to_pylist()
                x = np.zeros((len(texts), N_FEATURES))
                for f in (0, 1):
                    at = np.flatnonzero(fold == f)
                    if len(at):
                        x[at] = features([texts[i] for i in at.tolist()], folds.value[f])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(x.tolist(), type=pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # sorted here, so the sums of the fit don't hang on the order of partitions
    got = rows.select("doc_id", "text", "y", "fold").mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    scratch.drop(rows)
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), N_FEATURES)
    return Classifier(log_ratios(counts.sum(axis=0)).astype(np.float32), Logistic.fit(x, got["y"].to_numpy(dtype=np.float64)))


def evidence(docs: DataFrame, model: Classifier, keep) -> DataFrame:
    """``docs[keep]`` with ``p``, the probability that the document's own text gives."""
    logistic = model.logistic
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios, logistic.mean, logistic.scale, logistic.weights))

    def make_kernel():
        ratios, *rest = shared.value
        model = Classifier(ratios, Logistic(*rest))
        return lambda texts: [model.predict(texts)]

    return map_texts(docs, make_kernel, [("p", T.DoubleType(), pa.float64())], keep)


#: The largest strength: of sites that don't differ, and of those of which nothing is known.
STRONGEST = 1e6


def _strength(within: float, spread: float, degrees: float, between: float) -> float:
    """within: variance of documents within sites; between: sum of squares of the sites'
    means about their parents', of so many degrees; spread: the weight that the variance
    between sites has in its expectation."""
    if degrees <= 0 or spread <= 0:
        return STRONGEST
    variance = (between - degrees * within) / spread
    return float(min(max(within / max(variance, 1e-12), 0.1), STRONGEST))


def strengths(sites: DataFrame) -> dict:
    """The corpus's mean and the strengths of hosts and of paths, from the sums (n, s, ss)
    of each path and (hn, hs) of its host: a nested analysis of variance.  The paths'
    variance is that about their host's mean, so hosts that differ don't count for it."""
    n, s, hn, hs = (F.col(c).cast("double") for c in ("n", "s", "hn", "hs"))
    r = sites.agg(
        F.count("*").alias("paths"), F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("ss").alias("ss"), F.sum(s * s / n).alias("sq"), F.sum(n * n / hn).alias("nested"),
        # each host counts once: its paths' shares sum to one
        F.sum(n / hn).alias("hosts"), F.sum(n * hs * hs / (hn * hn)).alias("hsq"), F.sum(n * hn).alias("hnn"),
    ).first()
    if not r["n"]:
        return {"mean": 0.5, "host": STRONGEST, "path": STRONGEST}
    n, hosts = r["n"], round(r["hosts"])
    variance = lambda left, groups: max(left / (n - groups), 1e-9) if n > groups else None
    of_path, of_host = variance(r["ss"] - r["sq"], r["paths"]), variance(r["ss"] - r["hsq"], hosts)
    path = STRONGEST if of_path is None else _strength(of_path, n - r["nested"], r["paths"] - hosts, r["sq"] - r["hsq"])
    host = STRONGEST if of_host is None else _strength(of_host, n - r["hnn"] / n, hosts - 1, r["hsq"] - r["s"] ** 2 / n)
    return {"mean": r["s"] / n, "host": host, "path": path}


def posteriors(scored: DataFrame, scratch: Scratch, host: str, path: str) -> tuple[DataFrame, dict]:
    """Sums of each (host, path) and of its host; the corpus's mean and the strengths.

    Grouped with partial sums by path first; hosts are sums of their paths, so a host
    with a third of all documents costs a row for each path."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths = scratch.save(scored.groupBy(host, path).agg(*sums), "paths")
    hosts = paths.groupBy(F.col(host).alias("__host__")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    made = paths.join(hosts, paths[host].eqNullSafe(hosts["__host__"])).select(F.col(host).alias("__h__"), F.col(path).alias("__p__"), "n", "s", "ss", "hn", "hs")
    made = scratch.save(made, "sites")
    return made, strengths(made)


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, held_out, p_doc, p_host, p_path, quality, kept) of each row of
    ``docs``.  held_out: labels of such ids take no part in the fit.

    A null host or path is a site of its own.  Null and empty texts are measured as
    empty.  Without labels of both kinds every document has the same evidence.  Repeated
    rows are judged each (and count each for their site); an empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(col("doc_id"), col("text"), col(host).cast("string").alias("host"), col(path).cast("string").alias("path"))
    model = fit(docs, labels, scratch)
    scored = scratch.save(evidence(rows, model, ["doc_id", "host", "path"]), "evidence")
    sites, at = posteriors(scored, scratch, "host", "path")
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scored.join(sites, scored["host"].eqNullSafe(F.col("__h__")) & scored["path"].eqNullSafe(F.col("__p__")))
    mean, kh, kp = F.lit(at["mean"]), F.lit(at["host"]), F.lit(at["path"])
    p = F.col("p")  # the document itself is left out
    p_host = (kh * mean + F.col("hs") - p) / (kh + F.col("hn") - 1)
    p_path = (kp * p_host + F.col("s") - p) / (kp + F.col("n") - 1)
    z = _logit(p) + F.lit(SITE_WEIGHT) * (_logit(p_path) - _logit(mean))
    made = joined.select("doc_id", "host", "path", held_out(F.col("doc_id")).alias("held_out"), p.alias("p_doc"), p_host.alias("p_host"), p_path.alias("p_path"), (1 / (1 + F.exp(-z))).alias("quality"))
    return made.withColumn("kept", F.col("quality") >= THRESHOLD)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``classify``, with sources as hosts and languages as the paths within them."""
    return classify(docs, labels)
