"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities (buckets x languages) and the languages' log shares are
learned from all labelled documents, whose n-grams are counted where they lie, broadcast,
and applied to batches of texts in numpy: the n-grams of a whole batch are hashed at once,
those across two texts left out, their rows of the matrix gathered and summed text by text.

The matrix has MAX_CELLS cells at most: with very many languages there are fewer buckets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_texts, ship, slices

BITS = 15
BUCKETS = 1 << BITS
#: A task that has counted so many languages gives its counts away and starts anew.
HELD_LANGS = 128
SMOOTHING = 0.5
#: Cells of the matrix of log-probabilities: 256 languages with all buckets, 32 MB.
MAX_CELLS = 1 << 23
#: Code points hashed at once; longer texts are added up in pieces of this length.
BLOCK = 1 << 18
#: Languages scored at once.
LANGS = 32

_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of one of Unicode's letter categories stands in the text."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))  # digits and numerals like ² or Ⅷ match as well


# ASCII characters that aren't letters count as a space.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < 128
    return np.where(low, _ASCII[np.where(low, codes, 0)], codes)


def _hash(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams; those of one order, then the next."""
    a = codes * np.uint32(0x9E3779B1)
    out = [a >> np.uint32(32 - BITS)]
    if len(codes) > 1:
        b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[1:]
        out.append((b * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS))
        if len(codes) > 2:
            c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + a[2:]
            out.append((c * np.uint32(0x165667B1)) >> np.uint32(32 - BITS))
    return out


def grams(texts: list):
    """(buckets, numbers of the texts) of the n-grams of each order, block by block; each
    text in lower case, with a space before and after it."""
    parts, numbers, owned, size = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t = f" {t.lower()} "
        for at in range(0, len(t), BLOCK):
            if parts and size + min(BLOCK, len(t) - at) > BLOCK:
                yield from _block(parts, numbers, owned)
                parts, numbers, owned, size = [], [], [], 0
            parts.append(t[at : at + BLOCK + 2])  # n-grams may begin in the first BLOCK of them
            numbers.append(i)
            owned.append(min(BLOCK, len(t) - at))
            size += len(parts[-1])
    if parts:
        yield from _block(parts, numbers, owned)


def _block(parts: list[str], numbers: list[int], owned: list[int]):
    lengths = np.array(list(map(len, parts)))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    of, begins, left = np.repeat(numbers, lengths), place < np.repeat(owned, lengths), np.repeat(lengths, lengths) - place
    for n, h in enumerate(_hash(_codes("".join(parts))), 1):
        whole = (begins & (left >= n))[: len(h)]
        yield h[whole], of[: len(h)][whole]


def _count(batches):
    """Rows (lang, bucket, n): what the task's documents add to the counts; their number
    stands at bucket -1.  A task of very many languages may give several rows for one bucket."""
    total: dict = {}
    for whole in batches:
        for part in slices(whole, "text"):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            names = sorted(set(langs))
            rows: dict = {name: [] for name in names}
            for i, name in enumerate(langs):
                rows[name].append(i)
            for name in names:
                if name not in total:
                    if len(total) >= HELD_LANGS:
                        yield from _given(total)
                        total.clear()
                    total[name] = np.zeros(BUCKETS + 1, dtype=np.int64)
                total[name][0] += len(rows[name])
                for h, _ in grams([texts[i] for i in rows[name]]):
                    total[name][1:] += np.bincount(h, minlength=BUCKETS)
    yield from _given(total)


def _given(total: dict):
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), type=pa.string()), pa.array(at - 1, type=pa.int32()), pa.array(counts[at], type=pa.int64())],
            names=["lang", "bucket", "n"],
        )


class Model:
    """langs: sorted names; weights: log-probabilities, float32 of shape (buckets, langs), a
    bucket being ``h >> shift``; prior: log shares of the languages' documents."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray, shift: int = 0):
        self.langs, self.weights, self.prior, self.shift = langs, weights, prior, shift

    def log_odds(self, texts: list) -> np.ndarray:
        """The prior and the summed log-probabilities of each text (rows) and language."""
        total = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        for h, of in grams(texts):
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            for low in range(0, len(self.langs), LANGS):
                some = self.weights[:, low : low + LANGS]
                total[of[starts], low : low + LANGS] += np.add.reduceat(some[h >> self.shift], starts, axis=0, dtype=np.float64)
        return total

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        if known:
            total = self.log_odds([texts[i] for i in known])
            best = total.argmax(axis=1)
            share = 1.0 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0.0)).sum(axis=1)
            for i, b, p in zip(known, best.tolist(), share.tolist()):
                labels[i], scores[i] = self.langs[b], p
        return labels, scores


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", cells: int = MAX_CELLS) -> Model:
    """The model of all labelled documents, so a rare language among very many documents
    is learned too.  What reaches the driver, and then all workers, is bounded by ``cells``."""
    ship(docs.sparkSession)
    rows = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null and text <> ''")
    # the names alone are read here, an upper bound of those that texts stand for
    many = docs.select(col(lang).alias("lang")).filter("lang is not null").distinct().count()
    shift = 0
    while shift < BITS and (many << (BITS - shift)) > cells:
        shift += 1
    made = rows.mapInArrow(_count, "lang string, bucket int, n bigint")
    coarse = F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.shiftright("bucket", shift))
    counted = made.groupBy("lang", coarse.alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    table = np.zeros(((BUCKETS >> shift) + 1, len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    table[counted["bucket"].to_numpy(dtype=np.int64) + 1, counted["lang"].map(at).to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.float64)
    documents, counts = table[0], table[1:] + SMOOTHING
    weights = np.log(counts / counts.sum(axis=0, keepdims=True))
    return Model(langs, weights.astype(np.float32), np.log(documents / max(1, documents.sum())), shift)


def identify(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``lang_pred`` and ``score`` (its posterior probability).

    Texts that are null or have no letter, and all texts if the model has learned
    nothing, are ``und`` with score 0.  Equal posteriors: the language first in the
    alphabet.  An empty table gives an empty result; no column but the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior, model.shift))
    return map_texts(docs, lambda: Model(*shared.value).predict, [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())], keep, text)


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; documents that are held out, or
    have no lang or text, teach nothing.  Other columns are not read, whatever their names."""
    rows = docs.select(col("doc_id"), col("text"), col("lang"), held_out(col("doc_id")).alias("held_out"))
    return identify(rows, fit(rows.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))
