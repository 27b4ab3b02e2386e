"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths (in tokens) of the corpus's frequent
words; tier two is a cache in each Python worker that encodes what tier one lacks.
No word is ever shuffled.  The key of both tiers is the white-space delimited word:
the tokenizer's pre-tokens never span white space, so a text's count is the sum over
its words, and one lookup stands for all the pre-tokens of a word.

The frequent words come from all texts: each task keeps a Misra-Gries style summary
of bounded size and the summaries are merged in a tree, so the driver gets one
summary, whatever the corpus.  The table changes speed alone, never a result.

A missed word of letters with punctuation after them is cut into those two pre-tokens
and the letters, lower-cased, go to the library's model; any other word goes through
the library's whole chain of normalizer, pre-tokenizer and model.
"""

from __future__ import annotations

import json
import os
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_texts, ship, slices, tokenizer_bytes

#: Words in the broadcast table; with words of at most MAX_WORD bytes it stays below 3 MB.
HOT_WORDS = 16_384
#: Words in the summary that a task hands on, and those it may hold meanwhile.
TASK_WORDS, TASK_LIVE = 4_096, 16_384
#: Longer words go straight to the tokenizer and are never kept.
MAX_WORD = 64
#: Words that a worker's cache may hold.
CACHE_WORDS = 300_000

#: ASCII and Latin-1 letters, then ASCII punctuation but the apostrophe (contractions are
#: pre-tokens of their own): two pre-tokens at most, which no normalization but lower case changes.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


def byte_characters() -> dict[int, str]:
    """The characters that byte-level tokenizers write for the bytes: printable ones for
    themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (between single spaces), the number of each word in order, and the
    number of words of each text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def _summary(batches):
    seen: Counter = Counter()
    for whole in batches:
        for part in slices(whole, "text"):
            words, at, _ = _split(part.column("text"))
            counts = np.bincount(at, minlength=len(words))
            # what is rare in a slice of thousands of texts is not frequent in the task
            for i in np.argsort(-counts, kind="stable")[:TASK_LIVE].tolist():
                seen[words[i]] += int(counts[i])
            if len(seen) > 4 * TASK_LIVE:
                seen = Counter(dict(seen.most_common(TASK_LIVE)))
    top = {w: n for w, n in seen.most_common(TASK_WORDS) if w and len(w) <= MAX_WORD}
    blob = zlib.compress(pickle.dumps(top), 1)
    yield pa.RecordBatch.from_arrays([pa.array([blob], type=pa.binary())], names=["summary"])


def _merge(a: bytes, b: bytes) -> bytes:
    both = Counter(pickle.loads(zlib.decompress(bytes(a))))
    both.update(pickle.loads(zlib.decompress(bytes(b))))
    return zlib.compress(pickle.dumps(dict(both.most_common(HOT_WORDS))), 1)


def frequent_words(docs: DataFrame, text: str = "text") -> list[str]:
    """At most HOT_WORDS of the most frequent words of all texts."""
    rows = docs.select(col(text).cast("string").alias("text"))
    summaries = rows.mapInArrow(_summary, "summary binary").rdd.map(lambda r: bytes(r[0]))
    if summaries.getNumPartitions() == 0:
        return []
    merged = summaries.treeReduce(_merge, depth=3)
    return [w for w, _ in sorted(pickle.loads(zlib.decompress(merged)).items(), key=lambda x: (-x[1], x[0]))]


_workers: dict = {}


def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(data)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Lengths:
    """Tokens of words, by the library."""

    def __init__(self, data: bytes):
        self.tok = _tokenizer(data)
        self.plain = self._clip_like(json.loads(data))
        self.map = byte_characters()
        self.cache: dict[str, int] = {}  # of whole words
        self.letters: dict[str, int] = {}  # of plain pre-tokens

    @staticmethod
    def _clip_like(spec: dict) -> bool:
        """Whether lower case is all that the chain does to words of letters and punctuation."""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = steps[0].get("pattern", {}).get("Regex", "") if steps and steps[0]["type"] == "Split" else ""
        last = bool(steps) and steps[-1]["type"] == "ByteLevel" and not steps[-1]["add_prefix_space"] and not steps[-1]["use_regex"]
        letters = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and last and split.endswith(letters) and split.startswith("'")

    def _token(self, pre: str) -> int:
        n = self.letters.get(pre)
        if n is None:
            if len(self.letters) > CACHE_WORDS:
                self.letters.clear()
            raw = pre if pre.isascii() else "".join(map(self.map.__getitem__, pre.encode()))
            n = len(self.tok.model.tokenize(raw))
            if len(pre) <= MAX_WORD:
                self.letters[pre] = n
        return n

    def of(self, words: list[str]) -> list[int]:
        out, rest = [], []
        for w in words:
            m = _PLAIN.fullmatch(w) if self.plain else None
            if m is None:
                rest.append(len(out))
                out.append(0)
            else:
                end = m[2]
                out.append(self._token(m[1].lower()) + (self._token(end) if end else 0))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, e in zip(some, self.tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = len(e)
        return out


def count_tokens(docs: DataFrame, tokenizer: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``n_tokens`` (long), as the tokenizers library counts the whole text.

    tokenizer: path of a tokenizer file whose normalizer and pre-tokenizer never join
    text across white space.  Null and empty texts have 0 tokens.  Repeated rows are
    counted each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    data = tokenizer_bytes(tokenizer)
    words = frequent_words(docs, text)
    hot = dict(zip(words, Lengths(data).of(words)))
    shared = spark.sparkContext.broadcast((data, hot))

    def make_kernel():
        data, hot = shared.value
        key = zlib.crc32(data)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(data)
        lengths_of = _workers[key]

        def kernel(texts):
            cache = lengths_of.cache
            words, at, lengths = _split(texts)
            sizes = [hot.get(w, -1) for w in words]
            lacking = [w for w, n in zip(words, sizes) if n < 0]
            new = [w for w in lacking if w not in cache]
            cache.update(zip(new, lengths_of.of(new)))
            sizes = [cache[w] if n < 0 else n for w, n in zip(words, sizes)]
            of = np.repeat(np.arange(len(lengths)), lengths)
            counts = np.bincount(of, weights=np.asarray(sizes, dtype=np.float64)[at] if len(at) else None, minlength=len(lengths))
            if len(cache) > CACHE_WORDS:  # the words of this batch stay, with them the frequent ones
                stay = {w: cache[w] for w in lacking if len(w) <= MAX_WORD}
                cache.clear()
                cache.update(stay)
            else:
                for w in new:
                    if len(w) > MAX_WORD:
                        del cache[w]
            return [pa.array(counts.astype(np.int64))]

        return kernel

    return map_texts(docs, make_kernel, [("n_tokens", T.LongType(), pa.int64())], keep, text, as_array=True)


def op1(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; cases as in
    ``count_tokens``."""
    sized = docs.select(col("doc_id"), col("text"), F.coalesce(F.octet_length(col("text")), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, tokenizer, keep=("doc_id", "n_bytes"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
