"""Quality rules, line first.

Each line is tried against rules on punctuation, navigation and boilerplate; lines
that fail are removed; a document that loses too much of its text this way, or fails
the base rules on the whole text, is rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_texts

#: White space of the rules: space, tab, newline, vertical tab, form feed, return.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: A document is rejected if lines with more than this share of its characters fail.
MAX_LOSS = 0.4

_SENTENCE = re.compile(r"[.!?;:,…。！？،؟।]")
_TERMINAL = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*$")
_BOILERPLATE = re.compile(
    r"cookie(s)? policy|privacy policy|terms of (use|service)|enable javascript|all rights reserved|lorem ipsum"
    r"|click here|read more|sign (up|in)\b|log ?in\b|subscribe (to|now)|share (on|this)|follow us|skip to (main )?content"
    r"|back to top|previous post|next post|powered by",
    re.I,
)
_SEPARATOR = re.compile(r"\s[|»›•·>/]+(?=\s|$)")


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The name of the first rule that the line (with at least one word) fails."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= 3 and symbols * 4 > n:
        return "navigation" if len(_SEPARATOR.findall(line)) >= 3 else "symbols"
    if not _QUICK.isdisjoint(line) and n >= 4 and len(_SEPARATOR.findall(line)) * 4 > n:
        return "navigation"
    if n <= 25 and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5 and line.isupper():
        return "capitals"
    if n >= 10 and len(set(words)) * 10 < 3 * n:
        return "repetition"
    if not _SENTENCE.search(line):
        if n >= 12 or n <= 2:
            return "punctuation"
    elif n <= 2 and "." not in line and not _TERMINAL.search(line.rstrip(BLANK)):
        return "punctuation"
    return None


_QUICK = frozenset("|»›•·>/")


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that stand in some window found twice or more, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.array(list(map({}.setdefault, words, range(len(words)))), dtype=np.uint64)  # each word by its first place
    h, size = ids + np.uint64(1), 1
    while size < window:  # hashes of windows of 1, 2, 4, ... words
        h = h[:-size] * _FACTOR[size] + h[size:]
        size *= 2
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    a, b = order[1:][same], order[:-1][same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    if equal.all():
        starts = np.union1d(a, b)
    else:  # two windows share a hash: count the windows themselves
        count = Counter(tuple(ids[i : i + window].tolist()) for i in range(n))
        starts = np.array([i for i in range(n) if count[tuple(ids[i : i + window].tolist())] > 1], dtype=np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: Odd multipliers, one for each doubling; WINDOW is a power of two.
_FACTOR = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0x165667B19E3779F9)}


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, loss, cleaned)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set = set()
    dup = lost = 0
    stay = []
    for line, bare in zip(text.split("\n"), map(bytes.split, raw.split(b"\n"))):
        if bare:
            again = line in seen
            dup += again
            seen.add(line)
            if again or line_fails(line, bare):
                lost += len(line) - sum(map(line.count, BLANK))
                continue
        stay.append(line)
    n_words, repeated = len(words), repeat_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeated > 30 * n_words
    loss = lost / chars if chars else 0.0
    return n_words, chars, symbols, dup, repeated, base_failed, not base_failed and loss <= MAX_LOSS, loss, "\n".join(stay)


def apply_quality_rules(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``docs[keep]`` with the measures, ``base_failed``, ``kept``, ``loss`` (share of the
    word characters in lines that failed) and ``cleaned`` (the lines that stay).

    Null and empty texts have no words and so fail the base rules.  Lines without a
    word never fail.  Repeated rows are judged each; an empty table gives an empty
    result; columns outside ``keep`` are not read.
    """

    def make_kernel():
        return lambda texts: list(zip(*map(measure, texts)))

    long, arrow = T.LongType(), pa.int64()
    fields = [(n, long, arrow) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("base_failed", T.BooleanType(), pa.bool_()), ("kept", T.BooleanType(), pa.bool_())]
    fields += [("loss", T.DoubleType(), pa.float64()), ("cleaned", T.StringType(), pa.string())]
    return map_texts(docs, make_kernel, fields, keep, text)


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and loss of each row; cases as in ``apply_quality_rules``."""
    return apply_quality_rules(docs).drop("cleaned")


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with the cleaned text and its length in ``n_chars``.

    Null and empty texts have no words, so their rows go.  All other columns, null ids
    among them, stay as they are, whatever their names; repeated rows are judged each; an
    empty table gives an empty result.
    """
    numbered = {c: f"__{i}__" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[col(c).alias(n) for c, n in numbered.items()])
    judged = apply_quality_rules(rows, keep=[n for c, n in numbered.items() if c != "text"], text=numbered["text"]).filter("kept")
    made = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return judged.select(*[made.get(c, F.col(n)).alias(c) for c, n in numbered.items()])
