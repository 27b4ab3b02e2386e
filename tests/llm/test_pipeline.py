"""The pipeline against its stages by brute force."""

import hashlib
import struct
from collections import Counter

import pytest

pytest.importorskip("versewright.llm")
cp = pytest.importorskip("corpus_pipeline")

from test_operators import ODD, SCHEMA, dedup_brute, near_brute, rows  # noqa: E402
from versewright.llm import mixing, quality_rules  # noqa: E402
from versewright.llm.common import tokenizer_path  # noqa: E402


def brute(made):
    """(doc_id, ids) of the run's rows, in pure Python but for the rates' sums."""
    import math
    from collections import defaultdict

    import sentencepiece

    kept = []
    for r in made:
        *_, ok, _, cleaned = quality_rules.measure(r[1])
        if ok:
            kept.append((r[0], cleaned, r[3]))
    from test_operators import line_key

    holders = defaultdict(set)
    for i, t, _ in kept:
        for line in t.split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if len(line_key(x)) < 10 or min(holders[line_key(x)]) == i), s) for i, t, s in kept]
    near = near_brute(kept)
    kept = [r for r, (i, _, c) in zip(kept, near) if i == c]
    sizes = Counter()
    for _, t, s in kept:
        sizes[s] += len(t)
    total, weights = sum(sizes.values()), sum(math.sqrt(n) for n in sizes.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = Counter()
    for i, t, s in kept:
        rate = math.sqrt(sizes[s]) / weights * total / sizes[s] if sizes[s] else 1.0
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        steps = p
        while u >= steps:
            n += 1
            p *= rate / n
            steps += p
        ids = sp.encode(t, add_bos=True, add_eos=True)
        out[(i, s, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += n
    return +out


def test_run_matches_brute_force(spark, small):
    made = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert Counter(map(tuple, cp.run(spark, small).collect())) == brute(made)


def test_stages_keep_the_columns_and_take_odd_rows(spark, small):
    docs = spark.createDataFrame([r[:5] for r in rows(ODD)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (docs, docs.limit(0)):
        columns = docs.columns
        for at, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, small)
            docs.count()
            if at + 1 < len(cp.STAGES):
                assert docs.columns == columns


def test_line_stage_follows_the_operator(spark, small):
    made = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cp.lines(spark, made, small).collect()}
    assert got == {i: d for i, _, _, d in dedup_brute(made.collect())}
    assert all(r.n_chars == len(r.text) for r in cp.lines(spark, made, small).collect())
