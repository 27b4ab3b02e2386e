"""Each operator against a brute-force version, over odd rows and the small tables."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("versewright.llm")

from versewright.llm import language, licenses, line_dedup, mixing, nearest, pieces, quality_model, quality_rules, simhash, token_counts  # noqa: E402
from versewright.llm.common import Scratch, sorted_buckets, tokenizer_bytes, tokenizer_path  # noqa: E402
from versewright.llm.sql import OP2_SQL  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, key int, `__text__` int, score int, a int"
WORDS = WPIECE = "the of and a licence thing Élan ÉTÉ naïve don't I'LL x1 22 !!! ... tail-end 日本 ☃".split()

ODD = [
    None, "", " ", "\n", "\n\n", "  lead", "trail ", "a  b   c", "▁mark▁ed ▁", "tab\tand\x0bvt\x0cff\rcr", "nbsp\xa0here em　id",
    "ctl\x1c\x1d\x1e\x1fsep", "<|endoftext|> and<|startoftext|>x", "<s> </s> <unk> <0x0A>", "É é ́ İ ß ﬁ Σίσυφος ΣΑΣ ǅ Ⅷ K", "it's 'S I'LL we'd ''d",
    "😀😀 \U0001f469‍\U0001f469 日本語テキスト", "123 45a6 7,8.9", "x" * 5000, "word " * 3000, "\x00nul\x00", "same line here\nsame line here\n other\nSAME LINE HERE  ",
    "All Rights Reserved. CC-BY cc by 4.0; GNU General Public License", "0123456789", "0123456789\n\t0123456789 ", "a b c", "a b c d", "a b c d e",
]


def rows(texts, first=0):
    langs = ["en", "de", None]
    return [(first + i, t, langs[i % 3], [None, "s1", "s1", "s2"][i % 4], len(t or ""), "clash", i, i, i, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    made = rows(ODD) + rows(ODD[20:24]) + [(None, "no id at all, a line\nsame line here", "en", "s1", 3, "c", 1, 1, 1, 1)] * 2
    return made, spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    return df.collect(), df


def bag(found):
    return Counter(map(tuple, found))


def digest(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- tokens --------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts_match_the_library(which, request):
    from tokenizers import Tokenizer

    made, df = request.getfixturevalue(which)
    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = bag((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in made)
    assert bag(token_counts.op1(df, path).collect()) == want


def test_token_counts_of_an_unknown_chain_use_the_library(spark, odd):
    from tokenizers import Tokenizer

    made, df = odd
    data = tokenizer_bytes(tokenizer_path("word_bpe_49k.json"))
    lengths = token_counts.Lengths(data)
    words = [w for t in ODD if t for w in t.split(" ")]
    quick = lengths.of(words)
    lengths.plain = False
    assert lengths.of(words) == quick
    assert Tokenizer.from_buffer(data).get_vocab_size() > 0


def test_token_counts_of_an_empty_table(empty):
    assert token_counts.op1(empty, tokenizer_path("word_bpe_49k.json")).collect() == []


# -- sentencepiece -------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_sentencepiece_matches_the_library(which, request):
    import sentencepiece

    made, df = request.getfixturevalue(which)
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for r in made:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(sp.decode(ids))))
    assert bag(pieces.op8(df, path).collect()) == bag(want)


def test_sentencepiece_random_spacing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "TABLE_WORDS", 5)  # so that the table is cut back all the time
    table = pieces.WordTable(tokenizer_bytes(tokenizer_path("piece_bpe_32k.model")))
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "▁", "a", "be", "\n", "é", "日", "!", "word"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    n, ids, back = (x.to_pylist() for x in table.encode(pa.array(texts)))
    for i, t in enumerate(texts):
        want = table.sp.encode(t, add_bos=True, add_eos=True)
        assert (n[i], ids[i], back[i]) == (len(want), struct.pack(f"<{len(want)}I", *want), table.sp.decode(want))


def test_sentencepiece_of_an_empty_table(empty):
    assert pieces.op8(empty, tokenizer_path("piece_bpe_32k.model")).collect() == []


# -- line dedup ----------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dedup_brute(made):
    holders = defaultdict(set)
    for r in made:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(line_key(line)) >= 10:
                    holders[line_key(line)].add(r[0])
    out = []
    for r in made:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if r[0] is None or len(line_key(x)) < 10 or min(holders[line_key(x)]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(stay), digest("\n".join(stay))))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_line_dedup(which, request):
    made, df = request.getfixturevalue(which)
    assert bag(line_dedup.op2(df).collect()) == bag(dedup_brute(made))


@pytest.mark.parametrize("hot", [1, line_dedup.HOT_SHARE])
def test_line_dedup_levels_and_repeats(spark, monkeypatch, hot):
    """With a share of 1 no key is hot, so all go through the runs."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    rng = random.Random(5)
    lines = [f"shared line number {i}" for i in range(40)] + ["short", "", "ÉCOLE normale supérieure", "École normale supérieure", "  SHARED line NUMBER 1\t"]
    made = rows(["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(120)])
    made += made[3:6] + [(7, "another text of the same id\nshared line number 2", "en", "s", 1, "c", 1, 1, 1, 1)]
    df = spark.createDataFrame(made, SCHEMA)
    for batches in (1, 9):
        scratch = Scratch(spark, "test")
        got = line_dedup.dedup_lines(df.select("doc_id", "text"), scratch, batches=batches)
        assert bag((r.doc_id, r.n_lines, r.n_dropped, digest(r.text)) for r in got.collect()) == bag(dedup_brute(made))


def long_lines(spark, ids):
    return line_dedup.line_hashes(spark.createDataFrame([(i, f"a line that is long enough {i % 5}") for i in ids], "doc_id bigint, text string"))


def test_line_runs_are_compacted(spark):
    store = line_dedup.LineRuns(Scratch(spark, "test"), fanout=2)
    dropped = [{r.doc_id for r in store.ingest(long_lines(spark, range(k, k + 3))).collect()} for k in (0, 3, 6, 9)]
    assert dropped == [set(), {5}, {6, 7, 8}, {9, 10, 11}]
    assert [len(level) for level in store.levels] == [0, 0, 1]
    assert store.levels[2][0].count() == 5
    store.clear()
    assert store.levels[2][0].count() == 5


def test_line_runs_are_merged_without_exchange_or_sort(spark):
    store = line_dedup.LineRuns(Scratch(spark, "test"), fanout=4)
    for k in range(0, 9, 3):
        store.ingest(long_lines(spark, range(k, k + 3)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = long_lines(spark, range(9, 12)).groupBy("a", "b").count()
    with sorted_buckets(spark):
        batch = store.scratch.save_buckets(keys, "batch", ["a", "b"], store.buckets)
        joined, merged = plan(store.fresh(batch)), plan(store._merged(store.runs()))
    assert joined.count("SortMergeJoin") == 3 and "LeftAnti" in joined
    assert "Exchange" not in joined and "Sort [" not in joined
    assert "Exchange" not in merged


def test_line_held_by_most_rows(spark, monkeypatch):
    """A line of nine documents in ten is looked up in a broadcast table."""
    asked, frequent = [], line_dedup.frequent_keys
    monkeypatch.setattr(line_dedup, "frequent_keys", lambda *a: (asked.append(frequent(*a)), asked[-1])[1])
    made = rows([("one line that almost every document has\n" * (1 + i % 3) if i % 10 else "") + f"and one of its own, number {i}" for i in range(3000)])
    df = spark.createDataFrame(made, SCHEMA)
    assert bag(line_dedup.op2(df).collect()) == bag(dedup_brute(made))
    key = df.select(F.xxhash64(F.lit("one line that almost every document has")).alias("a")).first().a
    assert key in {r.a for r in frequent(line_dedup.line_hashes(df), 6000).collect()} and len(asked) == 1


@pytest.mark.parametrize("query", [line_dedup.op2, line_dedup.deduped_documents])
def test_line_dedup_of_a_table_compacts(docs, monkeypatch, query):
    stores, init = [], line_dedup.LineRuns.__init__
    monkeypatch.setattr(line_dedup.LineRuns, "__init__", lambda self, *a, **b: (init(self, *a, **b), stores.append(self))[0])
    query(docs[1])
    (store,) = stores
    assert len(store.levels) > 1 and all(len(level) > 0 for level in store.levels)  # one of them compacted


def test_line_dedup_of_an_empty_table(empty):
    assert line_dedup.op2(empty).collect() == []
    assert line_dedup.deduped_documents(empty).columns == empty.columns


def test_line_dedup_sql(spark, small, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert bag(con.sql(OP2_SQL).fetchall()) == bag(line_dedup.op2(docs[1]).collect())


# -- simhash -------------------------------------------------------------------------


def simhash_brute(text, size=4):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_brute(points, distance=4):
    points = sorted(points)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    x = np.array(points, dtype=np.uint64)
    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= distance):
            a, b = find(p), find(points[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def near_brute(made):
    fps = [(r[0], simhash_brute(r[1])) for r in made]
    root = components_brute({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f"{f:016x}", least.get(root[f])) for i, f in fps]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, request):
    made, df = request.getfixturevalue(which)
    assert bag(simhash.op5(df).collect()) == bag(near_brute(made))


@pytest.mark.parametrize(("dense", "equal"), [(4, 2), (512, 2), (512, 3)])
def test_links_of_planted_fingerprints(spark, dense, equal):
    """Chains, dense balls and far points: components as by all pairs."""
    rng = random.Random(dense)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        p = rng.getrandbits(64)
        for _ in range(60):  # a chain of steps of four bits
            for b in rng.sample(range(64), 4):
                p ^= 1 << b
            points.add(p)
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    points |= {0, 1, (1 << 64) - 1, 1 << 63, 0x1F, 0x3F}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in points], "fp bigint").repartition(5)
    want = components_brute(points)
    classes = lambda of: {frozenset(g) for g in _groups(of).values() if len(g) > 1}
    for tile in (16_384, 37):  # with the smaller, many cells are cut
        scratch = Scratch(spark, "test")
        got = {r.node: r.root for r in simhash.components(simhash.link_forest(df, scratch, equal=equal, dense=dense, tile=tile), scratch).collect()}
        assert classes(got) == classes({signed(a): signed(b) for a, b in want.items()})


#: 100,000 pass as well, in three minutes on eight cores.
HOT_POINTS = 16_000


def test_links_of_a_hot_cell(spark):
    """Points with one embedding, so in one cell of every grid: pairs of bits 01 or
    10, of which links change two or four at a time."""
    rng = np.random.default_rng(12)
    flips = np.unique(rng.integers(0, 1 << 32, HOT_POINTS, dtype=np.uint64))
    spread = np.zeros(len(flips), dtype=np.uint64)
    for k in range(32):
        spread |= np.where(flips >> np.uint64(k) & np.uint64(1), np.uint64(2), np.uint64(1)) << np.uint64(2 * k)
    df = spark.createDataFrame([(int(x),) for x in spread.view(np.int64)], "fp bigint").repartition(8)
    scratch = Scratch(spark, "test")
    edges = scratch.save(simhash.link_forest(df, scratch, tile=4_096), "edges")
    got = {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    label, have = np.arange(len(flips)), {int(f): i for i, f in enumerate(flips)}

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    masks = [1 << a | 1 << b for a in range(32) for b in range(a)] + [1 << a for a in range(32)]  # two bits of a segment differ, or four of two
    at = np.searchsorted(flips, flips[None, :] ^ np.array(masks, dtype=np.uint64)[:, None])
    hit = flips[np.minimum(at, len(flips) - 1)] == flips[None, :] ^ np.array(masks, dtype=np.uint64)[:, None]
    for m, i in zip(*np.nonzero(hit)):
        a, b = find(i), find(at[m, i])
        label[max(a, b)] = min(a, b)
    want = {int(x): find(i) for i, x in enumerate(spread.view(np.int64))}
    classes = lambda of: {frozenset(g) for g in _groups(of).values() if len(g) > 1}
    assert have and classes(got) == classes(want) != set()


def test_forests_have_no_hubs():
    label = np.array([0] * 5000 + [5000] + [5001] * 3)
    u, v = simhash._tree(label)
    assert len(u) == 4999 + 2 and max(Counter(v.tolist()).values()) <= simhash.FAN
    assert len(set(simhash._forest(len(label), u, v))) == 3


def test_embedding_distance_is_manhattan_and_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, 300, dtype=np.uint64) for _ in range(2))
    segments = lambda x: np.array([[bin(int(p) >> (2 * k) & 3).count("1") for k in range(32)] for p in x])
    manhattan = np.abs(segments(a) - segments(b)).sum(axis=1)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_grids_grow_with_the_points():
    assert [simhash.groups_equal(n) for n in (0, 10**6, 10**9, 10**11)] == [2, 2, 4, 4]


def test_simhash_of_a_text_that_most_rows_have(spark):
    """Copies, blank texts among them, hold most rows: they are one point each."""
    rng = random.Random(7)
    texts = ["one text that is copied very often, word for word"] * 900 + [" "] * 600 + [" ".join(rng.choices(WORDS, k=40)) for _ in range(100)]
    made = rows(texts)
    assert bag(simhash.op5(spark.createDataFrame(made, SCHEMA)).collect()) == bag(near_brute(made))


def _groups(of):
    out = defaultdict(set)
    for k, v in of.items():
        out[v].add(k)
    return out


def test_walk_and_forest_agree():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1
    i, j = np.nonzero(np.triu(near, 1))
    a, b = simhash._forest(len(fp), i, j), simhash._walk(fp, 1)
    assert {frozenset(np.flatnonzero(a == k)) for k in set(a)} == {frozenset(np.flatnonzero(b == k)) for k in set(b)}


@pytest.mark.parametrize("groups", [6, 7, 8])
def test_segments_bound_the_distance(groups):
    masks = simhash.group_masks(groups)
    assert sum(masks) == (1 << 64) - 1 and len(masks) == groups and all(m & n == 0 for m in masks for n in masks if m != n)


def test_one_of_each(spark, odd, empty):
    made, df = odd
    kept = simhash.one_of_each(df).collect()
    root = components_brute({simhash_brute(r[1]) for r in made})
    classes = defaultdict(list)
    for r in made:
        classes[root[simhash_brute(r[1])]].append(r)
    assert len(kept) == len(classes)
    assert {r.doc_id for r in kept} == {min((r[0] for r in g if r[0] is not None), default=None) for g in classes.values()}
    assert simhash.one_of_each(empty).collect() == [] and simhash.op5(empty).collect() == []


# -- quality rules -------------------------------------------------------------------


def quality_brute(text):
    raw = (text or "").encode().split()
    words = [w.decode() for w in raw]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    at = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(at) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(at), failed


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_rules_base(which, request):
    made, df = request.getfixturevalue(which)
    got = quality_rules.op7(df)
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(base.collect()) == bag((r[0], *quality_brute(r[1])) for r in made)
    assert got.filter("kept and base_failed").count() == 0


def test_quality_rules_keep_clean_and_reject_junk(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.op7(docs).filter("not base_failed").join(labels, "doc_id").toPandas()
    clean, junk = judged[judged.quality == 1], judged[judged.quality == 0]
    assert clean.kept.mean() == 1.0
    assert junk.kept.mean() < 0.6


def test_quality_lines():
    fails = lambda x: quality_rules.line_fails(x, x.encode().split())
    assert fails("Home | About | Contact | Help") == "navigation"
    assert fails("this*** has### too%%% many$$$") == "symbols"
    assert fails("Read our cookie policy.") == "boilerplate"
    assert fails("THIS LINE IS ALL SHOUTED!! AT YOU!!") == "capitals"
    assert fails("no no no no no no no no no no no no.") == "repetition"
    assert fails("Menu") == "punctuation"
    assert fails("A proper sentence, as it should be.") is None
    assert fails("It.") is None


def test_repeat_words_overlaps():
    words = "a b c d e f g h".split() * 3 + ["z"]
    assert quality_rules.repeat_words(words) == 24
    assert quality_rules.repeat_words(words[:8]) == 0 and quality_rules.repeat_words([]) == 0


def test_quality_rules_of_an_empty_table(empty):
    assert quality_rules.op7(empty).collect() == [] and quality_rules.cleaned_documents(empty).columns == empty.columns


# -- licenses ------------------------------------------------------------------------

WORD = set("0123456789abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in WORD or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def license_base(text):
    words = license_words(text)
    found = {}
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            found[label] = at
    every = sorted(x for at in found.values() for x in at)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(found))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_licenses_base(which, request):
    made, df = request.getfixturevalue(which)
    got = licenses.op4(df).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == bag((r[0], *license_base(r[1])) for r in made)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_rules():
    labels = lambda t: licenses.scan(t)[5].split(",")
    assert len(licenses.rules()) > 200
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0", "licensed-under"]
    assert "mit" in labels("Released under the MIT License") and "bsd-3-clause" in labels("the 3-Clause BSD license")
    assert labels("CC BY-NC-SA 4.0") == ["cc-by", "cc-by-nc-sa-4.0"]
    assert "gpl-2-or-later" in labels("GNU General Public License version 2 or any later version")
    assert licenses.scan("nothing of the kind")[5] == ""


def test_license_gates_lose_nothing(docs):
    """Every rule's matches, tried without keywords, are those with them."""
    every = set(licenses._gates()[0])
    for r in docs[0] + [[0, t] for t in ODD]:
        words = [w.encode() for w in license_words(r[1])]
        hits = every.intersection(words)
        assert {(d.label, d.first) for d in licenses.detect(words, hits)} == {(d.label, d.first) for d in licenses.detect(words, every)}


def license_samples(parsed):
    """Texts of every alternative of a parsed pattern; repeats up to two, of a range its ends."""
    out = [b""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                made = [bytes([arg])]
            case "IN":
                made = [bytes([x]) for kind, a in arg for x in ([a] if str(kind) == "LITERAL" else a)]
            case "BRANCH":
                made = [x for branch in arg[1] for x in license_samples(branch)]
            case "SUBPATTERN":
                made = license_samples(arg[3])
            case "MAX_REPEAT":
                least, most, of = arg
                each = license_samples(of)
                made = [b"".join(x) for n in range(least, max(least, min(int(most), 2)) + 1) for x in itertools.product(each, repeat=n)]
            case "ASSERT_NOT":
                made = [b""]
        out = [a + b for a in out for b in dict.fromkeys(made)]
    return out


def test_license_gates_hold_in_every_alternative():
    every = set(licenses._gates()[0])
    rng = random.Random(0)
    for rule in licenses.rules():
        samples = license_samples(re._parser.parse(rule.pattern.pattern))
        assert all(rule.pattern.fullmatch(s) for s in samples)
        assert [s for s in samples if not set(rule.keywords).intersection(s.split(b" "))] == [], rule.label
        for s in rng.sample(samples, min(20, len(samples))):
            words = [b"some", *s.split(b" "), b"text"]
            assert licenses.detect(words, every.intersection(words)) == licenses.detect(words, every) != []


def test_license_names_without_their_short_form():
    labels = lambda t: licenses.scan(t)[5].split(",")
    for text, label in (
        ("Berkeley Software Distribution", "bsd"), ("the Open Font License", "ofl"), ("Open Font License 1.1", "ofl-1.1"), ("Q Public License", "qpl"),
        ("Computational Use of Data Agreement", "data-c-uda"), ("Community Data License Agreement - Sharing", "cdla-sharing"), ("Licence Ouverte", "etalab"),
        ("trade secrets of", "trade-secret"), ("must not be republished", "no-redistribution"), ("in no event shall", "liability"), ("GPLed license", "gpl"),
        ("Open Software License 3.0", "osl-3.0"), ("Business Source License 1.1", "busl-1.1"), ("MPLv2.0", "mpl-2.0"), ("LGPL2.1 only", "lgpl-2.1-only"),
    ):
        assert label in labels(text) and licenses.scan(text)[6] > 0


def test_suppression():
    d = licenses.Detection
    a, b, c = d("whole", 0, 9, 50, 1.0), d("inside", 2, 4, 50, 1.0), d("across", 8, 12, 20, 1.0)
    assert licenses.suppress([c, b, a]) == [a, c]
    assert licenses.suppress([d("low", 0, 9, 10, 1.0), d("high", 2, 3, 90, 1.0)]) == [d("high", 2, 3, 90, 1.0), d("low", 0, 9, 10, 1.0)]


def license_brute(text):
    """(labels, score) with every rule tried on every text and every pair of detections compared."""
    words = license_words(text)
    line = " ".join(words).encode()
    found = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(line):
            first = line[: m.start()].count(b" ")
            found.append((rule.label, first, first + m.group().count(b" "), rule.priority, rule.confidence))
    before = lambda e, d: (-e[3], e[1] - e[2], e[1], e[0]) < (-d[3], d[1] - d[2], d[1], d[0])
    stay = [d for d in found if not any(before(e, d) and e[1] <= d[1] and d[2] <= e[2] for e in found)]
    base = license_base(text)[4]
    labels = {d[0] for d in stay} | set(filter(None, base.split(",")))
    return ",".join(sorted(labels)), max([d[4] for d in stay] + [0.7] * bool(base), default=0.0)


def test_license_labels_by_brute_force(docs):
    rng = random.Random(1)
    of_rules = [license_samples(re._parser.parse(rule.pattern.pattern)) for rule in licenses.rules()]
    samples = [s.decode() for every in of_rules for s in rng.sample(every, min(2, len(every)))]
    texts = [r[1] for r in docs[0]][:60] + ODD[:10] + ODD[-8:]
    texts += ["; ".join(rng.choices([*samples, "some other words", "version 2 only"], k=8)) for _ in range(80)]
    for t in texts:
        got = licenses.scan(t)
        assert (got[5], got[6]) == license_brute(t)


def test_licenses_of_an_empty_table(empty):
    assert licenses.op4(empty).collect() == []


# -- language ------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op10(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, empty):
    made, df = odd
    got = language.op10(df).collect()
    assert len(got) == len(made)
    letters = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in made)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert {r.lang_pred for r in got} <= {"und", "en", "de"} and all((r.score == 0) == (r.lang_pred == "und") for r in got)
    assert language.op10(empty).collect() == []
    unlabelled = df.withColumn("lang", df["lang"].substr(1, 0)).filter("lang is null")
    assert {r.lang_pred for r in language.op10(unlabelled).collect()} == {"und"}


def test_language_rare_among_many(spark):
    """Of 40,001 labelled documents one is of another language: it is learned and predicted."""
    common = spark.range(40_000).selectExpr("id as doc_id", "concat('the words of a plain text ', id) as text", "'en' as lang")
    for rare in (40_001, 40_002, 40_003):
        one = spark.createDataFrame([(rare, "ψηφία και γράμματα", "el")], "doc_id bigint, text string, lang string")
        model = language.fit(common.unionByName(one))
        assert model.langs == ["el", "en"]
        assert model.predict(["γράμματα", "plain words"])[0] == ["el", "en"]


def test_language_counts_of_many_languages(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(language, "HELD_LANGS", 2)
    made = [(f"l{i % 5}", f"text number {i} of several") for i in range(40)]
    got, want = Counter(), Counter()
    for batch in language._count([pa.RecordBatch.from_pylist([{"lang": a, "text": t} for a, t in made])]):
        for row in batch.to_pylist():
            got[row["lang"], row["bucket"]] += row["n"]
    for a, t in made:
        want[a, -1] += 1
        want.update((a, x) for x in gram_buckets(t))
    assert got == want


def gram_buckets(text):
    """The buckets of a text's 1-, 2- and 3-grams, one by one."""
    codes = [ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in f" {text.lower()} "]
    m, out = (1 << 32) - 1, []
    for i, x in enumerate(codes):
        a = [c * 0x9E3779B1 & m for c in codes[i : i + 3]]
        out.append(a[0] >> 32 - language.BITS)
        if len(a) > 1:
            b = [((p ^ p >> 15) * 0x85EBCA77 + q) & m for p, q in zip(a, a[1:])]
            out.append((b[0] * 0xC2B2AE3D & m) >> 32 - language.BITS)
            if len(a) > 2:
                c = ((b[0] ^ b[0] >> 13) * 0x27D4EB2F + a[2]) & m
                out.append((c * 0x165667B1 & m) >> 32 - language.BITS)
    return out


@pytest.mark.parametrize(("block", "cells"), [(1 << 18, 1 << 23), (7, 1 << 23), (1 << 18, 1000)])
def test_language_naive_bayes_by_brute_force(spark, monkeypatch, block, cells):
    """Priors, log-probabilities and posteriors of short and odd texts; with small blocks, and few buckets."""
    monkeypatch.setattr(language, "BLOCK", block)
    made = [("en", "the words and the things"), ("en", "a thing"), ("de", "das Wort und der Baum"), ("el", "τα γράμματα"), ("en", ""), (None, "no label"), ("de", None)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(made)], "doc_id bigint, text string, lang string")
    model = language.fit(df, cells=cells)
    buckets = language.BUCKETS >> model.shift
    assert model.langs == ["de", "el", "en"] and 3 * buckets <= cells
    counts = {x: Counter(b >> model.shift for k, t in made if k == x and t for b in gram_buckets(t)) for x in model.langs}
    prior = {"de": 1 / 4, "el": 1 / 4, "en": 2 / 4}
    asked = [t for t in ODD if t and len(t) < 1000] + [t for _, t in made if t]
    for t, label, score in zip(asked, *model.predict(asked)):
        if not any(c.isalpha() for c in t):
            assert (label, score) == ("und", 0.0)
            continue
        logs = {x: np.log(prior[x]) + sum(np.log((counts[x][b >> model.shift] + 0.5) / (counts[x].total() + 0.5 * buckets)) for b in gram_buckets(t)) for x in model.langs}
        share = {x: 1 / sum(np.exp(y - logs[x]) for y in logs.values()) for x in logs}
        assert abs(score - share[label]) < 1e-3 and share[label] > max(share.values()) - 1e-3


def test_language_letters():
    assert not any(map(language.has_letter, ["", "² ½ ① Ⅷ", "12 _ 3", "...", "\u0301", "😀"]))
    assert all(map(language.has_letter, ["²a", "ʰ", "日", "ª", "é"]))
    model = language.Model(["en"], np.zeros((language.BUCKETS, 1), dtype=np.float32), np.zeros(1))
    assert model.predict(["² ½ ①", "Ⅷ", "x", None]) == (["und", "und", "en", "und"], [0.0, 0.0, 1.0, 0.0])


def test_language_blocks_add_up(monkeypatch):
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = ["some words and others " * 400, "x", None, "", "more of them"]
    whole = model.log_odds(texts)
    monkeypatch.setattr(language, "BLOCK", 100)
    assert np.allclose(whole, model.log_odds(texts), atol=1e-6)
    assert np.allclose(whole[4], model.log_odds(texts[4:])[0])


def test_language_ignores_clashing_columns(docs):
    clash = docs[1].withColumns({c: F.lit("x") for c in ("held_out", "lang_pred", "score", "bucket", "n", "a.b")})
    assert bag(language.op10(clash).collect()) == bag(language.op10(docs[1]).collect())


# -- mixing --------------------------------------------------------------------------


def test_mixing_sql(spark, small, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert bag(con.sql(mixing.OP9_SQL).fetchall()) == bag(mixing.op9(docs[1]).collect())


def test_mixing_weights_and_counts(spark):
    made = [(i, "x" * 10, "big" if i % 10 else "rare") for i in range(4000)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    out = mixing.mix(df, {"big": 1.0, "rare": 1.0}).toPandas()
    share = out.source.value_counts(normalize=True)
    assert abs(share["rare"] - 0.5) < 0.05
    counts = Counter(out[out.source == "rare"].doc_id)
    assert abs(np.mean([counts.get(i, 0) for i, _, s in made if s == "rare"]) - 5) < 0.4
    for i, n in list(counts.items())[:50]:
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p, total, k = np.exp(-5.0), 0.0, 0
        while True:
            total += p
            if u < total:
                break
            k += 1
            p *= 5.0 / k
        assert n == k
    assert mixing.mix(df, {"big": 1.0}).filter("source = 'rare'").count() == 0


def test_poisson_steps_of_large_rates(spark):
    rates = [("a", 0.0), ("b", 1e-3), ("c", 4.5), (None, 900.0), ("e", 2.5e6)]
    df = spark.createDataFrame(rates, "source string, rate double")
    made = {r.source: r for r in mixing.poisson_steps(df).collect()}
    assert len(made) == 5 and made["a"].steps == [1.0] and made["a"].low == 0
    for name, rate in rates[1:]:
        r = made[name]
        assert abs(r.steps[-1] - 1) < 1e-7 and all(a <= b for a, b in zip(r.steps, r.steps[1:]))
        assert len(r.steps) < 2 * 12 * np.sqrt(rate) + 60
        # half of the distribution lies below its mean
        at = next(k for k, x in enumerate(r.steps) if x >= 0.5)
        assert abs(r.low + at - rate) <= 1
    p, total = np.exp(-4.5), 0.0
    for k, x in enumerate(made["c"].steps):
        total += p
        assert abs(x - total) < 1e-12
        p *= 4.5 / (k + 1)


def test_steps_below_is_a_count(spark):
    steps = [0.1, 0.1, 0.4, 0.9, 1.0]
    for n in (0, 1, 2, 5):
        df = spark.createDataFrame([(steps[:n], u) for u in (0.0, 0.05, 0.1, 0.3, 0.95, 1.0, 2.0)], "s array<double>, u double")
        for r in df.select("s", "u", mixing.steps_below(F.col("s"), F.col("u")).alias("n")).collect():
            assert r.n == sum(x <= r.u for x in r.s)


def test_mixing_sql_of_a_tiny_source(spark, tmp_path):
    """Documents of a tiny source repeat over a thousand times, in Spark and in SQL."""
    made = [(i, "x" * 100_000, "big") for i in range(600)] + [(1000 + i, "tiny", "small") for i in range(3)] + [(2000, "of no source", None), (2001, None, "blank")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = bag(mixing.op9(df).collect())
    assert bag(con.sql(mixing.OP9_SQL).fetchall()) == got
    copies = Counter(r[0] for r in got)
    assert all(copies[1000 + i] > 1000 for i in range(3)) and copies[2000] > 200


def test_mixing_through_a_shuffled_table(docs, monkeypatch):
    """As when the table of distributions is too large to be broadcast; most rows have one source."""
    df = docs[1].withColumn("source", F.when(F.col("doc_id") % 10 > 1, F.lit("most")).otherwise(F.col("source")))
    want = bag(mixing.op9(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert bag(mixing.op9(df).collect()) == want


def test_mixing_odd_rows(odd, empty):
    made, df = odd
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and 0 < out.count() < 10 * len(made)
    assert mixing.op9(empty).collect() == []


# -- quality model -------------------------------------------------------------------


def test_classifier_auc_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_model.op3(docs, labels)
    got = judged.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    assert judged.count() == docs.count()
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out)) and len(held) > 500
    good, bad = held[held.y == 1].quality.to_numpy(), held[held.y == 0].quality.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert held[held.y == 1].kept.mean() > 0.98


def test_classifier_learns_from_words_alone(spark):
    """Labels that only words tell apart: lengths, signs and shapes are the same."""
    rng = random.Random(4)
    good, bad = ("river stone cloud amber maple".split(), "money prize click bonus lucky".split())
    made = [(i, " ".join(rng.choices(good if i % 2 else bad, k=30)) + ".") for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in made], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in made], "doc_id bigint, quality int, toxic int")
    got = quality_model.op3(df, labels).filter("held_out").collect()
    assert len(got) > 40 and all(r.kept == bool(r.doc_id % 2) for r in got)


def test_grams_match_their_definition():
    texts = ["Two words", None, "", "É x", "a  b\tc\n", "same same same"]
    rng = np.random.default_rng(3)
    ratios = rng.normal(size=(quality_model.KINDS, quality_model.BUCKETS)).astype(np.float32)
    got = quality_model.features(texts, ratios)[:, -quality_model.KINDS :]
    one = [quality_model.features([t], ratios)[0, -quality_model.KINDS :] for t in texts]
    assert np.allclose(got, one) and (got[1] == 0).all() and (got[2] == 0).all()

    def bucket(h):
        return (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - quality_model.BITS)

    for t, (word, pair, gram) in zip(texts, got):
        raw = bytes(quality_model._FOLD[np.frombuffer((t or "").encode(), dtype=np.uint8)])
        words = [sum(c * pow(0x100000001B3, k + 1) for k, c in enumerate(w)) & (1 << 64) - 1 for w in re.split(rb"[\x00-\x20]+", raw) if w]
        mean = lambda kind, hs: np.mean([ratios[kind][bucket(h)] for h in hs]) if hs else 0.0
        assert np.isclose(word, mean(0, words))
        assert np.isclose(pair, mean(1, [(a * 0x9E3779B97F4A7C15 + b) & (1 << 64) - 1 for a, b in zip(words, words[1:])]))
        ended = raw + b" " if raw else raw  # a space ends each text
        assert np.isclose(gram, mean(2, [int.from_bytes(ended[i : i + 4], "little") for i in range(len(ended) - 3)]))


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = "some words of a text " * 2000
    sizes = [len(block) for block in map(list, quality_model.gram_blocks([text] * 3 + ["x"]))]
    assert sizes == [quality_model.KINDS] * len(sizes)
    monkeypatch.setattr(quality_model, "BLOCK", 1000)
    blocks = [list(b) for b in quality_model.gram_blocks([text])]
    assert len(blocks) == -(-len(text) // 1000) and all(len(x) <= 1001 for b in blocks for x, _ in b)


def nested_brute(scored):
    """Mean, strength of hosts, strength of paths from (host, path, p), by loops over groups."""
    of_path, of_host = defaultdict(list), defaultdict(list)
    for h, q, p in scored:
        of_path[h, q].append(p)
        of_host[h].append(p)
    every = [p for *_, p in scored]
    n = len(every)

    def strength(groups, parent, weight, degrees):
        within = max(sum((p - np.mean(g)) ** 2 for g in groups.values() for p in g) / (n - len(groups)), 1e-9)
        between = sum(len(g) * (np.mean(g) - parent(k)) ** 2 for k, g in groups.items())
        variance = (between - degrees * within) / (n - weight)
        return min(max(within / max(variance, 1e-12), 0.1), 1e6)

    host = strength(of_host, lambda k: np.mean(every), sum(len(g) ** 2 for g in of_host.values()) / n, len(of_host) - 1)
    path = strength(of_path, lambda k: np.mean(of_host[k[0]]), sum(len(g) ** 2 / len(of_host[k[0]]) for k, g in of_path.items()), len(of_path) - len(of_host))
    return np.mean(every), host, path


def test_posteriors_and_quality_by_brute_force(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality_model.op3(docs[1], labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in docs[0])
    mean, kh, kp = nested_brute([(r.host, r.path, r.p_doc) for r in got])
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        host = [x.p_doc for x in got if x.host == r.host and x is not r]
        path = [x.p_doc for x in got if (x.host, x.path) == (r.host, r.path) and x is not r]
        p_host = (kh * mean + sum(host)) / (kh + len(host))
        p_path = (kp * p_host + sum(path)) / (kp + len(path))
        quality = 1 / (1 + np.exp(-(logit(r.p_doc) + logit(p_path) - logit(mean))))
        assert np.allclose((r.p_host, r.p_path, r.quality), (p_host, p_path, quality), rtol=1e-6)
        assert r.kept == (r.quality >= 0.5)


def test_paths_that_do_not_differ_shrink_to_their_host(spark):
    """However much hosts differ, equal paths within them get a strength that leaves nothing of their own."""
    noise = np.random.default_rng(2).normal(size=100) * 0.02  # the same in each path

    def of(path_moves):
        made = [(i, f"h{i % 4}", f"p{i % 3}", float(0.2 * (i % 4) + path_moves * (i % 3) + noise[i // 12])) for i in range(1200)]
        df = spark.createDataFrame(made, "doc_id bigint, host string, path string, p double")
        sites, at = quality_model.posteriors(df, Scratch(spark, "test"), "host", "path")
        want = nested_brute([m[1:] for m in made])
        assert np.allclose((at["mean"], at["host"], at["path"]), want, rtol=1e-6) and sites.count() == 12
        return at

    equal, unequal = of(0.0), of(0.1)
    assert equal["host"] < 1 and equal["path"] > 1000
    assert unequal["path"] < 1


def test_classifier_odd_rows(spark, odd, empty):
    made, df = odd
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_model.op3(df, labels).count() == len(made)
    assert quality_model.op3(df, labels.limit(0)).filter("quality is null").count() == 0
    assert quality_model.op3(empty, labels).collect() == []


def test_classifier_ignores_clashing_columns(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clash = docs[1].withColumns({c: F.lit(0.5) for c in ("host", "path", "p", "quality", "y", "fold", "n", "s", "a.b")})
    assert bag(quality_model.op3(clash, labels.withColumn("text", F.lit("x"))).collect()) == bag(quality_model.op3(docs[1], labels).collect())


def test_training_takes_one_text_of_an_id(spark):
    rows = [(i % 4, f"text {i}", "en", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] * 2, "doc_id bigint, quality int, toxic int")
    got = quality_model.training_rows(df, labels).collect()
    assert Counter(r.doc_id for r in got) == {i: 1 for i in range(4) if zlib.crc32(str(i).encode()) % 5} and all(r.text == min(t for i, t, *_ in rows if i == r.doc_id) for r in got)


# -- nearest neighbours --------------------------------------------------------------


def nearest_brute(made, k=5, every=50):
    fine = {(i, tuple(v)) for i, v in made if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    fine = sorted(fine)
    x = np.array([v for _, v in fine], dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for at, (i, _) in enumerate(fine):
        if i % every == 0:
            s = (x * x[at]).sum(axis=1) / (n * n[at])
            out[i] = sorted([(-s[j], fine[j][0]) for j in range(len(fine)) if fine[j][0] != i])[:k]
    return out


def test_nearest_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = defaultdict(list)
    for r in nearest.op6(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert sorted(found, key=lambda f: (-f[2], f[1])) == found
        hits += len({v for _, v, _ in found} & {v for _, v in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_nearest_recall_and_candidates_of_clusters(spark):
    """With clusters a small share of the rows holds the neighbours; n_visited is what a query reads."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    made = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    want = nearest_brute(made)
    got = defaultdict(set)
    found = nearest.op6(df).collect()
    for r in found:
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) / (5 * len(want)) >= 0.9
    assert max(r.n_visited for r in found) < 0.15 * len(made)


def test_nearest_visits_bounded_share_without_clusters(spark):
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    found = nearest.op6(vectors).select("query_id", "n_visited").distinct().toPandas()
    assert 0 < found.n_visited.mean() < 0.45 * vectors.count()


def test_nearest_of_a_hot_vector(spark):
    """One vector holds a third of all rows: its cell goes to several blocks, whose rows all count."""
    rng = np.random.default_rng(8)
    made = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(15_000)]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.op6(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 300
    for q in (0, 150, 300):
        assert got[q] == [i for i in range(0, 30, 3) if i != q][:5]


def test_nearest_many_queries_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK_QUERIES", 7)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    made = [(i, rng.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.search(df, lambda i: i % 2 == 0, visit=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for _, i in found] for q, found in nearest_brute(made, every=2).items()}


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    made = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    made += [(50, made[0][1]), (51, made[0][1]), (52, made[0][1])] + made[:2]  # ties and repeated rows
    made += [(100, None), (150, [0.0] * 8), (200, [nan] + [1.0] * 7), (250, [inf] + [1.0] * 7), (None, [1.0] * 8), (300, [None] + [1.0] * 7), (350, [1e200] * 8)]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    got, scores = defaultdict(list), {}
    for r in nearest.search(df, lambda i: i % 50 == 0, visit=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        scores[r.query_id, r.vec_id] = r.score
    made = [m for m in made if m[0] != 350] + [(350, [1.0] * 8)]
    found = nearest_brute(made)
    want = {q: [i for _, i in rows] for q, rows in found.items()}
    assert got == want and got[350] and 100 not in got
    assert all(abs(scores[q, i] + s) < 1e-12 and scores[q, i] != 0 for q, rows in found.items() for s, i in rows)


def test_nearest_of_several_lengths(spark):
    """Vectors meet those of as many components, however few there are; a lone one has no neighbour."""
    rng = np.random.default_rng(11)
    made = {8: [(i, rng.normal(size=8).tolist()) for i in range(300)], 3: [(i, rng.normal(size=3).tolist()) for i in range(1000, 1030)], 2: [(2000, [1.0, 2.0])]}
    df = spark.createDataFrame(sum(made.values(), []), "vec_id bigint, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in nearest.search(df, lambda i: i % 50 == 0, visit=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = {q: [i for _, i in rows] for n in (8, 3) for q, rows in nearest_brute(made[n]).items()}
    assert got == want
    assert {r.query_id for r in nearest.op6(df).collect()} == set(want)


def test_nearest_ignores_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], i, 0.5, 3, "x", 9, [1]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell int, score double, rank int, `a.b` string, block int, v array<int>")
    plain = df.select("vec_id", "embedding")
    assert bag(nearest.op6(df).collect()) == bag(nearest.op6(plain).collect()) != bag([])


def test_nearest_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.op6(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.op6(few.limit(0)).collect() == [] and nearest.op6(few.filter("vec_id = 0")).collect() == []
    one = spark.createDataFrame([(i, [float(i + 1)]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in nearest.op6(one).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(9)
    a, b = rng.uniform(size=6), rng.uniform(size=7)
    counts = rng.integers(0, 5, 42)
    cells = nearest.walk(a, b, counts.tolist(), 10**9)
    d = (a[:, None] + b[None, :]).ravel()
    assert sorted(cells) == list(range(42)) and all(d[x] <= d[y] + 1e-8 for x, y in zip(cells, cells[1:]))
    some = nearest.walk(a, b, counts.tolist(), 20)
    assert counts[some].sum() >= 20 > counts[some[:-1]].sum()


def test_blocks_split_hot_cells():
    first, parts = nearest.lay_out(np.array([10, 0, 25, 3, 3]), rows=10)
    assert first.tolist() == [0, 0, 1, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1]
