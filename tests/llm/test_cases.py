"""Cases that all operators share: very long texts, slices of batches, clashing columns, the shared folder."""

import random
import struct
from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("versewright.llm")
cp = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from test_operators import ODD, SCHEMA, bag, dedup_brute, digest, license_base, near_brute, quality_brute, rows  # noqa: E402
from versewright.llm import common, language, licenses, line_dedup, mixing, pieces, quality_rules, simhash, token_counts  # noqa: E402
from versewright.llm.common import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def long(spark):
    """Texts of a megabyte and more among short ones: prose, one line, one word."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randrange(2, 9))) for _ in range(20_000)]
    prose = "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(16_000))
    texts = ["short", prose, prose.replace("\n", " "), "x" * 1_000_000, "a " * 500_000, "All rights reserved. " * 20_000, None, "the end"]
    made = rows(texts)
    return made, spark.createDataFrame(made, SCHEMA).repartition(2)


def test_long_texts(long):
    import sentencepiece
    from tokenizers import Tokenizer

    made, df = long
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = bag((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in made)
    assert bag(token_counts.op1(df, tokenizer_path("word_bpe_49k.json")).collect()) == want
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for r in made:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(sp.decode(ids))] += 1
    assert bag(pieces.op8(df, tokenizer_path("piece_bpe_32k.model")).collect()) == want
    assert bag(line_dedup.op2(df).collect()) == bag(dedup_brute(made))
    assert bag(simhash.op5(df).collect()) == bag(near_brute(made))
    base = licenses.op4(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert bag(base.collect()) == bag((r[0], *license_base(r[1])) for r in made)
    measured = quality_rules.op7(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(measured.collect()) == bag((r[0], *quality_brute(r[1])) for r in made)
    told = language.op10(df).collect()
    assert {r.lang_pred == "und" for r in told if r.doc_id != 6} == {False} and sum(r.lang_pred == "und" for r in told) == 1


def test_slices_keep_rows_and_order():
    texts = ["ab" * (i % 50) for i in range(200)] + ["x" * 5000] + ["y"] * 9
    batch = pa.RecordBatch.from_pylist([{"i": i, "text": t} for i, t in enumerate(texts)])
    parts = list(common.slices(batch, "text", 1000))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert len(parts) > 8 and all(p.num_rows == 1 or p.column("text").nbytes <= 1000 for p in parts)
    assert list(common.slices(batch.slice(0, 0), "text", 10)) == []


def test_operators_on_sliced_batches(long):
    """One batch of over SLICE_BYTES, so workers cut it."""
    made, df = long
    twice = df.unionByName(df).coalesce(1)
    assert 2 * sum(len((r[1] or "").encode()) for r in made) > common.SLICE_BYTES
    assert bag(quality_rules.op7(twice).collect()) == bag(quality_rules.op7(df).collect() * 2)
    assert bag(licenses.op4(twice).collect()) == bag(licenses.op4(df).collect() * 2)


CLASH = ("a.b", "a`b", "loss", "kept", "cleaned", "n_words", "n_lines", "n_dropped", "pos", "line", "batch", "version", "fp", "root", "component_id",
         "least", "n", "stays", "copy", "shuffle_key", "rate", "low", "steps", "size", "owner", "__text__", "__id__", "seen", "__0__", "__1__", "m")


@pytest.mark.parametrize("stage", [quality_rules.cleaned_documents, line_dedup.deduped_documents, simhash.one_of_each, mixing.mixed_documents])
def test_stages_keep_clashing_columns(spark, small, stage):
    """Extra columns come back unchanged, whatever their names, and change nothing else."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH}).select(*[F.col(f"`{c.replace('`', '``')}`") for c in reversed([*docs.columns, *CLASH])])
    got = stage(extra)
    assert got.columns == extra.columns
    plain = stage(docs)
    assert bag(got.select(*docs.columns).collect()) == bag(plain.collect()) != bag([])
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in CLASH)


def test_stages_take_odd_rows_with_all_columns(spark, small):
    docs = spark.createDataFrame(rows(ODD) + rows(ODD[:9]) + [(None, "no id", None, None, None, None, None, None, None, None)] * 2, SCHEMA)
    for docs in (docs, docs.limit(0)):
        columns = docs.columns
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == columns and docs.count() >= 0


def test_one_row_of_repeated_ones(spark):
    text = "a text that several rows share, down to the last of its words"
    made = [(3, text), (3, text), (5, text), (None, text), (3, "another text of the same id " * 3), (None, "no id here " * 9), (None, "no id here " * 9)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    assert bag(simhash.one_of_each(df).collect()) == bag([made[0], made[4], made[5]])


def test_source_that_holds_most_rows(spark):
    made = [(i, "some text", "most" if i % 20 else f"s{i}") for i in range(2000)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    copies = Counter(r.source == "most" for r in mixing.op9(df).collect())
    assert copies[True] > 0 and copies[False] > 0
    assert abs(copies.total() - 2000) < 400


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def __init__(self, master):
            self.master = master
            self.conf = self.sparkContext = self

        def get(self, *_):
            return None

        def getConf(self):
            return self

    assert common.shared_root(Conf("local[4]")).startswith("file://") and common.shared_root(Conf("local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_root(Conf(master))
