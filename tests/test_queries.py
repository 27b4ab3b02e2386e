"""Every registered query with SQL against DuckDB, and the entry points."""

import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry_points
from versewright.plans import queries as corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_query_matches_sql(spark, small, con, name):
    df = corpus.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(corpus.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(map(_norm, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def agree(spark, folder, name, **tables):
    """A query's rows on small tables written to a folder, the same as its SQL's."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = entry_points.queries()[name](spark, str(folder))
    want = con.sql(entry_points.oracle_sql()[name])
    got = sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


ODD_HTML = [
    "<title>a&amp</title>b", "&lt&copy b", "&amp;lt; &amp;amp; &#39; &eacute; &nbsp;x", "&&amp;&quot;&am", "&lt;b&gt;c", " &middot;&copy; ", "",
    "- • x—y", "Next: z", "no\x85 entity\u3000at all", "e&amp;\u0301 e\u0301", None,
]


@pytest.mark.parametrize("name", ["clean_html", "normalize_line", "clean_text"])
def test_odd_entities_as_in_sql(spark, tmp_path, name):
    agree(spark, tmp_path, name, pages=("page_id long, html string", list(enumerate(ODD_HTML))), documents=("doc_id long, text string", list(enumerate(ODD_HTML))))


ODD_BODIES = [
    "a. . b. c", "a\n\nb\n \nc", ". ", "", None, "a ॥1॥ b ॥2॥ c. d", "a\r\nb\r. c", "a\t\nb  \nc  ", "a. \n\n. b", ". ".join("abcdefghijklm"),
    "\u3000a\xa0\nb\x85. \u2028c", "॥इति क मण्डलं समाप्तम्॥ a. b", "e\u0301. e  \r\n. x  \n", "  \n  . \n  ",
]


def test_odd_stanzas_as_in_sql(spark, tmp_path):
    agree(spark, tmp_path, "stanza_fallback", documents=("doc_id long, text string", list(enumerate(ODD_BODIES))))


# Letters that came with Unicode 16, beside marks and each other: to the SQL, which knows 15.1, they are no letters yet.
UNKNOWN = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) == "Cn"]
PAIRS = [[c for c in UNKNOWN if first <= ord(c) < first + 128] for first in (0x11380, 0x16100, 0x16D00)]
LATER_LETTERS = ["".join(f"e{c}\u0301\u0323{c}\u0307 \u0307{c}e\u0301\n" for c in UNKNOWN[k : k + 512]) for k in range(0, len(UNKNOWN), 512)]
LATER_LETTERS += ["".join(f"e\u0301{a}{b}\u0323 " for b in some) for some in PAIRS for a in some] + [None, "", "e\u0301", "plain", "\u0897", "\u0307\u0323\u0897"]


@pytest.mark.parametrize("name", ["normalize_nfc", "normalize_text", "normalize_line"])
def test_later_letters_as_in_sql(spark, tmp_path, name):
    rows = list(enumerate(LATER_LETTERS))
    agree(spark, tmp_path, name, pages=("page_id long, html string", rows), documents=("doc_id long, text string", rows))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["normalize_text", "normalize_line", "normalize_nfc", "clean_text"])
def test_texts_stay_in_the_jvm(spark, small, name):
    assert "Python" not in _plan(corpus.queries()[name](spark, small))
