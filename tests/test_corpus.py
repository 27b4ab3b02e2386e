"""Operators on small literal inputs, quirks, round trips and random inputs."""

import html
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from versewright.functions import coerce, text
from versewright.operators import browse, clean, crawl, merge, paragraphs, parse, quality, split
from versewright.schema import VERSE, ensure_columns, flatten
from versewright.sources import readers, sinks
from versewright.streaming.clean_stream import clean_stream


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


# -- coercions and text --------------------------------------------------------------


def test_coercions_differ(spark):
    raw = ["12", " 12 ", "1.0", "1.7", "-1.7", "1e2", "", None, "nan", "inf", "१२", "x", "99999999999"]
    assert values(spark, coerce.int_or_zero, raw) == [12, 12, 0, 0, 0, 0, 0, 0, 0, 0, 12, 0, 0]
    assert values(spark, coerce.canonical_int, raw) == [12, 12, 1, 1, -1, 100, 0, 0, 0, 0, 12, 0, 0]


def test_first_usable(spark):
    df = spark.createDataFrame([("", "0", "3"), (None, "2", "3"), ("1", "2", "3"), ("", "", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(coerce.first_usable(*[F.col(c) for c in "abc"])).collect()] == ["3", "2", "1", None]


def test_strip_takes_all_unicode_space(spark):
    assert values(spark, text.strip, ["\xa0 a b　\n", "\x1c x\x85"]) == ["a b", "x"]


def test_normalize_text(spark):
    raw = [None, " a \r\nb\t\rc  ", "é ॥इति प्रथमं\n मण्डलं समाप्तम्॥ x"]
    assert values(spark, text.normalize_text, raw) == ["", "a\nb\nc", "\xe9  x"]


def test_clean_text(spark):
    raw = ["&lt;b&gt;Hi&amp;you", "<p>a</p>b", "a—b‒c", " - • * text", "Next: page 3", "previous: x", None, "a\xa0 b"]
    assert values(spark, text.clean_text, raw) == ["Hi&you", "a b", "a-b-c", "• * text", "", "", "", "a b"]


def test_normalize_line(spark):
    assert values(spark, text.normalize_line, ["a&nbsp;b<br>\r\nc é"]) == ["a b c \xe9"]


def test_junk(spark):
    cases = {
        "ab": True, "Index of verses here": True, "a line with --- in it": True, "12 3 a": True, "See the Home page": True,
        "Home is where this long line goes on and on, far beyond eighty characters, so it counts as text.": False,
        "This sentence is long enough, more than eighty characters, but it says Sanskrit somewhere in it.": True,
        "āNext is not the word that is looked for in this line of text": False, "An ordinary verse of praise": False,
    }
    assert values(spark, text.is_junk, list(cases)) == list(cases.values())
    assert values(spark, text.is_junk, [None]) == [True]


def test_junk_paragraphs(spark):
    cases = {"": True, "the reindexing of hymns": True, "1 2 a": True, "Back to it": True, "x — HYMN": True, "A verse that stays": False}
    assert values(spark, text.is_junk_paragraph, list(cases)) == list(cases.values())


def score_model(s):
    if not s:
        return -9999.0
    starts = "Index\\b|Next:|Previous:|Contents\\b|Copyright|Visit\\b"
    lower, every = len(re.findall("[a-z]", s)), len(re.findall("[A-Za-z]", s))
    out = len(s) + 200.0 * lower / max(every, 1)
    out -= 5 if len(s) >= 5 and all(not (c.isalnum() or c == "_") or c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for c in s) else 0
    out -= 10 if re.search(r"\b(Next|Previous|Index|Back|Forward|Home)\b", s, re.I) else 0
    out -= 20 if re.search(rf"^\s*({starts})|={{3,}}|-{{3,}}", s, re.I) else 0
    return out + 0.5 * sum(s.count(c) for c in ",.;:—-")


def test_score_matches_a_model(spark):
    rng = random.Random(1)
    raw = ["", "ABC 12!", "Next: a", "A_B C", "ÀÉÎ ABC", "back home, again - or so."]
    raw += ["".join(rng.choice("aB1 ,.;:-—=é_X") for _ in range(rng.randrange(30))) for _ in range(300)]
    for got, want in zip(values(spark, text.text_score, raw), map(score_model, raw)):
        assert got == pytest.approx(want)


def test_roman_and_marks(spark):
    assert values(spark, text.roman_to_int, ["mcmxciv", "IX", "IIX", "?"]) == [1994, 9, 10, 0]
    mark = lambda roman: lambda c: F.concat_ws("|", text.verse_mark(c, roman)[0].cast("string"), text.verse_mark(c, roman)[1])
    assert values(spark, mark(False), ["12. text", "(3) more", "Indra, hear", "plain"]) == ["12|text", "3|more", "ndra, hear", ""]
    assert values(spark, mark(True), ["Indra, hear", "Come hither", "x"]) == ["1|ndra, hear", "100|ome hither", ""]


def test_headings(spark):
    assert values(spark, text.book_heading, ["BOOK II", "Book of the divine", "Booklet 3", "BOOK 0", "x BOOK 2"]) == [2, 505, None, None, None]
    assert values(spark, text.hymn_heading, ["HYMN I. Agni.", "HYMN NO 12", "HYMN NUMBER 5", "hymn १२"]) == [1, 12, 1000, 12]


def test_corrections_change_words_inside(spark):
    assert values(spark, text.correct, ["thousand hasten"]) == ["yousand haveen"]
    assert values(spark, lambda c: text.correct(c, whole_words=True), ["thousand thou hast"]) == ["thousand you have"]
    assert values(spark, lambda c: text.correct(c, modernize=False), ["thou goeth"]) == ["thou goes"]


def test_html(spark):
    page = "<html><head><title> A\n</title><style>x</style></head><body><!-- no -->one<b>two</b>\n ab \n a\nthree</body></html>"
    assert values(spark, lambda c: text.html_title(c, F.lit("Hymn 1")), [page, "<p>", "<title></title>"]) == ["A", "Hymn 1", ""]
    assert values(spark, lambda c: F.array_join(text.text_lines(text.html_text(c)), "|"), [page.replace(" A\n", "A ")]) == ["A onetwo|three"]
    assert values(spark, lambda c: F.array_join(text.text_lines(c, stripped=False), "|"), ["  a\n \nbc\nlong"]) == ["a|long"]


def test_wrap_and_share(spark):
    assert values(spark, lambda c: text.wrap(c, 10), ["one two three four", "", None]) == ["one two\nthree four", "", ""]
    assert values(spark, text.script_share, ["अग्नि", "ab", ""]) == [1.0, 0.0, 0.0]


# -- parsing -------------------------------------------------------------------------


def test_stanzas(spark):
    body = "क । ख । ग । घ । ङ ॥१॥ दो  ॥12॥ trailing"
    got = values(spark, parse.stanzas, [body, "", None, "one\n\ntwo । x\n \nthree"])
    assert [(s.num, s.padas) for s in got[0]] == [(1, ["क", "ख", "ग", "घ"]), (12, ["दो"])]
    assert got[1] == [] and got[2] == []
    assert [(s.num, s.sanskrit) for s in got[3]] == [(1, "one"), (2, "two । x"), (3, "three")]
    many = values(spark, parse.stanzas, ["\n\n".join("abcdefghijklm")])[0]
    assert [s.num for s in many] == list(range(1, 11))


def test_padas_take_four_before_trimming(spark):
    assert values(spark, parse.padas, ["a।।।।b", "a। b । c"]) == [["a"], ["a", "b", "c"]]
    gayatri = lambda c: parse.padas(c, F.lit("गायत्री"))
    assert values(spark, gayatri, ["।।।।one two three four", "x"]) == [["।।।।one two three", "four"], ["x"]]
    assert values(spark, parse.word_groups, ["a b c d e f g h i j k"]) == [["a b c", "d e f", "g h i"]]


def test_header(spark):
    pages = ["1 मधुच्छन्दा वैश्वामित्रः । ९ । गायत्री, १ जगती\nl2\nl3\nbody", "7 to agni\nb", "\n\nx\ny\nz\nw", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string")
    made = parse.header_fields(F.col("t"))
    got = [tuple(r)[1:] for r in rows.select("i", *[made[c].alias(c) for c in ("deity", "rishi", "metre", "body")]).orderBy("i").collect()]
    assert got[0] == ("अग्निः", "मधुच्छन्दा वैश्वामित्रः", "गायत्री", "body")
    assert got[1][:3] == ("Agni", "to agni", None)
    assert got[2][3] == "y\nz\nw"  # three physical lines are cut, two of them blank
    assert got[3] == (None, None, None, "") and got[4] == (None, None, None, "")


def test_parse_pages(spark):
    pages = [(1, 1, "1 Kanva । ९ । गायत्री\n\n\nक ॥१॥ ख ॥२॥", "b.json", 0), (1, 1, "1 Kanva\n\n\nlonger text ॥1॥", "a.json", 0), (1, 9, "x\ny\nz\nw ॥1॥", "a.json", 1)]
    df = spark.createDataFrame(pages, "mandala int, sukta int, text string, source_file string, pos int")
    numbers = spark.createDataFrame([("1-1-2", 7)], "key string, page_number int")
    got = {r.id: r for r in parse.parse_pages(df, numbers, max_suktas=5).collect()}
    assert set(got) == {"RV-01-001-01", "RV-01-001-02"} and list(got["RV-01-001-01"].asDict()) == [f.name for f in VERSE]
    assert got["RV-01-001-01"].source_file == "a.json" and got["RV-01-001-02"].page_number == 7
    assert got["RV-01-001-02"].notes is None and got["RV-01-001-01"].notes == "deity_missing;metre_missing"
    assert parse.parse_pages(df).count() == 3
    summary = parse.parse_summary(parse.parse_pages(df)).first()
    assert summary.total_records == 3 and summary.by_mandala["1"].verses == 3 and summary.duplicates == []


# -- paragraphs ----------------------------------------------------------------------


def test_crawl_banner_gives_eleven_rows(spark):
    lines = ["A COMPLETE TRANSLATION", "of the hymns", "=" * 70, ""]
    for n in range(1, 11):
        lines += ["", "=" * 60, f"BOOK {n}", "=" * 60, ""]
    got = paragraphs.parse_text(spark.createDataFrame([(0, "\n".join(lines))], "doc_id bigint, text string")).orderBy("pos").collect()
    assert [(r.mandala, r.sukta, r.verse_index) for r in got] == [(0, 0, k) for k in range(1, 12)]


def carry_model(events):
    book = hymn = counter = 0
    out = []
    for pos, kind, number, body in events:
        if kind == "B":
            book, hymn, counter = number, 0, 0
        elif kind == "H":
            hymn, counter = number, 0
        else:
            counter = number if kind == "E" else counter + 1
            if body is not None:
                out.append((pos, book, hymn, counter, body))
    return out


def test_carry_forward_matches_a_recurrence(spark):
    rng = random.Random(8)
    rows, want = [], []
    for doc in range(60):
        events = []
        for pos in range(rng.randrange(14)):
            kind = rng.choice("BHEIII")
            events.append((pos, kind, None if kind == "I" else rng.randrange(1, 30), rng.choice(["some text", None])))
        rows += [(doc, *e) for e in events]
        want += [(doc, *w) for w in carry_model(events)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, kind string, number int, text string")
    assert sorted(map(tuple, paragraphs.carry_forward(df).collect())) == sorted(want)


def test_parse_text(spark):
    doc = "BOOK THE 2nd\n\nHYMN III. Agni.\n\n1. I laud Agni, the chosen priest\nof sacrifice\n\nWorthy is he to be praised\n\nshort\n\n7\n\nNext: HYMN IV\n\nAnother verse without number"
    got = paragraphs.parse_text(spark.createDataFrame([(0, doc)], "doc_id bigint, text string")).orderBy("pos").collect()
    assert [(r.mandala, r.sukta, r.verse_index) for r in got] == [(2, 3, 1), (2, 3, 2), (2, 3, 4)]
    assert got[0].translation_text == "I laud Agni, the chosen priest of sacrifice"


# -- cleaning ------------------------------------------------------------------------


def test_clean_and_review(spark):
    rows = [
        ("1", "1", "1", "The first verse is quite long, as it should be.", 0), ("1", "1", "1", "THE FIRST VERSE IS QUITE LONG, AS IT SHOULD BE.", 1),
        ("1", "1", "2", "A verse of the second kind, with commas.", 2), ("1", "1", "2", "A verse of the second kind, with comma.", 3),
        ("0", "1", "1", "No mandala, so this is dropped at once.", 4), ("2", "1", "1", "short", 5), ("2", "1.0", "1", "Index of everything that is here", 6),
    ]
    df = spark.createDataFrame(rows, "mandala string, sukta string, verse_index string, translation_text string, row_idx int")
    cleaned, review = clean.clean(df)
    assert sorted((r.verse_index, r.translation_text[:5]) for r in cleaned.collect()) == [(1, "The f"), (2, "A ver")]
    assert sorted(r.verse_index for r in review.collect()) == [2, 2]
    stats = clean.clean_stats(df).first().asDict()
    assert stats == {"total_rows": 7, "dropped_junk": 3, "kept": 2, "dedup_groups": 2, "ambiguous_groups": 1, "total_input_rows": 7}


def test_split_verses(spark):
    text_ = "lost words 1 Agni I laud, the high priest 2 Worthy is Agni to be praised 3 short 12 and thou wilt come to us"
    rows = [(1, 1, text_, 0), (1, 1, "1 a second text with the same number", 1)]
    got = split.split_verses(spark.createDataFrame(rows, "mandala int, sukta int, translation_text string, row_idx int"))
    assert sorted((r.verse_index, r.translation_text) for r in got.collect()) == [(1, "Agni I laud, the high priest"), (2, "Worthy is Agni to be praised"), (12, "and you will come to us")]
    assert split.split_verses(spark.createDataFrame([(1, 1, "no numbers", 0)], "mandala int, sukta int, translation_text string, row_idx int")).count() == 0


# -- merging -------------------------------------------------------------------------


def merge_model(verses, translations, overwrite, fuzzy):
    table, groups = {}, {}
    for m, s, v, t in translations:
        table[(m, s, v)] = t
        groups.setdefault((m, s), []).append((v, t))
    state = [[k, t, n or ""] for k, t, n in verses]
    tag = lambda n, x: f"{n};{x}" if n else x
    for key, t in table.items():
        for row in state:
            if row[0] == key:
                if row[1] and not overwrite:
                    row[2] = row[2] if "griffith_present" in row[2] else tag(row[2], "griffith_present")
                else:
                    row[2] = tag(row[2], "griffith_overwritten" if row[1] else "griffith_merged")
                    row[1] = t
    if fuzzy:
        for hymn, entries in groups.items():
            mine = sorted((r for r in state if r[0][:2] == hymn), key=lambda r: r[0][2])
            for (_, t), row in zip(sorted(entries, key=lambda e: e[0] if e[0] > 0 else 1e9), mine):
                if overwrite or not row[1]:
                    row[1], row[2] = t, tag(row[2], "griffith_seq_merged")
    keys = {r[0] for r in state}
    lost = [k for k in table if k not in keys]
    if fuzzy:
        lost = [k for k in lost if not any(r[0][:2] == k[:2] and r[1] and r[1].strip() == table[k].strip() for r in state)]
    return [(t, n or None) for _, t, n in state], sorted(lost)


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize("fuzzy", [False, True])
def test_merge_matches_a_model(spark, overwrite, fuzzy):
    rng = random.Random(f"{overwrite}{fuzzy}")
    key = lambda: (rng.randrange(1, 4), rng.randrange(1, 5), rng.randrange(0, 7))
    verses = [(key(), rng.choice([None, "", "old", " t3 "]), rng.choice([None, "", "x", "griffith_present"])) for _ in range(120)]
    translations = [(*key(), rng.choice(["", "t1", " t2\n", "t3", "t4"])) for _ in range(90)]
    v = spark.createDataFrame([(i, *k, t, n, f"id{i}") for i, (k, t, n) in enumerate(verses)], "row_idx int, mandala int, sukta int, verse_index int, translation string, notes string, id string")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(translations)], "row_idx int, mandala int, sukta int, verse_index int, translation_text string")
    merged = merge.merge(v, t, overwrite, fuzzy)
    rows, lost = merge_model(verses, translations, overwrite, fuzzy)
    got = [(r.translation, r.notes or None) for r in merged.orderBy("row_idx").collect()]
    assert got == rows
    assert sorted((r.mandala, r.sukta, r.verse_index) for r in merge.residual_unmatched(merged, t, fuzzy).collect()) == lost
    summary = merge.merge_summary(merged, t, fuzzy).first()
    assert summary.final_unmatched_translation_keys == len(lost) and summary.dataset_rows == len(verses)
    assert merge.delta_report(merged).count() == sum(bool(a) or bool(b) for (_, a, _), (b, _) in zip(verses, rows))


def test_mark_missing(spark):
    v = spark.createDataFrame([(0, 1, 1, 1, None, None, "a")], "row_idx int, mandala int, sukta int, verse_index int, translation string, notes string, id string")
    t = spark.createDataFrame([], "row_idx int, mandala int, sukta int, verse_index int, translation_text string")
    assert merge.merge(v, t, mark_missing=True).first().notes == "griffith_missing"


# -- browsing, validation, crawl -----------------------------------------------------


def test_browse(spark):
    df = browse.to_frame(spark.createDataFrame([("a", "1", "2.0", "3", "Agni"), ("b", "1", "1", None, None)], "id string, mandala string, sukta string, verse_index string, deity string"))
    assert [(r.mandala, r.sukta, r.verse_index, r.translation) for r in browse.in_order(df).collect()] == [(1, 1, 0, None), (1, 2, 3, None)]
    assert browse.search(df, deity="AG.I").count() == 1 and browse.search(df, deity="x*").count() == 2
    with pytest.raises(Exception, match="(?i)pattern"):
        browse.search(df, deity="a(").collect()
    assert browse.page(df, -5).first().id == "b" and browse.page(df, 99).first().id == "a"
    assert browse.random_verse(df).count() == 1
    assert browse.metadata(df, "deity", "metre").filter("id = 'a'").first().metadata == {"deity": "Agni"}


def test_violations(spark):
    rows = [("a", 1, 1, 1, " x", "f", 0), ("a", 1, 1, 2, None, "f", 3), ("b", 1, 1, 3, "é", None, None)]
    df = ensure_columns(spark.createDataFrame(rows, "id string, mandala int, sukta int, verse_index int, sanskrit string, source_file string, page_number int"))
    got = {(r.rule, r.id) for r in quality.violations(df).collect()}
    assert got == {("missing_sanskrit", "a"), ("missing_source_file", "b"), ("repeated_id", "a"), ("page_number", "a"), ("untrimmed_sanskrit", "a"), ("not_nfc_sanskrit", "b")}


def test_crawl(spark):
    grid = crawl.grid(spark, {1: "http://x/rv01", 2: "http://x/rv02"}, 30)
    assert grid.count() == 60 and grid.filter("book = 1 and n = 7").first().url == "http://x/rv01007.htm"
    status = grid.withColumn("status", F.when((F.col("n") == 5) | (F.col("n") > 20) & (F.col("book") == 1), 404).otherwise(200))
    stops = crawl.ends(status)
    assert [(r.book, r.stop_at) for r in stops.collect()] == [(1, 21)]
    assert crawl.fetched(status, stops).groupBy("book").count().orderBy("book").collect() == [(1, 19), (2, 29)]


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "a int, b struct<c int, d struct<e int>>")
    assert flatten(df).columns == ["a", "b.c", "b.d.e"]


# -- files ---------------------------------------------------------------------------


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"id": "x", "mandala": 1}\n\n  \nbroken\n{"id": "y\xff"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl")).orderBy("row_idx").collect()
    assert [r.id for r in rows] == ["x", None, "y�"] and rows[1]["_corrupt_record"] == "broken"
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), strict=True).collect()
    assert [(r.line_no, r.value) for r in readers.bad_lines(spark, str(tmp_path / "a.jsonl")).collect()] == [(4, "broken")]


def test_translations_of_every_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text('m,Hymn,verse,translation\n1,2,3,"a, ""b""\nc"\n,x,1.0,\n')
    (tmp_path / "b.json").write_text('\n [{"m": 1, "hymn": "2", "verse": 3, "text": "t"}, {"mandala": 0, "m": 4}]')
    (tmp_path / "c.jsonl").write_text('{"mandala": 1, "sukta": 2, "verse_index": 3, "translation_text": "t"}\n{"m": 4}\n')
    got = lambda name: [tuple(r)[:4] for r in readers.translations(spark, str(tmp_path / name)).orderBy("row_idx").collect()]
    assert got("a.csv") == [(1, 2, 3, 'a, "b"\nc'), (0, 0, 0, "")]
    assert got("b.json") == [(1, 2, 3, "t"), (4, 0, 0, "")]
    assert got("c.jsonl") == [(1, 2, 3, "t"), (4, 0, 0, "")]


def test_frame_headers_are_tolerant(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Mandala,SUKTA,ver,words\n1,,3,text\n")
    r = readers.translations_frame(spark, str(tmp_path / "a.csv")).first()
    assert (r.mandala, r.sukta, r.verse_index, r.translation_text) == ("1", "", "3", "text")


def test_raw_pages(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"mandala": 1, "sukta": 2, "text": ["a", "b"]}, {"mandala": 1, "sukta": 3, "text": "c"}]))
    (tmp_path / "a.json").write_text(json.dumps([{"mandala": 2, "sukta": 1, "text": "[x"}]))
    (tmp_path / "p.map").write_text('{"1-2-3": 9}')
    got = readers.raw_pages(spark, str(tmp_path / "*.json")).orderBy("source_file", "pos").collect()
    assert [tuple(r) for r in got] == [(2, 1, "[x", "a.json", 0), (1, 2, "a\nb", "b.json", 0), (1, 3, "c", "b.json", 1)]
    assert [tuple(r) for r in readers.page_numbers(spark, str(tmp_path / "p.map")).collect()] == [("1-2-3", 9)]


def test_quoted_csv_text_and_paths(spark, tmp_path):
    (tmp_path / "q.csv").write_text('mandala,translation_text\n1,"x, y"\nbad,line,more\n2,z\n')
    assert [r.translation_text for r in readers.quoted_csv(spark, str(tmp_path / "q.csv"), "mandala int, translation_text string").collect()] == ["x, y", "z"]
    (tmp_path / "t.txt").write_bytes(b"a\xff\nb")
    assert readers.text_lines(spark, str(tmp_path / "t.txt")).first().text == "a�\nb"
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "t.txt")).endswith("t.txt")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path / "none"))
    now = [0.0]
    kept = readers.Cached(frame := spark.range(3), seconds=10, clock=lambda: now[0])
    assert kept.df.count() == 3 and frame.is_cached
    kept.invalidate()
    assert not frame.is_cached
    kept.df.count()
    since = kept._since
    now[0] = 11.0
    assert kept.df.count() == 3 and kept._since == 11.0 > since


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, 1, 'a "q", b\nc', 3.0), (1, 1, 1, "", 1.0), (1, 1, 1, None, 2.0)], "mandala int, sukta int, verse_index int, translation_text string, score double")
    sinks.json_lines(df.filter("translation_text is null"), str(tmp_path / "j"))
    line = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(line)["translation_text"] is None
    sinks.csv(df, str(tmp_path / "c"), ("mandala",), one_file=True)
    back = readers.translations_csv(spark, str(tmp_path / "c")).collect()
    assert sorted(r.translation_text for r in back) == ["", "", 'a "q", b\nc']
    sinks.review_csv(df, str(tmp_path / "r"))
    sinks.cleaned_csv(df, str(tmp_path / "k"))
    sinks.summary_json(df.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 3
    sinks.text_file(df.filter("mandala = 2"), str(tmp_path / "t"), "translation_text")
    assert next((tmp_path / "t").glob("part-*")).read_text() == 'a "q", b\nc\n'
    (tmp_path / "f").write_text("x")
    assert sinks.next_backup(spark, str(tmp_path / "f")).endswith("f.bak") and sinks.next_backup(spark, str(tmp_path / "f")).endswith("f.bak1")
    assert json.loads(sinks.as_json(df.filter("mandala = 2")).first().json)["score"] == 3.0


def test_streaming_clean(spark, tmp_path):
    schema = "mandala string, sukta string, verse_index string, translation_text string, row_idx int, ts timestamp"
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, t: json.dumps({"mandala": "1", "sukta": "1", "verse_index": "1", "translation_text": t, "row_idx": i, "ts": f"2024-01-01T00:0{i}:00Z"})
    (src / "a.json").write_text("\n".join([row(0, "A verse that is long enough to stay"), row(1, "A verse that is long enough to stay"), row(2, "short")]))
    query = clean_stream(spark.readStream.schema(schema).json(str(src))).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select * from cleaned").count() == 1


def test_nfc_udf_is_pythons(spark):
    raw = ["é", "Å", None, "plain"]
    assert values(spark, text.nfc, raw) == [unicodedata.normalize("NFC", x) if x else x for x in raw]


def test_nfc_of_every_decomposed_letter(spark):
    letters = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.decomposition(c) or unicodedata.combining(c) or 0xAC00 <= ord(c) < 0xB000]
    raw = [" ".join(f(c) + tail for c in letters) for f in (str, lambda c: unicodedata.normalize("NFD", c)) for tail in ("", "\u0323\u0307", "\u0307\u0323\u0301")]
    assert values(spark, text.nfc, raw) == [unicodedata.normalize("NFC", x) for x in raw]


def test_unescape_is_pythons(spark):
    raw = [None, "", "&", "&&&", "a&amp", "&ampx &notit; &notin; &NotEqualTilde;", "&#39;&#x41&#0;&#x80;&#xD800;&#99999999;&#1;", "x&y=1&copy=2&lt;b&gt", "&#10;&NewLine;&amp;amp;", "&abcdefghijklmnopqrstuvwxyzabcdefghijkl;", "&\U0001f600; &é;", "a&\x01b"]
    rng = random.Random(5)
    raw += ["".join(rng.choice(["&", "amp", ";", "#", "x", "41", "lt", "no", "t", " ", "<", "é", "\n", "&copy", "\\", "$1"]) for _ in range(30)) for _ in range(300)]
    assert values(spark, text.unescape, raw) == [x if x is None else html.unescape(x) for x in raw]


def test_unescape_hands_python_references_alone(spark):
    plan = spark.range(1).select(F.lit("x").alias("t")).select(text.unescape(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "_unescape(CASE WHEN" in plan and "regexp_extract_all" in plan.split("_unescape(", 1)[1]


def test_json_arrays_grow_in_number_not_in_size(spark, tmp_path):
    for n in (0, 1_000, 4_000):
        rows = spark.range(n).select("id", F.repeat(F.lit("x"), 90).alias("text"))
        sinks.json_arrays(rows, str(tmp_path / str(n)), F.to_json(F.struct("id", "text")), least=2, size=10_000)
        files = [p.read_text() for p in (tmp_path / str(n)).glob("part-*")]
        assert sorted(r["id"] for f in files if f for r in json.loads(f)) == list(range(n))
        assert not n or n * 100 / 10_000 <= len(files) and max(map(len, files)) < 20_000


def test_array_is_told_by_one_character(spark, tmp_path):
    (tmp_path / "a.json").write_text(" \n\t\n\t [" + "1," * 100_000 + "1]")
    (tmp_path / "b.json").write_text('\n {"a": [1]}\n')
    (tmp_path / "c.json").write_text("\n")
    assert [readers.is_json_array(spark, str(tmp_path / f"{n}.json")) for n in "abc"] == [True, False, False]


def test_hymns_of_one_group_are_dealt_out(spark, tmp_path):
    rows = spark.range(2_000).select((F.col("id") * 16).alias("hymn"), F.repeat(F.lit("x"), 90).alias("text"))
    sinks.json_arrays(rows, str(tmp_path / "j"), F.to_json(F.struct("hymn", "text")), size=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "j").glob("part-*")]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)
