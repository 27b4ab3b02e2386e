"""The jobs end to end over small files."""

import json

import pytest

from versewright import jobs
from versewright.__main__ import main, parser
from versewright.operators import merge
from versewright.sources import readers


def test_parse_merge_browse(spark, tmp_path):
    pages = [{"mandala": 1, "sukta": 1, "text": ["1 Kanva । ९ । गायत्री", "", "", "क । ख ॥१॥ ग ॥२॥"]}, {"mandala": 1, "sukta": 2, "text": "x\ny\nz\nघ ॥1॥"}, {"mandala": 1, "sukta": 2, "text": "x\ny\nz\nङ ॥1॥"}]
    (tmp_path / "pages_1.json").write_text(json.dumps(pages))
    main(["parse", "--input", str(tmp_path / "pages_*.json"), "--output", str(tmp_path / "verses")], spark)
    summary = spark.read.json(str(tmp_path / "verses_summary")).first()
    assert summary.total_records == 3 and summary.by_mandala["1"].verses == 3 and summary.duplicates == ["RV-01-002-01"]
    (tmp_path / "map.csv").write_text('mandala,sukta,verse_index,translation_text\n1,1,1,first\n1,2,9,late\n')
    main(["merge", "--dataset", str(tmp_path / "verses"), "--translations", str(tmp_path / "map.csv"), "--output", str(tmp_path / "merged"), "--fuzzy", "--report", str(tmp_path / "report")], spark)
    merged = {r.id: r for r in readers.json_lines(spark, str(tmp_path / "merged")).collect()}
    assert merged["RV-01-001-01"].translation == "first" and merged["RV-01-002-01"].translation == "late" and merged["RV-01-001-02"].translation is None
    summary = spark.read.json(str(tmp_path / "merged_merge_summary")).first()
    stats = summary.stats
    assert (stats.exact_matches_applied, stats.sequence_matches_applied, stats.final_unmatched_translation_keys) == (1, 1, 0)
    assert [e.key for e in stats.unmapped_translation_examples if e.key] == [[1, 2, 9]] and stats.unmapped_translation_examples[0].text_snip == "late"
    assert summary.updated_record_count == 2 and summary.output == str(tmp_path / "merged") and stats.final_unmatched_examples == []
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    found = jobs.browse_job(spark, [str(tmp_path / "none"), str(tmp_path / "merged")], mandala=1, text="LATE", export=str(tmp_path / "export"))
    assert [r.id for r in found.collect()] == ["RV-01-002-01"] and spark.read.json(str(tmp_path / "export/jsonl")).count() == 1


def test_paragraphs_clean_split(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("BOOK 1\n\nHYMN 2\n\n1 Agni I laud, the chosen priest 2 Worthy is Agni to be praised\n\nA stanza that has no number of its own\n")
    main(["paragraphs", "--input", str(tmp_path / "t.txt"), "--dry-run"], spark)
    assert "chosen priest" in capsys.readouterr().out
    main(["paragraphs", "--input", str(tmp_path / "t.txt"), "--output", str(tmp_path / "map")], spark)
    assert spark.read.json(str(tmp_path / "map/jsonl")).count() == 2
    main(["clean", "--input", str(tmp_path / "map/csv"), "--prefix", str(tmp_path / "out")], spark)
    stats = spark.read.json(str(tmp_path / "out_stats")).first()
    assert (stats.total_rows, stats.kept, stats.ambiguous_groups) == (2, 2, 0)
    (tmp_path / "joined.csv").write_text("mandala,sukta,verse_index,translation_text\n1,2,1,1 Agni I laud the priest 2 Worthy is Agni to be praised\n")
    main(["split", "--input", str(tmp_path / "joined.csv"), "--output", str(tmp_path / "split"), "--jsonl", str(tmp_path / "splitj")], spark)
    assert spark.read.json(str(tmp_path / "splitj")).count() == 2 and spark.read.json(str(tmp_path / "split_stats")).first().total_rows == 2


def test_crawl_text(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<title>T</title><p>some text</p>"), (2, "<p>more text</p>"), (30, "x")], "page_id int, html string")
    jobs.crawl_text_job(spark, pages, str(tmp_path / "text"), limit=10)
    made = next((tmp_path / "text").glob("part-*")).read_text()
    assert made.startswith("=" * 60 + "\nBOOK 1\n") and made.index("HYMN 1: T") < made.index("HYMN 2: Hymn 2") and "some text" in made


def test_merge_summary_has_the_expected_keys(spark, tmp_path):
    """The keys of a run's summary file, given in FIXTURES.md; passes that leave verses as they were are listed."""
    verses = [{"id": f"RV-01-001-0{i}", "mandala": 1, "sukta": 1, "verse_index": i, "sanskrit": "s", "translation": "x" * 150 if i == 2 else None} for i in (1, 2)]
    (tmp_path / "v.jsonl").write_text("".join(json.dumps(v) + "\n" for v in verses))
    (tmp_path / "t.csv").write_text("mandala,sukta,verse_index,translation_text\n1,1,1,one\n1,1,2,two\n3,1,1," + "far " * 80 + "\n")
    main(["merge", "--dataset", str(tmp_path / "v.jsonl"), "--translations", str(tmp_path / "t.csv"), "--output", str(tmp_path / "o"), "--fuzzy", "--backup"], spark)
    got = json.loads(next((tmp_path / "o_merge_summary").glob("part-*")).read_text())
    assert list(got) == ["dataset_input", "translations_input", "output", "backup_created", "stats", "updated_record_count"]
    assert list(got["stats"]) == [
        "total_dataset_records", "total_translation_entries", "exact_matches_applied", "sequence_matches_applied", "skipped_existing_translations", "overwritten_translations",
        "unmatched_translation_keys", "unmapped_translation_examples", "final_unmatched_translation_keys", "final_unmatched_examples",
    ]
    assert got["backup_created"].endswith("v.jsonl.bak") and got["updated_record_count"] == 1
    listed = got["stats"]["unmapped_translation_examples"]
    assert listed[0]["key"] == [3, 1, 1] and len(listed[0]["text_snip"]) == 200
    assert [(e["sequence_skipped"], len(e["existing_snip"])) for e in listed[1:]] == [({"hymn": [1, 1], "place": 0}, 3), ({"hymn": [1, 1], "place": 1}, 120)]
    assert [e["key"] for e in got["stats"]["final_unmatched_examples"]] == [[3, 1, 1]]


def test_browse_views(spark, tmp_path, capsys):
    rows = [{"id": f"RV-0{m}-001-0{v}", "mandala": m, "sukta": 1, "verse_index": v, "sanskrit": f"s{m}{v}", "padas": ["a", "b"]} for m in (2, 1) for v in (1, 2)]
    (tmp_path / "v.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    run = lambda *args: (main(["browse", "--dataset", str(tmp_path / "v.jsonl"), *args], spark), capsys.readouterr().out)[1]
    assert "RV-01-001-02" in run("--page", "1") and "RV-02-001-02" in run("--page", "99") and "RV-01-001-01" in run("--first")
    assert run("--random", "--seed", "3") == run("--random", "--seed", "3")
    assert "verses: 4" in run("--counts") and "|        1|" not in run("--options", "mandala") and "1|" in run("--options", "mandala")
    run("--mandala", "2", "--page", "0", "--record", str(tmp_path / "one"), "--export", str(tmp_path / "all"))
    assert json.loads(next((tmp_path / "one/json").glob("part-*")).read_text())["id"] == "RV-02-001-01"
    made = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "all/csv")).collect()
    assert len(made) == 2 and json.loads(made[0].padas) == ["a", "b"]


def test_crawl_of_several_books(spark, tmp_path):
    pages = spark.createDataFrame([(2, 1, "<p>second book</p>"), (1, 2, "<p>page two</p>"), (1, 1, "<p>page one</p>"), (1, 30, "x")], "book int, page_id int, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "taken").write_text("a file stands where the folder should go")
    main(["crawl-text", "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "taken"), "--fallback", str(tmp_path / "text"), "--limit", "10", "--header", "HEAD"], spark)
    made = next((tmp_path / "text").glob("part-*")).read_text()
    places = [made.index(x) for x in ("HEAD", "BOOK 1\n", "page one", "page two", "BOOK 2\n", "second book")]
    assert places == sorted(places) and "HYMN 30" not in made


def test_strict_lines_name_the_fault(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    (folder / "b.jsonl").write_text('{"id": "3"}\n\n{"id": \n[1]\n')
    with pytest.raises(ValueError, match="b.jsonl, line 3: no JSON object"):
        readers.json_lines(spark, str(folder), strict=True)
    assert [(r.source_file.rsplit("/", 1)[1], r.line_no) for r in readers.bad_lines(spark, str(folder)).orderBy("line_no").collect()] == [("b.jsonl", 3), ("b.jsonl", 4)]


def test_rows_are_numbered_in_input_order(spark, tmp_path):
    """A small file before a large one: Spark packs the large one first."""
    folder = tmp_path / "v"
    folder.mkdir()
    line = lambda m, t: json.dumps({"mandala": m, "sukta": 1, "verse_index": 1, "translation_text": t}) + "\n"
    (folder / "a.jsonl").write_text(line(1, "first"))
    (folder / "b.jsonl").write_text(line(1, "last") + "".join(line(2, "x" * 1000 + str(i)) for i in range(3000)))
    rows = readers.translations(spark, str(folder))
    got = rows.orderBy("row_idx").collect()
    assert [r.translation_text for r in got[:2]] == ["first", "last"] and [r.translation_text[1000:] for r in got[2:]] == [str(i) for i in range(3000)]
    assert merge.last_wins(rows).filter("mandala = 1").first().translation_text == "last"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = readers.translations(spark, str(folder))
        assert split.rdd.getNumPartitions() > 10 and [r.translation_text for r in split.orderBy("row_idx").collect()] == [r.translation_text for r in got]
        numbered = readers.numbered_lines(spark, str(folder)).orderBy("source_file", "line_no").collect()
        assert [r.line_no for r in numbered] == [1, *range(1, 3002)] and numbered[-1].value == line(2, "x" * 1000 + "2999").strip()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_flags():
    args = parser().parse_args(["merge", "--dataset", "d", "--translations", "t", "--output", "o", "--overwrite"])
    assert args.overwrite and not args.fuzzy
