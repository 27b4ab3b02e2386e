"""Translations merged into verses: by key, then by rank within a hymn.

A merged frame has the verses' columns, existing_translation (as it was), and of each
pass the outcome: exact_outcome and seq_outcome, null where the pass met no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import KEY, one_row
from .parse import keep_first

HYMN = ("mandala", "sukta")
PRESENT, MERGED, OVERWRITTEN, SEQUENCE, MISSING = "griffith_present", "griffith_merged", "griffith_overwritten", "griffith_seq_merged", "griffith_missing"


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def append_tag(notes: Column, tag: Column | str) -> Column:
    return F.concat_ws(";", F.nullif(notes, F.lit("")), F.lit(tag) if isinstance(tag, str) else tag)


def append_tag_once(notes: Column, tag: str) -> Column:
    return F.when(F.coalesce(notes, F.lit("")).contains(tag), notes).otherwise(append_tag(notes, tag))


def last_wins(translations: DataFrame, key=KEY) -> DataFrame:
    """The last row of each key; position is that of its first."""
    w = Window.partitionBy(*key)
    rows = translations.withColumn("position", F.min("row_idx").over(w))
    return keep_first(rows, key, [F.desc("row_idx")])


def merge_exact(verses: DataFrame, translations: DataFrame, overwrite: bool = False) -> DataFrame:
    """Each translation key updates all verses with that key.  verses need row_idx."""
    table = last_wins(translations).select(*[F.col(k).alias(f"__{k}__") for k in KEY], F.col("translation_text").alias("__text__"))
    on = [F.col(k) == F.col(f"__{k}__") for k in KEY]
    rows = verses.withColumn("existing_translation", F.col("translation")).join(table, on, "left")
    met, had = F.col("__mandala__").isNotNull(), _filled(F.col("translation"))
    outcome = F.when(met & had & F.lit(not overwrite), "skipped").when(met & had, "overwritten").when(met, "merged")
    rows = rows.withColumn("exact_outcome", outcome)
    notes = (
        F.when(F.col("exact_outcome") == "skipped", append_tag_once(F.col("notes"), PRESENT))
        .when(F.col("exact_outcome") == "overwritten", append_tag(F.col("notes"), OVERWRITTEN))
        .when(F.col("exact_outcome") == "merged", append_tag(F.col("notes"), MERGED))
        .otherwise(F.col("notes"))
    )
    rows = rows.withColumns({"notes": notes, "translation": F.when(F.col("exact_outcome").isin("merged", "overwritten"), F.col("__text__")).otherwise(F.col("translation"))})
    return rows.drop("__text__", *[f"__{k}__" for k in KEY])


def merge_by_rank(merged: DataFrame, translations: DataFrame, overwrite: bool = False) -> DataFrame:
    """Within a hymn, the i-th translation (by verse number, those without last) goes to
    the i-th verse.  Works on the state that the exact pass left; only empty verses are
    filled, or with overwrite all that have a partner."""
    v = F.when(F.col("verse_index") > 0, F.col("verse_index")).otherwise(F.lit(1_000_000_000))
    rank = lambda *order: F.row_number().over(Window.partitionBy(*HYMN).orderBy(*order))
    ours = translations.withColumn("__rank__", rank(v, F.col("row_idx"))).select(*[F.col(k).alias(f"__{k}__") for k in HYMN], "__rank__", F.col("translation_text").alias("__text__"))
    theirs = merged.withColumn("__turn__", rank(F.col("verse_index"), F.col("row_idx")))
    on = [F.col(k) == F.col(f"__{k}__") for k in HYMN] + [F.col("__turn__") == F.col("__rank__")]
    rows = theirs.join(ours, on, "left")
    met, had = F.col("__rank__").isNotNull(), _filled(F.col("translation"))
    rows = rows.withColumn("seq_outcome", F.when(met & had & F.lit(not overwrite), "skipped").when(met, "merged"))
    done = F.col("seq_outcome") == "merged"
    rows = rows.withColumns({"notes": F.when(done, append_tag(F.col("notes"), SEQUENCE)).otherwise(F.col("notes")), "translation": F.when(done, F.col("__text__")).otherwise(F.col("translation"))})
    return rows.drop("__text__", "__rank__", "__turn__", *[f"__{k}__" for k in HYMN])


def merge(verses: DataFrame, translations: DataFrame, overwrite: bool = False, fuzzy: bool = False, mark_missing: bool = False) -> DataFrame:
    rows = merge_exact(verses, translations, overwrite)
    rows = merge_by_rank(rows, translations, overwrite) if fuzzy else rows.withColumn("seq_outcome", F.lit(None).cast("string"))
    if mark_missing:
        rows = rows.withColumn("notes", F.when(~_filled(F.col("translation")), append_tag(F.col("notes"), MISSING)).otherwise(F.col("notes")))
    return rows


def unmatched_keys(verses: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation keys without a verse, with the text and the position of the key.  verses:
    before or after a merge, which changes no key; before is cheaper."""
    return last_wins(translations).join(verses.select(*KEY).distinct(), list(KEY), "left_anti").select(*KEY, "translation_text", "position")


def _unmatched(merged: DataFrame, translations: DataFrame, fuzzy: bool, verses: DataFrame | None) -> DataFrame:
    """unmatched_keys with ``residual``: no verse of the hymn has the text (stripped) in the
    end either."""
    left = unmatched_keys(merged if verses is None else verses, translations)
    if not fuzzy:
        return left.withColumn("residual", F.lit(True))
    held = merged.filter(_filled(F.col("translation"))).select(*[F.col(k).alias(f"__{k}__") for k in HYMN], strip(F.col("translation")).alias("__text__")).distinct()
    on = [F.col(k) == F.col(f"__{k}__") for k in HYMN] + [strip(F.col("translation_text")) == F.col("__text__")]
    return left.join(held, on, "left").withColumn("residual", F.col("__text__").isNull()).drop("__text__", *[f"__{k}__" for k in HYMN])


def residual_unmatched(merged: DataFrame, translations: DataFrame, fuzzy: bool = False, verses: DataFrame | None = None) -> DataFrame:
    """Unmatched keys whose text (stripped) no verse of the hymn has in the end either."""
    return _unmatched(merged, translations, fuzzy, verses).filter("residual").drop("residual")


def examples(unmatched: DataFrame, n: int = 20, width: int = 200) -> DataFrame:
    """The first n by position, with a snippet."""
    return unmatched.orderBy("position").limit(n).select(*KEY, F.substring("translation_text", 1, width).alias("translation_snip"))


def sequence_skipped(merged: DataFrame, translations: DataFrame, n: int = 20, width: int = 120) -> DataFrame:
    """The first n verses that the rank pass left as they were, hymns in the order of the
    translations: (mandala, sukta, place within the hymn from 0, existing_snip)."""
    turn = F.row_number().over(Window.partitionBy(*HYMN).orderBy("verse_index", "row_idx"))
    rows = merged.select(*HYMN, "verse_index", "row_idx", "seq_outcome", (turn - 1).alias("place"), F.substring("translation", 1, width).alias("existing_snip"))
    first = translations.groupBy(*[F.col(k).alias(f"__{k}__") for k in HYMN]).agg(F.min("row_idx").alias("start"))
    met = rows.filter("seq_outcome = 'skipped'").join(first, [F.col(k) == F.col(f"__{k}__") for k in HYMN])
    return met.orderBy("start", "place").limit(n).select(*HYMN, "place", "existing_snip", "start")


def updated():
    """Whether a pass wrote the verse."""
    return F.coalesce(F.col("exact_outcome").isin("merged", "overwritten"), F.lit(False)) | F.coalesce(F.col("seq_outcome") == "merged", F.lit(False))


def merge_summary(merged: DataFrame, translations: DataFrame, fuzzy: bool = False, verses: DataFrame | None = None) -> DataFrame:
    """One row of counters.  verses: those before the merge, if they are at hand."""
    is_ = lambda c, x: F.count_if(F.col(c) == x)
    counted = merged.agg(
        F.count("*").alias("dataset_rows"),
        is_("exact_outcome", "merged").alias("exact_matches_applied"),
        is_("seq_outcome", "merged").alias("sequence_matches_applied"),
        (is_("exact_outcome", "skipped") + is_("seq_outcome", "skipped")).alias("skipped_existing_translations"),
        is_("exact_outcome", "overwritten").alias("overwritten_translations"),
        F.count_if(updated()).alias("updated_record_count"),
    )
    keys = translations.select(*KEY).distinct().agg(F.count("*").alias("translation_keys"))
    lost = _unmatched(merged, translations, fuzzy, verses).agg(F.count("*").alias("unmatched_translation_keys"), F.count_if("residual").alias("final_unmatched_translation_keys"))
    return one_row(counted, keys, lost)


_EXAMPLE = "struct<key: array<int>, text_snip: string, sequence_skipped: struct<hymn: array<int>, place: int>, existing_snip: string>"


def _listed(rows: DataFrame, order: list, example: Column, name: str) -> DataFrame:
    """One row with the rows' examples as an ordered list: for a few rows only."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], example.cast(_EXAMPLE).alias("e"))))
    return rows.agg(F.transform(pairs, lambda p: p["e"]).alias(name))


def merge_report(merged: DataFrame, translations: DataFrame, fuzzy: bool, verses: DataFrame, dataset_input: str, translations_input: str, output: str, backup_created: str | None = None, n: int = 20) -> DataFrame:
    """One row as a merge's summary file has it: the paths, ``stats`` with the counters and
    the first n examples of unmatched keys, of verses that the rank pass left as they were,
    and of the keys that are unmatched in the end, and updated_record_count."""
    none = F.lit(None)
    lost = _unmatched(merged, translations, fuzzy, verses)
    key = F.array(*[F.col(k) for k in KEY])
    snip = F.struct(key.alias("key"), F.substring("translation_text", 1, 200).alias("text_snip"), none.alias("sequence_skipped"), none.alias("existing_snip"))
    skipped = F.struct(none.alias("key"), none.alias("text_snip"), F.struct(F.array(*[F.col(k) for k in HYMN]).alias("hymn"), F.col("place").alias("place")).alias("sequence_skipped"), F.col("existing_snip").alias("existing_snip"))
    first = lambda rows: rows.orderBy("position").limit(n)
    row = one_row(
        merge_summary(merged, translations, fuzzy, verses),
        _listed(first(lost), ["position"], snip, "lost"),
        _listed(sequence_skipped(merged, translations, n), ["start", "place"], skipped, "skipped"),
        _listed(first(lost.filter("residual")), ["position"], snip, "final"),
    )
    counters = ("exact_matches_applied", "sequence_matches_applied", "skipped_existing_translations", "overwritten_translations", "unmatched_translation_keys")
    stats = F.struct(
        F.col("dataset_rows").alias("total_dataset_records"),
        F.col("translation_keys").alias("total_translation_entries"),
        *counters,
        F.slice(F.concat("lost", "skipped"), 1, n).alias("unmapped_translation_examples"),
        "final_unmatched_translation_keys",
        F.transform("final", lambda e: F.struct(e["key"].alias("key"), e["text_snip"].alias("text_snip"))).alias("final_unmatched_examples"),
    )
    paths = {"dataset_input": dataset_input, "translations_input": translations_input, "output": output, "backup_created": backup_created}
    return row.select(*[F.lit(v).cast("string").alias(k) for k, v in paths.items()], stats.alias("stats"), "updated_record_count")


def delta_report(merged: DataFrame) -> DataFrame:
    """Verses with a translation before or after."""
    rows = merged.filter(_filled(F.col("existing_translation")) | _filled(F.col("translation")))
    return rows.select(F.col("row_idx").alias("dataset_index"), "id", *KEY, "existing_translation", F.col("translation").alias("new_translation"), "notes")
