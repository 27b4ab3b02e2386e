"""Raw pages to verse records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import digits
from ..functions.text import SPACE, lines, normalize_text, strip, tidy
from ..schema import VERSE, one_row

DANDA = "।"

# Deity codes, and the names that headers without parts are searched for.
DEITIES = {
    "९": "अग्निः", "१०": "इन्द्रः", "४": "सोम पवमानः", "१२": "विश्वेदेवाः", "११": "विष्णुः",
    "१": "वायुः", "२": "वरुणः", "३": "मित्रः", "५": "अश्विनौ",
}
DEITY_NAMES = "Agni|Indra|Varuna|Soma|Rudra|Vayu|Surya|Mitra|Brahma|Aditi|Usas|Prajapati|Dawn|Dyaus|Ashvins|Maruts|Vishvadevas"
RISHI_NAMES = (
    "मधुच्छन्दा|वैश्वामित्र|गृत्समद|वामदेव|गौतम|कश्यप|आङ्गिरस|भरद्वाज|वसिष्ठ"
    "|Atri|Vishvamitra|Vasistha|Bharadvaja|Kashyapa|Angiras|Gritsamada|Kanva|Dirghatamas"
)
METRES = (
    "गायत्री|त्रिष्टुप्|अनुष्टुप्|जगती|विराट्|पङ्क्ति|बृहती|अतिजगती|धृतिः|त्रिष्टुभ्|अनुष्टुभ्"
    "|gāyatrī|triṣṭubh|anuṣṭubh|jagatī|br̥hatī"
)
GAYATRI = "गायत्री"


def mapped(code: Column, names: dict = DEITIES) -> Column:
    """The name of a code, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def header_fields(text: Column, separator: str = DANDA, header_lines: int | None = None) -> dict[str, Column]:
    """deity, rishi, metre and body of a page.

    The first line with text is split at the separator: number and rishi, deity, metre.
    As many physical lines as there are header lines (up to three lines with text) are
    cut from the body; header_lines fixes that number.
    """
    rows = F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: strip(x) != "")
    head = strip(F.coalesce(F.get(rows, F.lit(0)), F.lit("")))
    parts = F.split(head, separator)
    part = lambda i: _full(strip(F.get(parts, F.lit(i))))
    deity = F.coalesce(mapped(part(1)), F.initcap(_full(F.regexp_extract(head, rf"(?i)\b({DEITY_NAMES})\b", 1))))
    named = _full(F.regexp_extract(strip(F.get(parts, F.lit(0))), rf"(?s)^[^\s]+?{SPACE}+(.*)$", 1))
    rishi = F.coalesce(named, _full(F.regexp_extract(head, rf"(?iu)\b({RISHI_NAMES})\b", 1)))
    metre = F.coalesce(part(2), _full(F.regexp_extract(head, rf"(?iu)({METRES})", 1)))
    metre = F.when(metre.contains(","), strip(F.substring_index(metre, ",", 1))).otherwise(metre)
    skipped = F.lit(header_lines) if header_lines is not None else F.least(F.lit(3), F.size(rows))
    physical = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n-\r\x1c-\x1e\x85  ]")
    # a slice that starts past the end is empty
    body = strip(F.array_join(F.slice(physical, skipped + 1, F.greatest(F.size(physical), F.lit(1))), "\n"))
    there = F.size(rows) > 0
    return {
        "deity": F.when(there, deity),
        "rishi": F.when(there, rishi),
        "metre": F.when(there, metre),
        "body": F.when(there, body).otherwise(F.coalesce(text, F.lit(""))),
    }


def padas(content: Column, metre: Column | None = None, separator: str = DANDA) -> Column:
    """The first four pieces, then trimmed and without blanks; for a Gayatri without any,
    up to three groups of three words."""
    made = F.filter(F.transform(F.slice(F.split(content, separator), 1, 4), strip), lambda x: x != "")
    if metre is None:
        return made
    return F.when((F.size(made) == 0) & (metre == GAYATRI), word_groups(content)).otherwise(made)


def word_groups(content: Column, size: int = 3, most: int = 3) -> Column:
    words = F.filter(F.split(content, f"{SPACE}+"), lambda x: x != "")
    groups = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "))
    return F.filter(groups, lambda x: x != "")


def stanzas(body: Column, metre: Column | None = None, pada_separator: str = DANDA) -> Column:
    """array<struct<num, sanskrit, padas>> of a body.

    Text before a numbered double danda belongs to that number, text after the last is
    left out.  Without any, blank lines cut stanzas: the first ten, numbered from 1.
    """
    # splitting is linear; a lazy match of text and marker would rescan the tail from every character
    marker = r"॥\p{Nd}+॥"
    numbers = F.regexp_extract_all(body, F.lit(r"॥(\p{Nd}+)॥"), 1)
    texts = F.transform(F.slice(F.split(body, marker), F.lit(1), F.size(numbers)), tidy)  # each text once
    made = lambda n, t: F.struct(n.alias("num"), t.alias("sanskrit"), padas(t, metre, pada_separator).alias("padas"))
    numbered = F.zip_with(texts, numbers, lambda t, n: made(digits(n).cast("int"), t))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast(_STANZAS)).when(F.size(texts) > 0, numbered).otherwise(blank_line_stanzas(body, pada_separator))


_STANZAS = "array<struct<num: int, sanskrit: string, padas: array<string>>>"


def blank_line_stanzas(body: Column, pada_separator: str = DANDA, most: int = 10, blank: str = rf"\n{SPACE}*\n", tidied=tidy) -> Column:
    """The first pieces between blank lines, tidied and numbered from 1; null for null."""
    pieces = F.transform(F.slice(F.split(body, blank), 1, most), tidied)  # each piece once
    return F.transform(pieces, lambda t, i: F.struct((i + 1).cast("int").alias("num"), t.alias("sanskrit"), padas(t, None, pada_separator).alias("padas")))


def missing_notes(deity: Column, rishi: Column, metre: Column) -> Column:
    """'deity_missing;rishi_missing;metre_missing', those that apply; null if none."""
    flag = lambda c, tag: F.when(F.coalesce(c, F.lit("")) == "", tag)
    return _full(F.concat_ws(";", flag(deity, "deity_missing"), flag(rishi, "rishi_missing"), flag(metre, "metre_missing")))


def verse_id(m: Column, s: Column, v: Column) -> Column:
    return F.format_string("RV-%02d-%03d-%02d", m, s, v)


def dotted_id(m: Column, s: Column, v: Column) -> Column:
    return F.concat_ws(".", m.cast("string"), s.cast("string"), v.cast("string"))


def keep_first(df: DataFrame, key, order, how_many: int = 1) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*[F.col(k) for k in key]).orderBy(*order)
    return df.withColumn("__rank__", F.row_number().over(w)).filter(F.col("__rank__") <= how_many).drop("__rank__")


def explode_pages(pages: DataFrame, max_suktas: int | None = None, header_lines: int | None = None) -> DataFrame:
    """A record for each stanza of raw pages (mandala, sukta, text, source_file, pos), with
    pos and stanza for the order; ids may repeat.

    max_suktas: pages of later hymns are skipped before they are parsed (0 or None: no limit).
    """
    if max_suktas:
        pages = pages.filter(F.col("sukta") <= max_suktas)
    text = pages.withColumn("__text__", normalize_text(F.col("text")))
    fields = header_fields(F.col("__text__"), header_lines=header_lines)
    rows = text.select("mandala", "sukta", "source_file", "pos", *[c.alias(n) for n, c in fields.items()])
    rows = rows.select("*", F.posexplode(stanzas(F.col("body"), F.col("metre"))).alias("stanza", "st"))
    m, s, v = F.col("mandala"), F.col("sukta"), F.col("st.num")
    return rows.select(
        verse_id(m, s, v).alias("id"), m.alias("mandala"), s.alias("sukta"), v.alias("verse_index"), dotted_id(m, s, v).alias("verse_id"),
        "deity", "rishi", F.col("st.sanskrit").alias("sanskrit"), F.lit(None).cast("string").alias("transliteration"), F.lit(None).cast("string").alias("translation"),
        "metre", F.col("st.padas").alias("padas"), "source_file", missing_notes(F.col("deity"), F.col("rishi"), F.col("metre")).alias("notes"), "pos", "stanza",
    )


def unique_verses(exploded: DataFrame, page_numbers: DataFrame | None = None, keep: str = "first") -> DataFrame:
    """One record for each id: the first in (source_file, pos, stanza) order, or with
    keep="longest" the longest text, the first of equal ones.  page_numbers: rows
    (key 'm-s-v', page_number)."""
    order = [F.col("source_file"), F.col("pos"), F.col("stanza")]
    made = keep_first(exploded, ["id"], [F.desc(F.char_length("sanskrit")), *order] if keep == "longest" else order)
    return with_page_numbers(made, page_numbers).select(*[f.name for f in VERSE])


def parse_pages(pages: DataFrame, page_numbers: DataFrame | None = None, max_suktas: int | None = None, keep: str = "first", header_lines: int | None = None) -> DataFrame:
    """Verse records of raw pages."""
    return unique_verses(explode_pages(pages, max_suktas, header_lines), page_numbers, keep)


def with_page_numbers(verses: DataFrame, page_numbers: DataFrame | None) -> DataFrame:
    """page_number by the key 'm-s-v'; null where the table has none."""
    if page_numbers is None:
        return verses.withColumn("page_number", F.lit(None).cast("int"))
    pages = page_numbers.select(F.col("key").alias("__key__"), F.col("page_number").cast("int").alias("page_number"))
    on = F.concat_ws("-", *[F.col(c).cast("string") for c in ("mandala", "sukta", "verse_index")])
    return verses.withColumn("__on__", on).join(pages, F.col("__on__") == F.col("__key__"), "left").drop("__on__", "__key__")


def coverage(verses: DataFrame, what: str = "deity") -> DataFrame:
    """Verses and percentage with a value, by mandala."""
    filled = F.count_if(F.coalesce(F.col(what), F.lit("")) != "")
    return verses.groupBy("mandala").agg(F.count("*").alias("verses"), (100.0 * filled / F.count("*")).alias(f"{what}_pct"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def parse_summary(verses: DataFrame, before: DataFrame | None = None, listed: int = 1_000) -> DataFrame:
    """One row: total_records, by_mandala (map), the number of ids met more than once in
    ``before``, the stanzas that the verses were chosen from, and the first of those ids in
    order (``duplicate_ids`` has all)."""
    by = coverage(verses).agg(
        F.sum("verses").alias("total_records"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("mandala").cast("string").alias("k"), F.struct("verses", F.round("deity_pct", 2).alias("deity_pct")).alias("v"))))).alias("by_mandala"),
    )
    twice = duplicate_ids(before if before is not None else verses)
    many = twice.agg(F.count("*").alias("duplicate_count"))
    first = twice.orderBy("id").limit(listed).agg(F.array_sort(F.collect_list("id")).alias("duplicates"))
    return one_row(by, many, first)
