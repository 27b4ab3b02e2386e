"""Text functions as column expressions.

Two things have no expression: Unicode normalization, which calls the ICU of Spark's JVM, and
the unescaping of HTML entities, an Arrow UDF.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from .coerce import digits

# -- white space ---------------------------------------------------------------------

#: Unicode white space, for Java's regexes: \s alone is ASCII there.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: The same as characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))  # looks at the ends alone, which a regex doesn't


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


# -- normal forms and entities -------------------------------------------------------


# What takes part in NFC in Unicode 16, which ICU knows, and isn't in 15.1, which DuckDB and Python 3.13 know.
LATER = (
    r"\x{897}\x{105d2}\x{105da}\x{10d69}-\x{10d6d}\x{11382}\x{11384}\x{1138b}\x{11390}\x{113b8}\x{113bb}\x{113c2}\x{113c5}"
    r"\x{113c7}-\x{113c9}\x{113ce}-\x{113d0}\x{1611e}-\x{16129}\x{1612f}\x{16d63}\x{16d67}-\x{16d69}\x{1e5ee}\x{1e5ef}"
)
#: One of these, for most characters told by two comparisons.
ANY_LATER = rf"[\x{{897}}[\x{{105d2}}-\x{{1e5ef}}&&[{LATER}]]]"


def _composed(c: Column) -> Column:
    """NFC of Unicode 15.1 of texts that aren't null, a text at a time within the JVM.  Letters that
    came later stand by themselves there, and a text that ICU leaves alone is also in that form."""
    icu = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    apart = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"[{LATER}]|[^{LATER}]+"), F.lit(0)), icu), "")
    both = F.transform(F.array(c), lambda x: F.struct(x.alias("raw"), icu(x).alias("nfc")))
    settled = lambda x: (x["nfc"] == x["raw"]) | ~x["raw"].rlike(ANY_LATER)
    return F.transform(both, lambda x: F.when(settled(x), x["nfc"]).otherwise(apart(x["raw"])))[0]


def nfc(c: Column) -> Column:
    return F.when(c.isNotNull(), _composed(F.coalesce(c, F.lit(""))))


# What html.unescape looks up; each match stands for itself.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda found: None if found is None else [html.unescape(x) for x in found])


def unescape(c: Column, entities: dict[str, str] | None = None) -> Column:
    """HTML entities resolved as browsers do, also numbers and old names without a semicolon;
    or only the given names, in that order, where a semicolon closes them."""
    if entities is not None:
        for name, character in entities.items():
            c = F.replace(c, F.lit(f"&{name};"), F.lit(character))
        return c
    ship(SparkSession.active())
    # only the references go to Python, not the texts around them
    some = c.contains("&")
    characters = _unescape(F.when(some, F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))))
    whole = F.zip_with(F.split(c, REFERENCE), characters, lambda t, x: F.concat(t, F.coalesce(x, F.lit(""))))
    return F.when(some, F.array_join(whole, "")).otherwise(c)


# -- normalization -------------------------------------------------------------------

END_OF_BOOK = r"(?s)॥इति .*? मण्डलं समाप्तम्॥"


def tidy(c: Column) -> Column:
    """As normalize_text without the Unicode normalization, for parts of a normalized text."""
    bare = F.regexp_replace(newlines(F.coalesce(c, F.lit(""))), END_OF_BOOK, "")
    return strip(F.array_join(F.transform(lines(bare), lambda x: F.regexp_replace(x, f"{SPACE}+$", "")), "\n"))


def normalize_text(c: Column) -> Column:
    """Null as '', NFC, one kind of newline, no end-of-book marker, no space at line ends."""
    return tidy(_composed(F.coalesce(c, F.lit(""))))


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def normalize_line(c: Column, entities: dict[str, str] | None = None) -> Column:
    """Entities, tags and runs of white space resolved to one line in NFC; null as ''."""
    return collapse(_composed(strip_tags(unescape(F.coalesce(c, F.lit("")), entities))))


def clean_text(c: Column, entities: dict[str, str] | None = None) -> Column:
    """normalize_line for translations: plain dashes, no leading bullets, navigation blanked."""
    one = collapse(F.translate(strip_tags(unescape(F.coalesce(c, F.lit("")), entities)), "‒–—―", "----"))
    bare = F.regexp_replace(one, f"^{SPACE}*[-•*]+{SPACE}*", "")
    return strip(F.regexp_replace(bare, r"^(?i:Next:|Previous:).*$", ""))


# -- junk and score ------------------------------------------------------------------

# What marks navigation and boilerplate.
BOILERPLATE_STARTS = (
    r"Index\b", "Next:", "Previous:", r"Contents\b", r"Sacred Texts\b", r"Hinduism\b", r"All Rights Reserved\b",
    r"Table of Contents\b", "Copyright", r"By R\. T\. H\. Griffith", "Translated by", r"Download Options\b",
    r"Full Text\b", r"Read Online\b", r"Visit\b", "For more",
)
BOILERPLATE_RUNS = ("={3,}", "-{3,}")
NAVIGATION_WORDS = ("Next", "Previous", "Index", "Back", "Forward", "Home")
CONTENT_WORDS = ("Index", "Contents", "Prev", "Next", "Sanskrit")
BOILERPLATE_PHRASES = (
    "Sacred Texts", "Next:", "Previous:", "Table of Contents", "Index", "Sanskrit", "All Rights Reserved", "Full Text",
    "Download Options", "Read Online", "Translated by", r"By R\. T\. H\. Griffith",
)
PARAGRAPH_NAVIGATION = ("Next", "Previous", "Index", "Contents", "Back")


def _any_word(words) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def is_boilerplate(c: Column) -> Column:
    return c.rlike(rf"(?i)^{SPACE}*(?:{'|'.join(BOILERPLATE_STARTS)})|{'|'.join(BOILERPLATE_RUNS)}")


def count_of(c: Column, characters: str) -> Column:
    """How many characters of a class a text has: what goes when they go."""
    return F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{characters}]+", ""))


def letters(c: Column) -> Column:
    return count_of(c, "A-Za-z")


def signs(c: Column) -> dict[str, Column]:
    """What both is_junk and text_score ask of a text; a frame that needs both can hold it
    in columns and hand it to them."""
    text = F.coalesce(c, F.lit(""))
    return {"boilerplate": is_boilerplate(text), "navigation": text.rlike(_any_word(NAVIGATION_WORDS)), "letters": letters(text)}


def is_junk(c: Column, seen: dict[str, Column] | None = None) -> Column:
    """Translations: nothing, boilerplate, no letters to speak of, or navigation."""
    n, text, seen = F.char_length(c), F.coalesce(c, F.lit("")), seen or signs(c)
    few = (seen["letters"] < 2) & (n < 40)
    return c.isNull() | (n < 3) | seen["boilerplate"] | few | (seen["navigation"] & (n < 80)) | text.rlike(_any_word(CONTENT_WORDS))


def is_junk_paragraph(c: Column) -> Column:
    """Paragraphs: phrases count anywhere, also inside words."""
    n, text = F.char_length(c), F.coalesce(c, F.lit(""))
    phrase = text.rlike(rf"(?i){'|'.join(BOILERPLATE_PHRASES)}|—{SPACE}*HYMN")
    return (text == "") | phrase | ((letters(text) < 3) & (n < 40)) | ((n < 60) & text.rlike(_any_word(PARAGRAPH_NAVIGATION)))


def text_score(c: Column, seen: dict[str, Column] | None = None) -> Column:
    """How likely a text is a verse: length, share of lower case, punctuation, less penalties."""
    n, seen = F.char_length(c).cast("double"), seen or signs(c)
    lower = count_of(c, "a-z") / F.greatest(seen["letters"], F.lit(1))
    # five characters or more, none of them a letter or digit other than A-Z and 0-9
    capitals = (n >= 5) & ~c.rlike(r"[\p{L}\p{N}_&&[^A-Z0-9]]")
    penalty = F.when(capitals, 5.0).otherwise(0.0) + F.when(seen["navigation"], 10.0).otherwise(0.0)
    penalty = penalty + F.when(seen["boilerplate"], 20.0).otherwise(0.0)
    marks = count_of(c, ",.;:—-")
    return F.when(F.coalesce(c, F.lit("")) == "", -9999.0).otherwise(n + 2.0 * (lower * 100) - penalty + 0.5 * marks)


# -- numbers and headings ------------------------------------------------------------

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_to_int(c: Column) -> Column:
    """Roman numerals, subtractive, right to left; other characters count 0."""
    values = F.create_map(*[F.lit(x) for pair in _ROMAN.items() for x in pair])
    digits_ = F.reverse(F.filter(F.split(F.upper(c), ""), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def step(s, x):
        v = F.coalesce(F.try_element_at(values, x), F.lit(0))
        return F.struct((s["total"] + F.when(v < s["last"], -v).otherwise(v)).alias("total"), v.alias("last"))

    return F.aggregate(digits_, start, step, lambda s: s["total"])


def numeral(token: Column) -> Column:
    """A roman or arabic token as a number, null where there is none."""
    return F.when(token.rlike("(?i)^[IVXLCDM]+$"), roman_to_int(token)).otherwise(digits(token).try_cast("int"))


def _found(c: Column, pattern: str) -> Column:
    return numeral(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))


# How headings of books, hymns and verses are written.
BOOK_HEADING = rf"(?i)^{SPACE}*(?:RIG(?:-|{SPACE})?VEDA{SPACE}+BOOK|BOOK|MANDALA|BOOK OF)\b.*?([IVXLCDM]+|\p{{Nd}}+)"
HYMN_STRICT = rf"(?i)^{SPACE}*HYMN{SPACE}+([IVXLCDM]+|\p{{Nd}}+)\b"
HYMN_LOOSE = rf"(?i)^{SPACE}*(?:HYMN|HYMN{SPACE}+NO|HYMN{SPACE}+NUMBER)\b.*?([IVXLCDM]+|\p{{Nd}}+)"
VERSE_MARK = rf"^{SPACE}*\(?{SPACE}*(\p{{Nd}}+|[IVXLCDM]+){SPACE}*\)?{SPACE}*(?:[.\-—:)]{SPACE}*)?(.*)$"


def book_heading(c: Column) -> Column:
    """The number of a book heading; null where the line is none (or its number is 0)."""
    return F.nullif(_found(c, BOOK_HEADING), F.lit(0))


def hymn_heading(c: Column) -> Column:
    return F.nullif(F.when(c.rlike(HYMN_STRICT), _found(c, HYMN_STRICT)).otherwise(_found(c, HYMN_LOOSE)), F.lit(0))


def verse_mark(c: Column, allow_roman: bool = False) -> tuple[Column, Column]:
    """(number, rest) of a line that starts with a verse number; nulls where it doesn't."""
    token = F.nullif(F.regexp_extract(c, VERSE_MARK, 1), F.lit(""))
    number = numeral(token) if allow_roman else digits(token).try_cast("int")
    return number, strip(F.regexp_extract(c, VERSE_MARK, 2))


# -- corrections ---------------------------------------------------------------------

# Replacements, in the order in which they are applied.
CORRECTIONS = (
    ("lavishest", "lavishes"), ("obtaineth", "obtains"), ("thou encompassest", "you encompass"), ("goeth", "goes"),
    ("Aṅgiras", "Angiras"), ("Varuṇa", "Varuna"), ("might power", "mighty power"), ("hitherward", "hereward"),
)
MODERN = (("thee", "you"), ("thou", "you"), ("wilt", "will"), ("hast", "have"))


def correct(c: Column, modernize: bool = True, whole_words: bool = False) -> Column:
    """Replacements in order, inside words too unless ``whole_words``."""
    for old, new in CORRECTIONS + (MODERN if modernize else ()):
        c = F.regexp_replace(c, rf"(?U)\b{old}\b", new) if whole_words else F.replace(c, F.lit(old), F.lit(new))
    return c


def wrap(c: Column, width: int = 100) -> Column:
    """Lines of at most ``width`` characters, broken at spaces; longer words are cut."""
    broken = F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), rf"(.{{1,{width}}})(?: |$)|(.{{{width}}})", "$1$2\n")
    return F.btrim(broken, F.lit("\n"))


def script_share(c: Column, characters: str = r"\p{IsDevanagari}") -> Column:
    """Share of a text's characters in a script, 0 for empty texts."""
    return F.coalesce(count_of(c, characters) / F.nullif(F.char_length(c), F.lit(0)), F.lit(0.0))


def snippet(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


# -- HTML ----------------------------------------------------------------------------


def html_title(c: Column, fallback: Column) -> Column:
    """The stripped title; the fallback only where there is no title element."""
    return F.when(c.rlike(r"(?i)<title[\s>]"), strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))).otherwise(fallback)


def html_text(c: Column) -> Column:
    """All text between tags, nothing put in their place; no comments, scripts or styles."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return strip_tags(bare, "")


def text_lines(c: Column, least: int = 2, stripped: bool = True) -> Column:
    """Lines of more than ``least`` characters, stripped; with ``stripped`` false the
    length counts before stripping and only blank lines go."""
    if stripped:
        return F.filter(F.transform(lines(c), strip), lambda x: F.char_length(x) > least)
    return F.transform(F.filter(lines(c), lambda x: (strip(x) != "") & (F.char_length(x) > least)), strip)


def framed(number: Column, title: Column, body: Column) -> Column:
    return F.concat(F.format_string("HYMN %d: ", number), title, F.lit("\n" + "-" * 40 + "\n"), body)


def book_banner(number: Column) -> Column:
    return F.concat(F.lit("=" * 60 + "\nBOOK "), number.cast("string"), F.lit("\n" + "=" * 60 + "\n"))
