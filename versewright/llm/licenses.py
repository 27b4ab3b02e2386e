"""License scans by ordered signature rules.

Texts become sequences of lower-case words.  Hundreds of hand-written regexes over the
words, each gated by keywords (a rule is only tried on a text that has one of its
keywords as a word, and whatever it matches holds one), detect license names and notices.  Rules have a priority;
a detection that lies inside one of a higher priority (or of the same priority, found
first or longer) is suppressed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Word characters are digits, letters and everything beyond ASCII; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BASE = (
    ("cc-by", (b"cc", b"by")),
    ("gpl", (b"general", b"public", b"license")),
    ("reserved", (b"all", b"rights", b"reserved")),
)


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def _rule(label: str, keywords: str, pattern: str, priority: int = 50, confidence: float = 0.8) -> Rule:
    """pattern: over words joined by single spaces; matches whole words."""
    return Rule(label, priority, confidence, tuple(k.encode() for k in keywords.split()), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode()))


#: label | keywords | pattern.  The license's own name in words, without versions.
_NAMES = """
apache | apache | apache (?:software |public )?licen[sc]es?
apache | asl | asl 2(?: 0)?
mit | mit | (?:the )?mit licen[sc]e
mit | mit | licensed under (?:the )?mit
mit | expat | expat licen[sc]e
isc | isc | isc licen[sc]e
bsd | bsd | bsd (?:style )?licen[sc]e
bsd | berkeley | berkeley software distribution
bsd-2-clause | bsd freebsd simplified | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
0bsd | 0bsd bsd | (?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[sc]e)?
bsd-source-code | bsd | bsd source code attribution
bsd-patent | bsd | bsd (?:2 clause )?plus patent(?: licen[sc]e)?
gpl | gnu | gnu (?:general public licen[sc]e|gpl)
gpl | gpl gpled | gpl(?:ed)? licen[sc]e
gpl | gpl | (?:under|of) the gpl
lgpl | lesser library lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]e)?
agpl | affero agpl | (?:gnu )?affero general public licen[sc]e
agpl | agpl | (?:gnu )?agpl(?: licen[sc]e)?
gfdl | gnu gfdl | (?:gnu free documentation licen[sc]e|gfdl)
gpl-exception-classpath | classpath | classpath exception
gpl-exception-gcc | gcc | gcc runtime library exception
gpl-exception-linking | linking | linking exception
mpl | mozilla | mozilla public licen[sc]e
epl | eclipse | eclipse public licen[sc]e
edl | eclipse | eclipse distribution licen[sc]e
cddl | cddl development | (?:common development and distribution licen[sc]e|cddl)
cpl | common | common public licen[sc]e
cpal | attribution cpal | (?:common public attribution licen[sc]e|cpal)
ibm-public | ibm | ibm public licen[sc]e
artistic | artistic | (?:perl )?artistic licen[sc]e
artistic-clarified | artistic | clarified artistic licen[sc]e
zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng | libpng licen[sc]e
boost | boost | boost software licen[sc]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl want | (?:wtfpl|do what the [a-z]+ you want to public licen[sc]e)
eupl | eupl european | (?:european union public licen[sc]e|eupl)
ofl | ofl font | (?:sil )?(?:open font licen[sc]e|ofl)
ubuntu-font | ubuntu | ubuntu font licen[sc]e
odbl | odbl database | (?:open (?:data commons )?(?:open )?database licen[sc]e|odbl)
odc-by | odc commons | (?:odc by|open data commons attribution licen[sc]e)
pddl | pddl domain | (?:pddl|public domain dedication and licen[sc]e)
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 | cc | cc zero
public-domain | domain | (?:released |placed )?(?:into |in )?(?:the )?public domain
public-domain-mark | domain | public domain mark
python | python psf | (?:python software foundation licen[sc]e|psf licen[sc]e|python licen[sc]e)
cnri-python | cnri | cnri (?:open source )?(?:gpl compatible )?(?:python )?licen[sc]e
ruby | ruby | ruby licen[sc]e
php | php | php licen[sc]e
perl | perl | same terms as perl(?: itself)?
openssl | openssl | openssl(?: ssleay)? licen[sc]e
ssleay | ssleay | ssleay licen[sc]e
x11 | x11 | x11 licen[sc]e
xfree86 | xfree86 | xfree86 licen[sc]e
w3c | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
ncsa | ncsa illinois | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
mysql-foss | mysql | mysql (?:foss|floss) (?:licen[sc]e )?exception
oracle-upl | upl universal | (?:universal permissive licen[sc]e|upl)
oracle-bcl | binary oracle | oracle binary code licen[sc]e
sun-public | sun | sun public licen[sc]e
sun-industry | sun sissl | (?:sun industry standards source licen[sc]e|sissl)
qpl | q qpl | (?:q public licen[sc]e|qpl)
intel | intel | intel open source licen[sc]e
nokia | nokia | nokia open source licen[sc]e
apple-public | apple apsl | (?:apple public source licen[sc]e|apsl)
apple-sample | apple | apple sample code licen[sc]e
ms-pl | microsoft ms | (?:microsoft public licen[sc]e|ms pl)
ms-rl | microsoft ms | (?:microsoft reciprocal licen[sc]e|ms rl)
ms-limited | microsoft | microsoft limited (?:public|reciprocal) licen[sc]e
ms-eula | microsoft | microsoft software licen[sc]e terms
academic | academic afl | (?:academic free licen[sc]e|afl)
educational | educational ecl | (?:educational community licen[sc]e|ecl)
open-software | osl software | (?:open software licen[sc]e|osl)
open-group | open | open group test suite licen[sc]e
open-market | market | open market licen[sc]e
open-publication | publication | open publication licen[sc]e
open-government | government ogl | (?:open government licen[sc]e|ogl)
open-game | game | open game licen[sc]e
fair | fair | fair licen[sc]e
simple-public | simpl simple | simple public licen[sc]e
sleepycat | sleepycat | sleepycat licen[sc]e
vovida | vovida | vovida software licen[sc]e
watcom | watcom | sybase open watcom public licen[sc]e
zope | zope zpl | (?:zope public licen[sc]e|zpl)
z-library | zed | zed licen[sc]e
latex-project | latex lppl | (?:latex project public licen[sc]e|lppl)
free-art | art | (?:free art licen[sc]e|licence art libre)
cecill | cecill | cecill(?: [abc])?(?: licen[sc]e)?
mulan | mulan | mulan (?:permissive software|psl)(?: licen[sc]e)?
blue-oak | oak | blue oak model licen[sc]e
hippocratic | hippocratic | hippocratic licen[sc]e
sspl | sspl side | (?:server side public licen[sc]e|sspl)
busl | bsl busl business | (?:business source licen[sc]e|busl)
elastic | elastic | elastic licen[sc]e
confluent | confluent | confluent community licen[sc]e
commons-clause | commons | commons clause(?: licen[sc]e condition)?
redis-source | redis | redis source available licen[sc]e
polyform | polyform | polyform (?:noncommercial|strict|shield|perimeter|small business|free trial|internal use)(?: licen[sc]e)?
parity | parity | parity public licen[sc]e
prosperity | prosperity | prosperity public licen[sc]e
json | json | json licen[sc]e
beerware | beer beerware | (?:beer ware|beerware) licen[sc]e
curl | curl | curl licen[sc]e
info-zip | zip | info zip licen[sc]e
bzip2 | bzip2 | bzip2(?: and libbzip2)? licen[sc]e
freetype | freetype | freetype(?: project)? licen[sc]e
ijg | jpeg ijg | (?:independent jpeg group|ijg licen[sc]e)
imagemagick | imagemagick | imagemagick licen[sc]e
netcdf | netcdf | netcdf licen[sc]e
ntp | ntp | ntp licen[sc]e
tcl | tcl | tcl(?: tk)? licen[sc]e
unicode | unicode | unicode (?:inc )?licen[sc]e agreement
vim | vim | vim licen[sc]e
llama | llama | llama (?:[0-9]+ )?(?:[0-9]+ )?community licen[sc]e
openrail | openrail rail | (?:creativeml )?open ?rail(?: (?:m|s|d))?(?: licen[sc]e)?
gemma | gemma | gemma terms of use
data-c-uda | computational | computational use of data agreement
cdla-permissive | cdla community | (?:community data licen[sc]e agreement|cdla) permissive
cdla-sharing | cdla community | (?:community data licen[sc]e agreement|cdla) sharing
etalab | etalab ouverte | (?:licence ouverte|etalab)(?: open licen[sc]e)?
dl-de | datenlizenz | datenlizenz deutschland(?: namensnennung| zero)?
kopimi | kopimi | kopimi
creative-commons | creative | creative commons(?: public)?(?: licen[sc]es?)?
"""

#: label | keywords | pattern.  Notices and grants that need no license's name.
_NOTICES = """
permission-mit | permission | permission is hereby granted free of charge to any person obtaining a copy
permission-isc | permission | permission to use copy modify and or distribute this software for any purpose
permission-hpnd | permission | permission to use copy modify and distribute this software and its documentation
redistribution-bsd | redistribution | redistribution and use in source and binary forms
redistribution-notice | redistributions | redistributions (?:of source code|in binary form) must (?:retain|reproduce)
endorsement-bsd | endorse | used to endorse or promote products derived
free-software | software | this (?:program|library) is free software
hope-useful | hope | distributed in the hope that it will be useful
warranty-none | warranty | without any warranty
warranty-as-is | warranty as | provided as is(?: without warranty)?
warranty-merchant | merchantability | implied warrant(?:y|ies) of merchantability
liability | event | in no event shall
origin-zlib | misrepresented | the origin of this software must not be misrepresented
you-may-obtain | obtain | you may obtain a copy of the licen[sc]e
may-not-use | compliance | may not use this (?:file|work) except in compliance
licensed-under | licensed | (?:dual )?licensed under(?: the)?(?: terms of)?
licensed-to | licensed | licensed to the apache software foundation
released-under | released | released under(?: the)?(?: terms of)?
subject-to | subject | subject to the terms(?: and conditions)?
spdx | spdx | spdx license identifier(?: [a-z0-9]+)?
copyright-c | copyright | copyright c(?: [0-9]{4})+
copyright-year | copyright | copyright(?: [0-9]{4})+
copyright-holder | copyright | copyright holders?
copyright-notice | copyright | (?:the )?above copyright notice
copyright-by | copyrighted | copyrighted (?:by|material)
rights-some | rights | some rights reserved
rights-no | rights | no rights reserved
rights-reserved | rights | all rights (?:are )?reserved
rights-tous | droits | tous droits reserves
rights-droits | droits | tous droits r\xe9serv\xe9s
rights-alle | rechte | alle rechte vorbehalten
rights-todos | derechos | todos los derechos reservados
proprietary | proprietary confidential | proprietary and confidential
trade-secret | secret secrets | trade secrets? of
noncommercial | noncommercial commercial | (?:non ?commercial|not for commercial) (?:use|purposes)(?: only)?
no-redistribution | reproduced redistributed republished | (?:may|must) not be (?:reproduced|redistributed|republished)
royalty-free | royalty | (?:perpetual |worldwide |irrevocable )*royalty free (?:copyright )?licen[sc]e
attribution-required | attribution | attribution (?:is )?required
fair-use | fair | fair use(?: doctrine)?
dmca | dmca digital | (?:dmca|digital millennium copyright act)
eula | eula end | (?:end user licen[sc]e agreement|eula)
terms-of-use | terms | terms of (?:use|service)
"""

_CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_VERSIONED = {
    "apache": ("apache", r"apache (?:software |public )?licen[sc]e", ("1 0", "1 1", "2 0")),
    "mpl": ("mozilla mpl", r"(?:mozilla public licen[sc]e|mpl)", ("1 0", "1 1", "2 0")),
    "epl": ("eclipse epl", r"(?:eclipse public licen[sc]e|epl)", ("1 0", "2 0")),
    "cddl": ("cddl", r"cddl", ("1 0", "1 1")),
    "eupl": ("eupl", r"eupl", ("1 0", "1 1", "1 2")),
    "artistic": ("artistic", r"artistic licen[sc]e", ("1 0", "2 0")),
    "boost": ("boost bsl", r"(?:boost software licen[sc]e|bsl)", ("1 0",)),
    "ofl": ("ofl font", r"(?:sil )?(?:open font licen[sc]e|ofl)", ("1 0", "1 1")),
    "afl": ("afl academic", r"(?:academic free licen[sc]e|afl)", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "osl": ("osl software", r"(?:open software licen[sc]e|osl)", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    "php": ("php", r"php licen[sc]e", ("3 0", "3 01")),
    "zpl": ("zope zpl", r"(?:zope public licen[sc]e|zpl)", ("1 1", "2 0", "2 1")),
    "python": ("python psf", r"(?:python|psf) licen[sc]e", ("2 0",)),
    "lppl": ("latex lppl", r"(?:latex project public licen[sc]e|lppl)", ("1 0", "1 1", "1 2", "1 3a", "1 3c")),
    "cecill": ("cecill", r"cecill(?: licen[sc]e)?", ("1 0", "1 1", "2 0", "2 1")),
    "gfdl": ("gfdl gnu", r"(?:gnu free documentation licen[sc]e|gfdl)", ("1 1", "1 2", "1 3")),
    "ogl-uk": ("ogl government", r"(?:open government licen[sc]e|ogl)", ("1 0", "2 0", "3 0")),
    "odbl": ("odbl", r"odbl", ("1 0",)),
    "busl": ("busl business", r"(?:business source licen[sc]e|busl)", ("1 0", "1 1")),
    "elastic": ("elastic", r"elastic licen[sc]e", ("1 0", "2 0")),
}
_GNU = {
    "gpl": ("gpl general", r"(?:gnu )?(?:general public licen[sc]e|gpl)", ("1", "2", "3")),
    "lgpl": ("lgpl lesser library", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", ("2", "2 1", "3")),
    "agpl": ("agpl affero", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", ("1", "3")),
}
_V = r"(?: as published by the free software foundation)?(?: either)? ?(?:version |v )?"


def _joined(keywords: str, version: str) -> str:
    """keywords, and the words that they form with a version that no space parts from them."""
    first = version.split()[0]
    return " ".join(k + tail for k in keywords.split() for tail in ("", "v", "version", first, f"v{first}"))


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first; equal ones in the order of the tables."""
    out = []
    for table, priority, confidence in ((_NAMES, 50, 0.8), (_NOTICES, 20, 0.5)):
        for line in table.strip().splitlines():
            label, keywords, pattern = line.split(" | ", 2)
            out.append(_rule(label.strip(), keywords, pattern.strip(), priority, confidence))
    for parts in _CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        long = " ".join(_CC_NAMES[p] for p in parts.split())
        weight = 60 + len(parts.split())
        out.append(_rule(label, "cc", f"cc {parts}", weight, 0.9))
        out.append(_rule(label, "creative", f"creative commons {long}", weight, 0.9))
        for version in _CC_VERSIONS:
            named = f"{label}-{version.replace(' ', '.')}"
            out.append(_rule(named, "cc creative", rf"(?:cc {parts}|creative commons {long}) (?:licen[sc]e )?(?:version )?{version}(?: international| unported| generic)?(?: licen[sc]e)?", weight + 20, 1.0))
    for family, (keywords, name, versions) in _VERSIONED.items():
        for version in versions:
            out.append(_rule(f"{family}-{version.replace(' ', '.')}", _joined(keywords, version), rf"{name} ?(?:version |v ?)?{version}", 80, 1.0))
    for family, (keywords, name, versions) in _GNU.items():
        for version in versions:
            dotted = version.replace(" ", ".")
            number = version if " " in version else rf"{version}(?: 0)?"
            weight, words = 80 + len(family), _joined(keywords, version)
            out.append(_rule(f"{family}-{dotted}-or-later", words, rf"{name}{_V}{number} (?:or (?:at your option )?(?:any )?later(?: version)?)", weight + 10, 1.0))
            out.append(_rule(f"{family}-{dotted}-only", words, rf"{name}{_V}{number} only", weight + 10, 1.0))
            out.append(_rule(f"{family}-{dotted}", words, rf"{name}{_V}{number}", weight, 1.0))
            out.append(_rule(f"{family}-{dotted}", f"{family}v{version.split()[0]}", rf"{family}v{number}", weight, 1.0))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(1)
def _gates() -> tuple[dict, frozenset]:
    by: dict = {}
    for at, rule in enumerate(rules()):
        for k in rule.keywords:
            by.setdefault(k, []).append(at)
    return by, frozenset(by) | {phrase[0] for _, phrase in BASE}


def _places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if tuple(words[at : at + n]) == phrase:
                out.append(at)
    except ValueError:
        return out


class Detection(NamedTuple):
    label: str
    first: int
    last: int
    priority: int
    confidence: float


def suppress(found: list[Detection]) -> list[Detection]:
    """Without those whose interval lies inside that of one that ranks before them."""
    stay: list[Detection] = []
    ends: list[tuple[int, int]] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.first - d.last, d.first, d.label)):
        if not any(a <= d.first and d.last <= b for a, b in ends):
            stay.append(d)
            ends.append((d.first, d.last))
    return stay


def detect(words: list[bytes], hits: frozenset | set) -> list[Detection]:
    by, _ = _gates()
    tried = sorted({at for k in hits for at in by.get(k, ())})
    if not tried:
        return []
    line = b" ".join(words)
    every, found = rules(), []
    starts: list[int] | None = None
    for at in tried:
        rule = every[at]
        for m in rule.pattern.finditer(line):
            if starts is None:
                starts, place = [], 0
                for w in words:
                    starts.append(place)
                    place += len(w) + 1
            first = _at(starts, m.start())
            found.append(Detection(rule.label, first, _at(starts, m.end() - 1), rule.priority, rule.confidence))
    # a text may repeat one notice thousands of times: compare only neighbours that can overlap
    found.sort(key=lambda d: d.first)
    out, group, reach = [], [], -1
    for d in found:
        if d.first > reach and group:
            out += suppress(group)
            group = []
        group.append(d)
        reach = max(reach, d.last)
    return out + suppress(group)


def _at(starts: list[int], offset: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, offset) - 1


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    hits = _gates()[1].intersection(words)
    if not hits:
        return len(words), 0, None, None, "", "", 0.0
    base = {label: places for label, phrase in BASE if phrase[0] in hits and (places := _places(words, phrase))}
    every = [p for places in base.values() for p in places]
    found = detect(words, hits)
    score = max([d.confidence for d in found] + [0.7] * bool(base), default=0.0)
    labels = sorted({d.label for d in found} | set(base))
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(labels), score


def scan_licenses(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``docs[keep]`` with the columns of ``scan``.

    n_base counts all places of the base phrases, first_word and last_word are their
    smallest and largest start.  labels has the base labels and those of the rules that
    suppression leaves.  score is the largest confidence of what was found, else 0.
    Null and empty texts have no words, no labels ('') and null places.  Repeated rows
    are scanned each; an empty table gives an empty result; columns outside ``keep``
    are not read.
    """
    fields = [(n, T.LongType(), pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [(n, T.StringType(), pa.string()) for n in ("base_labels", "labels")]
    fields += [("score", T.DoubleType(), pa.float64())]
    return map_texts(docs, lambda: lambda texts: list(zip(*map(scan, texts))), fields, keep, text)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``scan`` of each row; cases as in ``scan_licenses``."""
    return scan_licenses(docs)
