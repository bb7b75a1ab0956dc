"""Licence scan by ordered signature rules.

Texts are reduced to lower-case words joined by single blanks. Hundreds of signatures, each a
regular expression over such text, are tried only where their keyword occurs. Overlapping
detections are settled in the order of priority: one that lies inside a kept one is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Phrases that must always be found, whatever the rules say, and their labels: fixed values.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# One line per licence: label | keyword that must occur | name in words | short identifiers.
# In names, "a (b) c" is an expression over words; versions such as 2.0 are the words "2 0".
LICENCES = """
mit | mit | (?:the )?mit(?: x11)?(?: expat)? | mit
x11 | x11 | (?:the )?x11 | x11
apache-1 | apache | (?:the )?apache(?: software)?(?: license)?(?: version| v)? ?1(?: [01])? | apache 1 0,apache 1 1
apache-2 | apache | (?:the )?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)? | apache 2 0
bsd-2 | bsd | (?:the )?(?:(?:bsd )?(?:2|two) clause(?: bsd)?|simplified bsd|freebsd|bsd 2) | bsd 2 clause
bsd-3 | bsd | (?:the )?(?:(?:bsd )?(?:3|three) clause(?: bsd)?|new bsd|modified bsd|revised bsd|bsd 3) | bsd 3 clause
bsd-4 | bsd | (?:the )?(?:(?:bsd )?(?:4|four) clause(?: bsd)?|original bsd|bsd 4) | bsd 4 clause
0bsd | 0bsd | (?:the )?(?:0bsd|zero clause bsd) | 0bsd
isc | isc | (?:the )?isc | isc
gpl-1 | gpl-1 | (?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?1(?: 0)? | gpl 1 0
gpl-2 | gpl-2 | (?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?2(?: 0)? | gpl 2 0 only,gpl 2 0 or later,gpl 2 0
gpl-3 | gpl-3 | (?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?3(?: 0)? | gpl 3 0 only,gpl 3 0 or later,gpl 3 0
gpl | gpl | (?:the )?gnu (?:general public license|gpl) | gpl
lgpl-2 | lgpl-2 | (?:the )?(?:gnu )?(?:(?:library|lesser) general public license|lgpl)(?: lgpl)?(?: version| v)? ?2(?: [01])? | lgpl 2 0,lgpl 2 1
lgpl-3 | lgpl-3 | (?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: lgpl)?(?: version| v)? ?3(?: 0)? | lgpl 3 0
lgpl | lgpl | (?:the )?gnu (?:(?:library|lesser) general public license|lgpl) | lgpl
agpl-3 | agpl | (?:the )?(?:gnu )?(?:affero general public license|agpl)(?: agpl)?(?:(?: version| v)? ?3(?: 0)?)? | agpl 3 0
fdl | fdl | (?:the )?(?:gnu )?(?:free documentation license|fdl|gfdl)(?:(?: version| v)? ?1(?: [123])?)? | gfdl 1 1,gfdl 1 2,gfdl 1 3
mpl-1 | mpl | (?:the )?(?:mozilla public license|mpl)(?: version| v)? ?1(?: [01])? | mpl 1 0,mpl 1 1
mpl-2 | mpl | (?:the )?(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)? | mpl 2 0
epl-1 | epl | (?:the )?(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)? | epl 1 0
epl-2 | epl | (?:the )?(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)? | epl 2 0
edl | eclipse | (?:the )?eclipse distribution license(?:(?: version| v)? ?1(?: 0)?)? | edl 1 0
cddl | cddl | (?:the )?(?:common development and distribution license|cddl)(?:(?: version| v)? ?1(?: [01])?)? | cddl 1 0,cddl 1 1
cpl | common | (?:the )?common public license(?:(?: version| v)? ?1(?: 0)?)? | cpl 1 0
eupl | eupl | (?:the )?(?:european union public licen[cs]e|eupl)(?:(?: version| v)? ?1(?: [012])?)? | eupl 1 1,eupl 1 2
artistic | artistic | (?:the )?(?:perl )?artistic license(?:(?: version| v)? ?[12](?: 0)?)? | artistic 1 0,artistic 2 0
bsl | boost | (?:the )?boost software license(?:(?: version| v)? ?1(?: 0)?)? | bsl 1 0
zlib | zlib | (?:the )?zlib(?: libpng)? | zlib
libpng | libpng | (?:the )?libpng | libpng
openssl | openssl | (?:the )?openssl | openssl
psf | python | (?:the )?python software foundation(?: license)?(?:(?: version| v)? ?2(?: 0)?)? | psf 2 0,python 2 0
php | php | (?:the )?php(?: license)?(?:(?: version| v)? ?3(?: 0[01]?)?)? | php 3 0,php 3 01
ruby | ruby | (?:the )?ruby | ruby
vim | vim | (?:the )?vim | vim
wtfpl | wtfpl | (?:the )?(?:wtfpl|do what the fuck you want to public license)(?:(?: version| v)? ?2)? | wtfpl
unlicense | unlicense | (?:the )?unlicense | unlicense
ms-pl | microsoft | (?:the )?microsoft public license | ms pl
ms-rl | microsoft | (?:the )?microsoft reciprocal license | ms rl
afl | academic | (?:the )?academic free license(?:(?: version| v)? ?[123](?: [01])?)? | afl 2 1,afl 3 0
osl | open | (?:the )?open software license(?:(?: version| v)? ?[123](?: [01])?)? | osl 2 1,osl 3 0
ofl | ofl | (?:the )?(?:sil )?(?:open font license|ofl)(?:(?: version| v)? ?1(?: [01])?)? | ofl 1 0,ofl 1 1
odbl | database | (?:the )?open (?:data commons open )?database license(?:(?: version| v)? ?1(?: 0)?)? | odbl 1 0
odc-by | commons | (?:the )?open data commons attribution license(?:(?: version| v)? ?1(?: 0)?)? | odc by 1 0
cc0 | cc0 | (?:the )?(?:creative commons )?(?:cc0|zero)(?:(?: version| v)? ?1(?: 0)?)? | cc0 1 0
cc-by | cc-by | (?:the )?(?:creative commons attribution|cc by)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by 1 0,cc by 2 0,cc by 2 5,cc by 3 0,cc by 4 0
cc-by-sa | cc-by | (?:the )?(?:creative commons attribution share ?alike|cc by sa)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by sa 2 0,cc by sa 2 5,cc by sa 3 0,cc by sa 4 0
cc-by-nd | cc-by | (?:the )?(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by nd 3 0,cc by nd 4 0
cc-by-nc | cc-by | (?:the )?(?:creative commons attribution non ?commercial|cc by nc)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by nc 2 0,cc by nc 3 0,cc by nc 4 0
cc-by-nc-sa | cc-by | (?:the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by nc sa 3 0,cc by nc sa 4 0
cc-by-nc-nd | cc-by | (?:the )?(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?:(?: version| v)? ?[1-4](?: [05])?)? | cc by nc nd 3 0,cc by nc nd 4 0
"""

# Keywords that stand for several spellings; a keyword not listed here stands for itself.
SPELLINGS = {
    "gpl-1": (b"general public license", b"gpl"),
    "gpl-2": (b"general public license", b"gpl"),
    "gpl-3": (b"general public license", b"gpl"),
    "gpl": (b"general public license", b"gpl"),
    "lgpl-2": (b"lesser", b"library", b"lgpl"),
    "lgpl-3": (b"lesser", b"lgpl"),
    "lgpl": (b"lesser", b"library", b"lgpl"),
    "agpl": (b"affero", b"agpl"),
    "fdl": (b"free documentation", b"fdl"),
    "mpl": (b"mozilla", b"mpl"),
    "epl": (b"eclipse", b"epl"),
    "cddl": (b"common development", b"cddl"),
    "eupl": (b"european union", b"eupl"),
    "wtfpl": (b"wtfpl", b"do what the fuck"),
    "ofl": (b"open font", b"ofl"),
    "cc0": (b"cc0", b"creative commons zero"),
    "cc-by": (b"cc by", b"creative commons"),
}

# Ways to refer to a licence: kind, priority (lower goes first), confidence, expression.
# {name} is the licence's name and {ids} its short identifiers.
REFERENCES = [
    ("identifier", 1, 1.0, r"spdx license identifier (?:{ids})"),
    ("grant", 2, 0.95, r"(?:re)?(?:licen[cs]ed|released|distributed|published|provided|available|covered|shared)"
     r"(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?{name}(?: public)?(?: licen[cs]e)?"),
    ("subject", 3, 0.9, r"(?:subject to|governed by|in accordance with|compliance with) (?:the )?(?:terms of )?{name}"
     r"(?: licen[cs]e)?"),
    ("field", 4, 0.85, r"licen[cs]e {name}(?: licen[cs]e)?"),
    ("link", 5, 0.8, r"(?:opensource org|spdx org|choosealicense com|gnu org|creativecommons org) licenses? (?:{ids})"),
    ("mention", 6, 0.6, r"{name} licen[cs]e"),
    ("name", 7, 0.5, r"(?:gnu|creative commons|cc by|version|public license) ?(?:{ids})"),
]

# Statements that name no licence: label, keyword, priority, confidence, expression.
STATEMENTS = [
    ("all-rights-reserved", b"rights reserved", 2, 0.9, r"(?:copyright )?(?:[0-9]{4} )?all rights reserved"),
    ("all-rights-reserved", b"reserve", 3, 0.8, r"reserves? all rights"),
    ("public-domain", b"public domain", 2, 0.9, r"(?:released|dedicated|placed|put)(?: \w+)? (?:in)?to the public domain"),
    ("public-domain", b"public domain", 3, 0.8, r"(?:is|are) in the public domain"),
    ("proprietary", b"proprietary", 3, 0.8, r"proprietary and confidential"),
    ("proprietary", b"unauthori", 3, 0.7, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \w+){0,6} prohibited"),
    ("proprietary", b"permission", 3, 0.6, r"may not be (?:copied|reproduced|distributed)(?: \w+){0,6} without (?:prior )?(?:written )?permission"),
    ("mit", b"permission is hereby granted", 1, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", b"permission to use", 1, 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-3", b"neither the name", 1, 0.9, r"neither the name of(?: \w+){1,12} may be used to endorse or promote products"),
    ("unlicense", b"unencumbered", 1, 1.0, r"free and unencumbered software released into the public domain"),
    ("zlib", b"altered source", 1, 0.9, r"altered source versions must be plainly marked as such"),
    ("apache-2", b"basis without warranties", 1, 0.7, r"on an as is basis without warranties or conditions of any kind"),
    ("copyright", b"copyright", 8, 0.3, r"copyright (?:c )?(?:[0-9]{4})(?: [0-9]{4})?"),
]

# A text without any of these words can match no rule.
ROOTS = (
    b"licen", b"copyright", b"rights", b"public domain", b"spdx", b"creative commons", b"cc ",
    b"gpl", b"gnu", b"proprietary", b"unauthori", b"permission", b"neither the name",
    b"unencumbered", b"altered source", b"warranties", b" under ", b"subject to", b"governed",
    b"compliance", b"accordance", b"version",
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def _compiled(expression: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<= )(?:" + expression.encode() + rb")(?= )")


def build_rules() -> list[Rule]:
    """Every way of reference to every licence, then the free statements, by priority."""
    rules = []
    for line in LICENCES.strip().splitlines():
        label, keyword, name, ids = (part.strip() for part in line.split(" | "))
        keywords = SPELLINGS.get(keyword, (keyword.encode(),))
        either = "|".join(sorted(ids.split(","), key=len, reverse=True))
        for kind, priority, confidence, reference in REFERENCES:
            pattern = _compiled(reference.format(name=f"(?:{name})", ids=either))
            known = () if kind in ("identifier", "link", "name") else keywords
            first = tuple(i.split(" ")[0].encode() for i in ids.split(","))
            rules.append(Rule(label, kind, priority, confidence, known or first, pattern))
    for label, word, priority, confidence, expression in STATEMENTS:
        rules.append(Rule(label, "statement", priority, confidence, (word,), _compiled(expression)))
    return sorted(rules, key=lambda r: r.priority)


# Everything that is not part of a word becomes a blank; A-Z become a-z. Bytes from 0x80 on
# belong to words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def base_places(joined: bytes) -> list[tuple[int, int, str]]:
    """All places of the base phrases as (start, end, label), in characters of ``joined``."""
    found = []
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        while at >= 0:
            found.append((at + 1, at + len(needle) - 1, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


def scan(joined: bytes, rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Detections in ``joined`` (words with a blank before, between and after) that remain."""
    if not any(root in joined for root in ROOTS):
        return []
    seen: dict[bytes, bool] = {}

    def occurs(word: bytes) -> bool:
        if word not in seen:
            seen[word] = word in joined
        return seen[word]

    hits = []
    for rule in rules:
        if any(occurs(w) for w in rule.keywords):
            hits.extend((m.start(), m.end(), rule) for m in rule.pattern.finditer(joined))
    # By priority, the longer first; what lies inside a kept detection is dropped. Of the kept ones those
    # that lie in no other are listed by start; their ends grow too, so the last to start before decides.
    hits.sort(key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label))
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in hits:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low : max(low, high)] = [start]
        ends[low : max(low, high)] = [end]
    return sorted(kept, key=lambda h: h[:2])


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)


def scan_licences(
    documents: DataFrame,
    rules: list[Rule] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_words, found)`` for every row of ``documents``.

    ``found`` lists detections as (label, kind, first_word, words, confidence), words counted
    from 0; kind ``base`` marks the places of the base phrases, which nothing suppresses and
    which have confidence 1. The others follow the rules.

    * A null or empty text has no words and an empty list. Texts are scanned whole, whatever
      their length. Repeated rows and null ids stay as they are. Other columns are ignored; an
      empty table gives an empty result.
    """
    id_type = documents.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("found", FOUND),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = build_rules() if rules is None else rules
        kind = pa.list_(
            pa.struct(
                [
                    ("label", pa.string()),
                    ("kind", pa.string()),
                    ("first_word", pa.int64()),
                    ("words", pa.int64()),
                    ("confidence", pa.float64()),
                ]
            )
        )
        for batch in batches:
            counts, rows = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                joined = b" " + b" ".join(words) + b" "
                hits = [(a, b, label, "base", 1.0) for a, b, label in base_places(joined)]
                hits += [(a, b, r.label, r.kind, r.confidence) for a, b, r in scan(joined, ordered)]
                counts.append(len(words))
                # Every word has one blank before it: its place counts the words ahead.
                blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20) if hits else None
                rows.append(
                    [
                        {
                            "label": label,
                            "kind": way,
                            "first_word": int(np.searchsorted(blanks, a)) - 1,
                            "words": int(np.searchsorted(blanks, b) - np.searchsorted(blanks, a)) + 1,
                            "confidence": confidence,
                        }
                        for a, b, label, way, confidence in hits
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, kind)],
                names=schema.names,
            )

    return documents.select(id_col, text_col).mapInArrow(run, schema)
