import re

import pytest

from postloom.llm import licences
from tests.llm.helpers import ODD_TEXTS, documents

RULES = licences.build_rules()


def labels(text):
    joined = b" " + b" ".join(licences.words_of(text)) + b" "
    found = [r.label for _, _, r in licences.scan(joined, RULES)]
    return sorted({*found, *[label for _, _, label in licences.base_places(joined)]})


def test_there_are_hundreds_of_ordered_rules():
    assert len(RULES) > 300
    assert [r.priority for r in RULES] == sorted(r.priority for r in RULES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("SPDX-License-Identifier: LGPL-2.1", ["lgpl-2"]),
        ("distributed under the terms of the GNU Lesser General Public License v3", ["lgpl-3"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
        ("licensed under the Mozilla Public License 2.0", ["mpl-2"]),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0", []),
        ("licensed under the Creative Commons Attribution-ShareAlike 4.0", ["cc-by-sa"]),
        ("no such thing as a licence here, only versions", []),
        ("commit and submit under the mitten", []),
    ],
)
def test_labels(text, want):
    assert labels(text) == want


def test_what_lies_inside_a_kept_detection_is_dropped():
    joined = b" " + b" ".join(licences.words_of("licensed under the gnu general public license version 3")) + b" "
    found = licences.scan(joined, RULES)
    assert [(r.label, r.kind) for _, _, r in found] == [("gpl-3", "grant")]


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licences.BASE_PHRASES.items():
        part = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(part)] == part]
    return len(words), sorted(places)


def test_base_phrases_of_all_kinds_of_texts(spark):
    texts = [
        *ODD_TEXTS,
        "under the MIT license under-the_mit license CC BY-NC: Apache License, Version 2",
        "under the mit licensé cc by nc cc by ncé",
        "word " * 50_000 + "under the MIT license" + " word" * 50_000,
        "Under the mit license",
    ]
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = sorted((f["first_word"], f["label"]) for f in rows[i]["found"] if f["kind"] == "base")
        assert (rows[i]["n_words"], base) == brute_base(text)
    assert licences.scan_licences(df.where("false")).collect() == []


def test_gates_and_intervals_change_nothing(monkeypatch):
    """The same rules tried everywhere, with every kept detection compared."""
    import random
    from dataclasses import replace

    draw = random.Random(4)
    phrases = [
        "licensed under the gnu general public license version 3", "spdx license identifier mit", "all rights reserved",
        "under the mit license", "the apache license version 2 0", "cc by nc", "creative commons attribution", "gpl 3", "x", "see",
    ]
    open_rules = [replace(r, keywords=(b"",)) for r in RULES]
    for _ in range(60):
        joined = b" " + " ".join(draw.choices(phrases, k=draw.randrange(1, 30))).encode() + b" "
        kept = []
        hits = [(m.start(), m.end(), r) for r in open_rules for m in r.pattern.finditer(joined)]
        for a, b, r in sorted(hits, key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label)):
            if not any(c <= a and b <= d for c, d, _ in kept):
                kept.append((a, b, r))
        want = sorted((a, b, r.label, r.kind) for a, b, r in kept)
        assert sorted((a, b, r.label, r.kind) for a, b, r in licences.scan(joined, RULES)) == want


def test_a_long_text_of_licences_takes_time_in_proportion(spark):
    import time

    text = "see under the mit license and cc by nc , " * 20_000
    start = time.time()
    row = licences.scan_licences(documents(spark, [text])).collect()[0]
    assert time.time() - start < 60
    places = [f["first_word"] for f in row["found"] if f["kind"] == "base"]
    assert len(places) == 40_000 and places[:2] == [1, 6] and max(places) == row["n_words"] - 3
