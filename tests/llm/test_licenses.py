import re

import pytest

from lanewise.llm import licenses
from llm_cases import lower


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_base_equals_brute_force(spark, wide, awkward):
    more = [(900, "CC-BY CC BY; all rights reserved all rights reserved"), (901, "cc bye, occ by"),
            (902, "General\nPublic\tLicense\x1c general public license ﬀ cc—by cc by"), (903, "cc cc by by")]
    docs = wide.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = licenses.scan(docs).collect()
    want = sorted(((d, *brute(t)) for d, t in awkward + more), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                   for r in got), key=str) == want
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("text, label", [
    ("Licensed under the Apache License, Version 2.0.", "text:apache-2.0-notice"),
    ("Released under the MIT License.", "text:mit-notice"),
    ("Released under the so called MIT License.", "text:mit-notice"),
    ("licensed under the GNU General Public License, version 3.", "text:gpl-3-notice"),
    ("Licensed under a Creative Commons CC BY 4.0", "text:cc-by-4.0"),
    ("Copyright (c) 2020 Some Body. All rights reserved", "text:reserved"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
     " documents, to deal in the Software without restriction", "text:mit"),
])
def test_templates(text, label):
    automata = [licenses.compiled(k, t) for k, t in licenses.TEMPLATES.items()]
    assert label in {s[2] for s in licenses.scan_text(f"x {text} y".encode(), automata, {}).spans}


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 3.0.", "Released under the very much loved MIT License.",
    "Licensed under a Commons CC BY 4.0", "Unlicensed under CC BY 4.0",
])
def test_mandatory_words_have_to_match(text):
    automata = [licenses.compiled(k, t) for k, t in licenses.TEMPLATES.items()]
    assert not licenses.scan_text(text.encode(), automata, {}).spans


def test_longest_end_and_markup():
    a = licenses.compiled("x", "a b <<optional: c d>> <<any: 2>> e <<optional: f>>")
    assert a.end(b"a b c d q e f g".split(), 0) == 7
    assert a.end(b"a b q q e".split(), 0) == 5
    assert a.end(b"a b q q q e".split(), 0) is None
    assert a.end(b"a b".split(), 0) is None
    with pytest.raises(ValueError):
        licenses.compiled("x", "<<any: 1>> a")


def test_empty_table(nothing):
    assert licenses.scan(nothing).count() == 0
