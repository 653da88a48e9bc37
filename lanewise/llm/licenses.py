"""License scans by template-markup matching.

A template is license wording with marked regions: ``<<optional: words>>`` may
be absent, ``<<any: n>>`` stands for up to n words of any kind (names, years).
It compiles to an automaton over words.  A text is accepted at a place if the
mandatory words follow there exactly.  Next to the templates, base phrases are
counted wherever their words stand one after another.

Words are runs of digits, letters and characters beyond ASCII, after A-Z are
lower-cased.  Null and empty texts have no words, no places, empty labels and
score 0.  Rows stay as they are, repeated or not, one result each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lanewise.llm.arrays import documents

# Phrases and labels of the base count.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# License wording with marked regions, by label.
TEMPLATES = {
    "text:apache-2.0-notice":
        "licensed under the apache license version 2 0 <<optional: the license>>",
    "text:mit-notice": "released under the <<any: 2>> mit license",
    "text:gpl-3-notice":
        "licensed under the gnu general public license version 3 <<optional: or any later version>>",
    "text:cc-by-nc-4.0": "licensed under <<optional: a creative commons>> cc by nc 4 0",
    "text:cc-by-4.0": "licensed under <<optional: a creative commons>> cc by 4 0",
    "text:mit":
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " <<any: 8>> to deal in <<any: 8>> without restriction",
    "text:bsd":
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met",
    "text:isc":
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that",
    "text:reserved": "copyright <<any: 8>> all rights reserved",
}

_OUTSIDE = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in set(_OUTSIDE) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_REGION = re.compile(r"<<(optional|any): ([^>]*)>>|(\S+)")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass(frozen=True)
class Automaton:
    """States in a row; a state has its word (None: any) and where it may jump without one."""

    label: str
    words: tuple[bytes | None, ...]
    jumps: tuple[tuple[int, ...], ...]
    anchor: bytes

    def _open(self, states: set[int]) -> set[int]:
        todo, out = list(states), set()
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.jumps[s] if s < len(self.words) else ()
        return out

    def end(self, words: list[bytes], start: int) -> int | None:
        """The longest accepted end from a start, if any."""
        states, best, final = self._open({0}), None, len(self.words)
        for i in range(start, len(words) + 1):
            if final in states:
                best = i
            if i == len(words) or not states:
                break
            states = self._open({
                s + 1 for s in states if s < final and self.words[s] in (None, words[i])})
        return best


def compiled(label: str, template: str) -> Automaton:
    words: list[bytes | None] = []
    jumps: dict[int, tuple[int, ...]] = {}
    for kind, inner, word in _REGION.findall(template):
        if word:
            words.append(word.encode())
        elif kind == "optional":
            inside = words_of(inner.encode())
            jumps[len(words)] = (len(words) + len(inside),)
            words += inside
        else:
            for _ in range(int(inner)):
                jumps[len(words)] = (len(words) + 1,)
                words.append(None)
    first = next(i for i in range(len(words) + 1) if i in jumps or i == len(words))
    if not first:
        raise ValueError("a template starts with mandatory words")
    anchor = b" " + b" ".join(words[:first]) + b" "
    return Automaton(label, tuple(words), tuple(jumps.get(i, ()) for i in range(len(words))), anchor)


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase, given between spaces, starts."""
    out, at = [], line.find(phrase)
    before, counted = 0, 0
    while at >= 0:
        counted += line.count(b" ", before, at)
        before = at
        out.append(counted)
        at = line.find(phrase, at + 1)
    return out


@dataclass(frozen=True)
class Finding:
    n_words: int
    base: tuple[tuple[int, str], ...]
    spans: tuple[tuple[int, int, str], ...]


def scan_text(text: bytes | None, automata: list[Automaton], base: dict[str, str]) -> Finding:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    found = [
        (at, label) for phrase, label in base.items()
        for at in _places(line, b" " + phrase.encode() + b" ")
    ]
    spans = []
    for a in automata:
        for at in _places(line, a.anchor):
            end = a.end(words, at)
            if end is not None:
                spans.append((at, end, a.label))
    return Finding(len(words), tuple(found), tuple(spans))


def scan(df: DataFrame, templates: dict[str, str] | None = None,
         base: dict[str, str] | None = None) -> DataFrame:
    """Per document its words, base places and labels, template spans and score.

    The score is 1 - 0.5 ** (base places + 2 * accepted template places): 0
    without any, near 1 for a text that carries whole license wording.
    """
    templates, base = templates or TEMPLATES, base or BASE

    def run(batches):
        automata = [compiled(label, t) for label, t in templates.items()]
        for batch in batches:
            out = [scan_text(t, automata, base) for t in batch.column("text").to_pylist()]
            starts = [[at for at, _ in f.base] for f in out]
            own = [{label for _, label in f.base} for f in out]
            every = [o | {s[2] for s in f.spans} for o, f in zip(own, out)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([f.n_words for f in out], pa.int64()),
                pa.array([len(s) for s in starts], pa.int64()),
                pa.array([min(s, default=None) for s in starts], pa.int64()),
                pa.array([max(s, default=None) for s in starts], pa.int64()),
                pa.array([",".join(sorted(x)) for x in own], pa.string()),
                pa.array([",".join(sorted(x)) for x in every], pa.string()),
                pa.array([1 - 0.5 ** (len(f.base) + 2 * len(f.spans)) for f in out], pa.float64()),
                pa.array([[f"{a}-{b}:{label}" for a, b, label in f.spans] for f in out],
                         pa.list_(pa.string())),
            ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                "score", "spans"])

    return documents(df).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
             " base_labels string, labels string, score double, spans array<string>")
