import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lanewise.llm import repeats


def brute(rows):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - 49 if doc is not None else 0):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49 if doc is not None else 0):
            if first[b[p:p + 50]] < doc:
                gone[p:p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_equals_brute_force(wide, awkward):
    got = sorted((tuple(r) for r in repeats.remove(wide).collect()), key=str)
    want = sorted((r[:5] for r in brute(awkward)), key=str)
    assert got == want
    assert sum(r[2] for r in want) > 1000


def test_cut_keeps_rows_and_columns(wide, awkward):
    out = repeats.cut(wide)
    assert out.columns == wide.columns
    want = [(r[0], None if t is None else r[5].decode("utf-8", "ignore"))
            for r, (_, t) in zip(brute(awkward), awkward)]
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_empty_table(nothing):
    assert repeats.remove(nothing).count() == 0
    assert repeats.cut(nothing).columns == nothing.columns


@pytest.mark.parametrize("text", [b"", b"a", b"abc" * 140, b"\0" * 90, bytes(range(256)) * 2], ids=range(5))
def test_suffix_array(text):
    r = random.Random(1)
    for data in (text, bytes(r.choice(b"ab") for _ in range(700))):
        a = np.frombuffer(data, np.uint8)
        order, group = repeats.suffix_array(a, 50)
        prefixes = [data[i:i + 50] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and prefixes == sorted(prefixes)
        common = repeats.common_prefixes(a, order, group, 50)
        for k in range(1, len(order)):
            x, y = prefixes[k - 1], prefixes[k]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert common[k] == same


def test_pieces_of_a_shard_merge():
    r = random.Random(6)
    base = bytes(r.choice(b"abcd") for _ in range(400))
    strings, least, seen = repeats.Strings(), {}, []
    for piece in range(5):
        text = base[piece * 40: piece * 40 + 200] + bytes(r.choice(b"xyz") for _ in range(100))
        a = np.frombuffer(text, np.uint8)
        starts = np.arange(len(a) - 49)
        docs = np.array([r.randrange(100) for _ in starts])
        seen.append((text, strings.merge(a, starts, docs)))
        for s, d in zip(starts, docs.tolist()):
            least[text[s:s + 50]] = min(d, least.get(text[s:s + 50], d))
    assert len(strings.least) == len(least) and list(strings.keys) == sorted(strings.keys)
    for text, numbers in seen:
        for s, n in enumerate(numbers):
            assert strings.least[n] == least[text[s:s + 50]]


@pytest.mark.parametrize("window", [1, 50, 333])
def test_windows_change_nothing(wide, awkward, monkeypatch, window):
    whole = [repeats.Runs(*chunk_of(awkward))]
    monkeypatch.setattr(repeats, "WINDOW", window)
    monkeypatch.setattr(repeats, "SPAN", 7)
    whole.append(repeats.Runs(*chunk_of(awkward)))
    for name in ("low", "count", "doc", "gram"):
        a, b = (getattr(w, name).tolist() for w in whole)
        assert a == b and a
    if window > 1:
        got = sorted((tuple(r) for r in repeats.remove(wide).collect()), key=str)
        assert got == sorted((r[:5] for r in brute(awkward)), key=str)


def chunk_of(rows):
    texts = [(t or "").encode() for _, t in rows]
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])


def test_memory_for_a_very_long_text():
    """The places of a text of 50 MB take no more than some bytes for each of its bytes."""
    code = """
import resource, numpy as np
from lanewise.llm import repeats
data = np.random.default_rng(1).integers(97, 123, 50_000_000, np.uint8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert repeats.Runs(data, np.array([len(data)])).count.sum() == len(data) - repeats.LENGTH + 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(data))
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True,
                          cwd=Path(__file__).resolve().parents[2])
    assert float(used.stdout) < 24
