import random
import time

import numpy as np
import pytest

from lanewise.llm import leaks


def edits(item, text):
    """Fewest edits from the item to any part of the text."""
    cost = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, cost = cost, [i]
        for j, b in enumerate(text, 1):
            cost.append(min(before[j] + 1, cost[-1] + 1, before[j - 1] + (a != b)))
    return min(cost)


@pytest.fixture(scope="module")
def items():
    r = random.Random(9)
    syllables = ["the", "ra", "on", "er", "st", "bl", "ing", "ou", "an", "ti"]
    return [(i, " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
                         for _ in range(r.randrange(15, 40)))) for i in range(12)]


@pytest.fixture(scope="module")
def texts(items):
    r = random.Random(4)
    out = []
    for n in range(120):
        _, item = r.choice(items)
        words = list(item)
        for _ in range(r.randrange(14)):
            at = r.randrange(len(words))
            words[at] = r.choice(["", "x", words[at] + "q"])
        out.append((n, "Before THE start, " + "".join(words) + " after it."))
    return out


def test_equals_full_alignment(spark, items, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for doc, text in texts:
        for item, own in items:
            a, b = leaks.folded(own.encode()), leaks.folded(text.encode())
            n = edits(b" " + a + b" ", b" " + b + b" ")
            if n <= int(leaks.EDIT_RATE * len(a)):
                want[(doc, item)] = n
    got = leaks.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want
    several = leaks.find(docs, bench, block_bytes=900).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in several} == want
    assert 20 < len(want) < 120


@pytest.mark.parametrize("rate", [0.05, 0.2])
@pytest.mark.parametrize("hits, window", [(1 << 20, 1 << 18), (3, 40)])
def test_items_of_all_lengths_against_full_alignment(monkeypatch, rate, hits, window):
    monkeypatch.setattr(leaks, "_HITS", hits)
    monkeypatch.setattr(leaks, "_WINDOW", window)
    r = random.Random(int(rate * 100))
    words = ["ab", "ba", "aab", "b", "abba", "baab", "a"]
    own = [" ".join(r.choice(words) for _ in range(r.randrange(1, 16))).encode() for _ in range(60)]
    own += [own[0], b"one two", b"a" * 22]
    held = leaks.blocks([(7, t) for t in own], leaks.Q, rate)
    hit = 0
    for _ in range(60):
        text = list(b" ".join(r.choice(own) for _ in range(r.randrange(1, 4))))
        for _ in range(r.randrange(4)):
            text[r.randrange(len(text))] = r.choice(b"abc")
        text = leaks.folded(bytes(text))
        want = {}
        for n, item in enumerate(own):
            cost = edits(b" " + item + b" ", b" " + text + b" ")
            if cost <= int(rate * len(item)):
                want[n] = cost
        got = leaks.search(text, held)
        assert {n: e for n, e, _, _ in got} == want
        for n, cost, a, b in got:
            assert 0 <= a < b <= len(text)
            if not cost:
                assert text[a:b] == own[n]
        assert bool(want) == (next(leaks.matches(text, held), None) is not None)
        hit += len(want)
    assert hit > 200


def test_short_items_count_as_whole_words():
    held = leaks.blocks([(1, b"one two"), (2, b"one two three"), (3, b"x"), (None, b"bone"), (4, b" ")], 12, 0.05)
    assert leaks.search(b"bone two threefold", held) == []
    assert leaks.search(b"one two three x", held) == [(0, 0, 0, 7), (1, 0, 0, 13), (2, 0, 14, 15)]
    one_edit = leaks.blocks([(1, b"abcd efgh ijkl mnop")], 12, 0.06)
    assert [e for _, e, _, _ in leaks.search(b"abcd efgh ijkx mnop", one_edit)] == [1]
    assert leaks.search(b"abcd efgh xjkx mnop", one_edit) == []


def test_distances_of_anchored_and_free_starts():
    r = random.Random(2)
    for _ in range(80):
        a, b = (bytes(r.choices(b"abc", k=r.randrange(1, 70))) for _ in range(2))
        free, anchored = [len(a)], [len(a)]
        rows = [list(range(len(a) + 1))] * 2
        for letter in b:
            for own, out, first in ((0, free, 0), (1, anchored, len(anchored))):
                before, now = rows[own], [first]
                for i, c in enumerate(a, 1):
                    now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (c != letter)))
                rows[own] = now
                out.append(now[-1])
        assert leaks.distances(a, b, False) == free
        assert leaks.distances(a, b, True) == anchored


def test_items_that_share_a_line_and_long_texts():
    r = random.Random(8)
    line = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(r.randrange(90)) for _ in range(40))
    own = [(i, f"{line} {i} {' '.join(str(r.random()) for _ in range(12))}".encode()) for i in range(2_000)]
    held = leaks.blocks(own, leaks.Q, leaks.EDIT_RATE)
    begin = time.monotonic()
    assert leaks.search(leaks.folded(f"before {line} after ".encode() * 3), held) == []
    found = leaks.search(leaks.folded(b"x " * 600_000 + own[77][1] + b" y" * 300_000 + b" " + own[5][1]), held)
    assert [(n, e) for n, e, _, _ in found] == [(5, 0), (77, 0)]
    assert time.monotonic() - begin < 60
    # one item of equal letters in a text of them
    same = leaks.blocks([(1, b"a" * 3_000)], leaks.Q, leaks.EDIT_RATE)
    assert leaks.search(b"a" * 20_000, same) == [(0, 1, 0, 3_000)]
    assert leaks.search(b"a" * 3_000, same) == [(0, 0, 0, 3_000)]


def test_align_gives_the_place():
    assert leaks.align(b"abcdef", b"xxabcdefxx", 1) == (0, 2, 8)
    cost, start, end = leaks.align(b"abcdef", b"xxabXdefxx", 2)
    assert (cost, start, end) == (1, 2, 8)
    assert leaks.align(b"abcdef", b"zzzz", 2) is None


def test_grams_tell_apart():
    a = np.frombuffer(b"abcabcabcabcabcd", np.uint8)
    for q in (1, 3, 5, 12, 16):
        got = leaks.grams(a, q)
        kinds = [a[i:i + q].tobytes() for i in range(len(a) - q + 1)]
        assert len(got) == len(kinds) and len(set(got.tolist())) == len(set(kinds))


def test_awkward_rows(spark, wide, nothing, awkward):
    bench = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "One, two", "x"), (None, "the", "x"), (3, "one two", None)],
        "item_id bigint, text string, doc_id string")
    found = leaks.find(wide, bench)
    assert {r.doc_id for r in found.collect()} == {403, 404}
    kept = leaks.decontaminate(wide, bench)
    assert kept.columns == wide.columns
    assert kept.count() == len(awkward) - 2
    assert leaks.find(nothing, bench).count() == 0
    assert leaks.decontaminate(wide, bench.limit(0)).count() == len(awkward)


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_rows_are_judged_one_by_one(spark, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    leak = [f"before {text} after" for _, text in items]
    rows = [(None, leak[0], "x"), (None, "clean", "x"), (None, "clean", "y"), (None, None, "x"),
            (7, leak[1], "x"), (7, "clean as well", None), (7, leak[2], "y"), (8, leak[3], "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _leak string").repartition(2)
    kept = leaks.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [r for r in rows if r[1] not in leak], key=str)
