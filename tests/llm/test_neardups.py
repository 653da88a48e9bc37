import random
from collections import defaultdict

import numpy as np

from lanewise.llm import neardups
from lanewise.llm.components import components
from llm_cases import brute_words


def brute(rows, words):
    sets = []
    for doc, text in rows:
        w = brute_words(text)
        grams = [tuple(w)] if 0 < len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)]
        sets.append((doc, frozenset(grams if w else [])))
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            if a != b and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def test_equals_brute_force(docs, awkward):
    got = sorted((tuple(r) for r in neardups.classes(docs, 4, 80).collect()), key=str)
    assert got == brute(awkward, 4)


def test_one_of_each_group_stays(wide, awkward):
    component = {d: c for d, _, c in brute(awkward, 5)}
    kept = neardups.keep_one(wide)
    assert kept.columns == wide.columns
    wanted = sorted((d for d, _ in awkward if d is None or component[d] == d), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == wanted


def test_empty_table(nothing):
    assert neardups.classes(nothing).count() == 0
    assert neardups.keep_one(nothing).columns == nothing.columns


def test_registers_merge_and_agree_like_the_sets():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 900).astype(np.uint64), r.integers(0, 1 << 63, 100).astype(np.uint64)
    x, y, both, tiny = neardups.registers([a, np.append(a[100:], b), np.append(a, b), a[:1]])
    assert (np.maximum(x, y) == both).all()
    assert abs((x == y).mean() - 800 / 1000) < 0.08
    assert (neardups.registers([a])[0] == x).all() and (tiny > 0).all()
    n = np.array([900.0])
    assert neardups.likely(x[None], y[None], n, n, 0.8)[0]
    far = neardups.registers([b.repeat(9) + np.arange(900, dtype=np.uint64)])
    assert not neardups.likely(x[None], far, n, n, 0.8)[0]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    parent = defaultdict(lambda: None)
    for e in edges:
        for v in e:
            parent[v] = v

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.a: r.b for r in got} == {v: root(v) for v in parent if root(v) != v}
    assert len(got) == len({r.a for r in got})


def _close_group(count, seed):
    """Texts of 40 shared phrases each, so that many pairs lie around the threshold and few chains form."""
    r = random.Random(seed)
    phrases = [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(9)) for _ in range(60)]
    rows = []
    for i in range(count):
        held = list(phrases[:30]) + r.sample(phrases[30:], 10)
        if rows and r.random() < 0.1:  # and some pairs above it
            held = r.choice(rows)[1].split(" | ")
            held[r.randrange(len(held))] = f"own {i}"
        rows.append((i * 7 % (count * 7 + 1), " | ".join(held)))
    r.shuffle(rows)
    return rows


def test_no_link_of_close_texts_is_lost_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardups, "TILE_MEMBERS", 60)
    rows = _close_group(400, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((tuple(x) for x in neardups.classes(df, 4, 80).collect()), key=str)
    assert got == brute(rows, 4)


def test_one_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:280_000])), (3, " ".join(words[:200_000])), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in neardups.classes(df, 4, 80).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_overlap_by_whole_numbers():
    a = np.arange(4, dtype=np.uint64)
    assert neardups._overlap(a, np.arange(5, dtype=np.uint64), 80)
    assert not neardups._overlap(a, np.arange(6, dtype=np.uint64), 80)
    assert not neardups._overlap(a, a + np.uint64(4), 80)
