import hashlib
import math
import random

import numpy as np
import pytest

from lanewise.llm import vectorcodes

LAYOUT = "vec_id bigint, embedding array<float>, label int, x string, part int, away string, error string, `of` int"


def brute(rows, entries=64, rounds=2, parts=16):
    def usable(v):
        return v is not None and len(v) and len(v) % parts == 0 and all(
            c is not None and math.isfinite(c) for c in v)

    kept = [(i, label, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts
    cut = [[x[j * width:(j + 1) * width] for j in range(parts)] for _, _, x in kept]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]

    def nearest(j, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        members = {}
        for c in cut:
            for j in range(parts):
                members.setdefault((j, nearest(j, c[j])[1]), []).append(c[j])
        for (j, k), own in members.items():
            books[j][k] = [sum(x) // len(own) for x in zip(*own)]
    text = ",".join(str(v) for b in books for e in b for v in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    found, errors = [], {}
    for (i, label, _), c in zip(kept, cut):
        best = [nearest(j, c[j]) for j in range(parts)]
        error = sum(d for d, _ in best)
        errors[label] = errors.get(label, 0) + error
        found.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return sorted(((i, code, error, errors[label], digest) for i, code, error, label in found), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, *[None] * 5) for i, v, label in rows], LAYOUT).repartition(3)


def coded(df, **options):
    return sorted((tuple(r) for r in vectorcodes.codes(df, **options).collect()), key=str)


def sample(seed, n, length=32):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(length)] for _ in range(9)]
    return [(i, [c + r.gauss(0, .2) for c in r.choice(centres)], r.choice([None, 1, 1, 1, 2, 7])) for i in range(n)]


def test_equals_brute_force(spark):
    rows = sample(3, 260)
    rows += [(1000 + i, rows[5][1], 1) for i in range(20)]  # ties
    rows += [rows[7]] * 3 + [(7, rows[9][1], None)]  # repeated rows and a vec_id of two vectors
    rows += [(None, rows[3][1], 2), (2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1),
             (2003, [float("-inf")] + [0.0] * 31, 1), (2004, [1.0] * 48, 1), (2005, [1.0] * 20, 1), (2006, [], 1),
             (2007, [0.0] * 32, 9), (2008, [-0.001] * 32, 9)]
    assert coded(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("pivots", [1, 3, 64])
def test_pivots_do_not_change_the_codes(spark, pivots):
    rows = sample(5, 90)
    assert coded(table(spark, rows), pivots=pivots) == brute(rows)


def test_few_rows_equal_entries_and_none(spark):
    few = sample(6, 5, 16)
    assert coded(table(spark, few)) == brute(few)
    same = [(i, [0.5] * 16, None) for i in range(100)]  # all entries alike: the lowest index, the others unused
    assert coded(table(spark, same)) == brute(same)
    assert {r[1] for r in coded(table(spark, same))} == {"00" * 16}
    assert coded(table(spark, [])) == []
    assert coded(table(spark, [(1, None, 1)])) == []


@pytest.mark.parametrize("scale", [1, 1000, 10 ** 8])
def test_nearest_is_exact(scale):
    r = np.random.default_rng(scale)
    x, entries = r.integers(-scale, scale + 1, (3000, 4)), r.integers(-scale, scale + 1, (64, 4))
    entries[10:20] = entries[20:30]
    x[:64] = entries
    pivots = entries[vectorcodes.pivots_of(entries, 4)]
    pick, best = vectorcodes.nearest(x, vectorcodes.distances(x, pivots), entries,
                                     vectorcodes.distances(pivots, entries))
    whole = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (pick == whole.argmin(1)).all() and (best == whole.min(1)).all()


def test_bounds_save_evaluations():
    """Far fewer exact evaluations than rows times entries."""
    r = np.random.default_rng(1)
    entries = r.integers(-10_000, 10_000, (64, 2))
    x = entries[r.integers(0, 64, 2000)] + r.integers(-100, 100, (2000, 2))
    pivots = entries[vectorcodes.pivots_of(entries, 4)]
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                seen.append(len(at))
            return np.asarray(self)[at]

    pick, _ = vectorcodes.nearest(x, vectorcodes.distances(x, pivots), entries.view(Counting),
                                  vectorcodes.distances(pivots, entries))
    assert sum(seen) < 2000 * 64 / 10


def test_too_large_components_are_an_error(spark):
    rows = [(i, [1e12 * i] * 16, 1) for i in range(4)]
    with pytest.raises(Exception, match="too large"):
        coded(table(spark, rows))
