import math
import random

import numpy as np
import pytest

from lanewise.llm import topk

LAYOUT = "vec_id bigint, embedding array<float>, label int, dim string, length string, part int"


def brute(rows, k, scale=1024):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in usable:
        if q % 100:
            continue
        found = [(-sum(a * b for a, b in zip(x, y)), c) for c, y in usable if c != q and len(x) == len(y)]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], LAYOUT).repartition(3)


def search(df, k=10):
    got = topk.search(df, df.where("vec_id % 100 = 0"), k=k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1 + (i % 7)) * s for s in (3, 2, 1, 1, .5, .2)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6),
             (2200, [float("inf")] * 6), (None, [1.0] * 6), (2300, [1.0, 2.0]), (2301, [1.0, -2.0]),
             (2400, [0.0] * 6), (2500, [])]
    monkeypatch.setattr(topk, "BLOCK", 100)
    assert search(table(spark, rows)) == brute(rows, 10)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])]
    assert search(table(spark, rows)) == brute(rows, 10)
    assert search(table(spark, [])) == []


def test_large_components_stay_exact():
    a = np.array([[1 << 40, 3], [5, -(1 << 20)]])
    assert topk.products(a, a[:, ::-1].copy()).tolist() == [
        [2 * 3 * (1 << 40), 5 * 3 - (1 << 60)], [15 - (1 << 60), -10 * (1 << 20)]]
    with pytest.raises(OverflowError):
        topk.products(np.array([[1 << 62]]), np.array([[8]]))


def ranked_together(rows, k, scale=1024):
    """As the SQL twin: each row counts, rows of one query_id share a ranking."""
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    found = {}
    for q, x in whole:
        if q % 100 == 0:
            found.setdefault(q, []).extend(
                (-sum(a * b for a, b in zip(x, y)), c) for c, y in whole if c != q)
    return sorted((q, r, c, -s) for q, own in found.items() for r, (s, c) in enumerate(sorted(own)[:k], 1))


@pytest.mark.parametrize("block", [20, 4096])
def test_every_row_counts(spark, monkeypatch, block):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(250)]
    rows += [(1001, [9.0, 9.0, 9.0, 9.0])] * 11 + [(1002, [-9.0, -9.0, -9.0, 9.0])] * 3
    rows += [rows[3]] * 3 + [rows[100]] * 2 + [(200, [1.0, -1.0, 2.0, 0.5])]  # repeated queries as well
    monkeypatch.setattr(topk, "BLOCK", block)
    assert search(table(spark, rows)) == ranked_together(rows, 10)
