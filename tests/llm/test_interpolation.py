import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from lanewise.llm import interpolation
from llm_cases import brute_words


def brute(rows):
    """The whole model in plain dictionaries; weights by EM over the same held-out counts."""
    end = None
    held = [(d, [*brute_words(t), end]) for d, t in rows]
    train = [(d, w) for d, w in held if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for _, w in train:
        one.update(w)
        two.update(zip([end, *w], w))
    n, v = sum(one.values()), len(one)

    def bucket(c):
        return c.bit_length()

    points = defaultdict(Counter)
    for _, w in train:
        own1, own2, left = Counter(w), Counter(zip([end, *w], w)), n - len(w)
        for a, b in zip([end, *w], w):
            c = one[a] - own1[a]
            base = (one[b] - own1[b] + 0.5) / (left + 0.5 * (v + 1))
            points[bucket(c)][((two[(a, b)] - own2[(a, b)]) / c if c else 0) / base] += 1
    weights, last = {0: 0.0}, 0.0
    for k in range(1, 66):
        if points[k]:
            last = 0.5
            for _ in range(200):
                last = sum(t * last * r / (last * r + 1 - last) for r, t in points[k].items()) / points[k].total()
                last = min(max(last, 1e-9), 1 - 1e-9)
        weights[k] = last
    out = []
    for d, w in held:
        base = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = 0.0
        for a, b, p in zip([end, *w], w, base):
            l = weights[bucket(one[a])]
            score += math.log10(l * (two[(a, b)] / one[a] if one[a] else 0) + (1 - l) * p)
        out.append((d, len(w), sum(x in one for x in w), n, sum(map(math.log10, base)), score))
    return out


def test_equals_brute_force(wide, awkward):
    got = sorted((tuple(r) for r in interpolation.score(wide).collect()), key=lambda r: (str(r[0]), r[4]))
    want = sorted(brute(awkward), key=lambda r: (str(r[0]), r[4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert abs(g[4] - w[4]) < 1e-6 * (1 + abs(w[4]))
        assert abs(g[5] - w[5]) < 0.01 * (1 + abs(w[5]))  # the ratios stand on a grid for EM
        assert g[6] == (g[0] is not None and zlib.crc32(str(g[0]).encode()) % 5 == 1)


def test_better_than_single_words(spark, sf_dir):
    rows = interpolation.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows) and len(rows) > 100


def test_empty_and_untrained(spark, nothing):
    assert interpolation.score(nothing).count() == 0
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = interpolation.score(spark.createDataFrame([(doc, "a b")], "doc_id bigint, text string")).collect()
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].base_score, rows[0].score) == (0, 0, 0.0, 0.0)


def test_weights_by_em():
    shift, steps = interpolation._SHIFT, interpolation.STEPS
    got = interpolation.weights([(3, 0, 50), (3, shift + 4 * steps, 50)])
    # share s solves 0.5 * 16 s / (16 s + 1 - s) = s
    assert abs(got[3] - (8 - 1) / 15) < 1e-3 and got[0] == 0 and got[9] == got[3]
    assert np.all(got >= 0)
