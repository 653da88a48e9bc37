"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, odd names."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASHES = ("k", "v", "a", "b", "n", "band", "chunk", "bucket", "_hash", "_doc", "_kept", "_back",
           "_gone", "_leak", "shard", "size", "kept", "train", "found", "_of", "_id", "row")


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text) rows."""
    r = random.Random(5)
    words = ["the", "und", "zü", "of", "erhe", "Xx", "longerword", "idiot", "é"]

    def text(n):
        return " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))

    base = [text(60) for _ in range(6)]
    rows = [(i, text(r.randrange(25)) + " " + r.choice(base)[r.randrange(40):] + text(r.randrange(20)))
            for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, base[0]) for i in range(40)]
    near = base[1].split()
    for i in range(20):
        near = list(near)
        near[r.randrange(len(near))] = f"new{i % 4}"
        rows.append((300 + i, " ".join(near)))
    rows += [
        (400, None), (401, ""), (402, " \t\n "), (403, "One two"), (404, "one TWO"), (405, "one"),
        (None, base[0]), (None, None), (406, base[2]), (406, base[3]), (406, base[3]),
        (407, "x" * 3000), (408, "a" * 70), (409, "a" * 200), (410, "\0" * 120), (411, text(4000)),
        (412, "All rights  reserved. CC-BY cc by general public license " * 2),
    ]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, "doc_id bigint, text string").repartition(5)


@pytest.fixture(scope="session")
def wide(spark, awkward):
    """A documents table with further columns, some null, whose names clash."""
    layout = DOCS + "".join(f", `{c}` string" for c in CLASHES)
    rows = [(i, t, None, "s" if i else None, None if t is None else len(t), *[None] * (len(CLASHES) - 1), "x")
            for i, t in awkward]
    return spark.createDataFrame(rows, layout).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

