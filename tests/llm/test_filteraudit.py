import itertools
import random
import re
from math import factorial

import pytest

from lanewise.llm import filteraudit

LETTERS = "ABCDE"


def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * capitals > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def brute(rows, labels):
    """rows: (doc_id, text, source); every order applied document by document."""
    docs, shapley, out = [], {}, []
    for doc, text, source in rows:
        text, fails = text or "", fails_of(text or "")
        fails["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        own = [lab for lab in labels if doc is not None and lab[0] == doc]
        docs.append((source or "", fails, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations(LETTERS):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                redundant = sum(d[1][letter] for d in mine) - len(removed)
                alone = sum(d[1][letter] and sum(d[1].values()) == 1 for d in mine)
                out.append([part, "".join(order), step, len(left), len(removed), redundant, alone,
                            sum(d[2] for d in removed), sum(d[3] for d in removed)])
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_equals_brute_force(spark, awkward):
    r = random.Random(7)
    texts = [t for _, t in awkward] + ["A# b " * 30, "Abc | def " * 40, "#", "ÀÉ Zz", " \t"]
    rows = [(d, t, r.choice([None, "", "s1", "s2"])) for d, t in awkward]
    rows += [(r.choice([None, *range(1000, 1040)]), r.choice(texts), r.choice(["s1", "hot", "hot", "hot"]))
             for _ in range(300)]
    rows += [rows[3]] * 4
    labels = [(r.choice([None, *range(400), *range(1000, 1040)]), r.choice([None, 0, 1]), r.choice([None, 0, 1]))
              for _ in range(300)]
    names = ("part", "key", "mask", "least", "good", "toxic", "n", "labelled", "first_key", "quality")
    docs = spark.createDataFrame(
        [(*row, *[None] * len(names)) for row in rows],
        "doc_id bigint, text string, source string" + "".join(f", `{n}` string" for n in names)).repartition(4)
    marks = spark.createDataFrame(
        [(*m, None, None) for m in labels], "doc_id bigint, quality int, toxic int, n string, mask string")
    got = sorted(tuple(row) for row in filteraudit.audit(docs, marks).collect())
    assert got == brute(rows, labels)


def test_no_documents_and_no_labels(spark, nothing, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filteraudit.audit(nothing, labels).count() == 0
    alone = docs.selectExpr("doc_id", "text", "cast(null as string) as source")
    rows = filteraudit.audit(alone, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {(r.good_lost, r.toxic_lost) for r in rows} == {(0, 0)}


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes_meet_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for place in filteraudit.plain_changes(n):
        order[place], order[place + 1] = order[place + 1], order[place]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == factorial(n)


def test_swaps_keep_every_weight():
    r = random.Random(2)
    weights = {m: (r.randrange(3), r.randrange(2)) for m in r.sample(range(32), 12)}
    diagram = filteraudit.Diagram(weights, LETTERS)
    for _ in range(200):
        diagram.swap(r.randrange(4))
        for mask in range(32):
            node = diagram.root
            for letter in diagram.order:
                side = diagram.high if mask >> LETTERS.index(letter) & 1 else diagram.low
                node = side[node]
            assert diagram.weight[node] == weights.get(mask, (0, 0))


def test_equal_parts_are_shared():
    diagram = filteraudit.Diagram({m: (1,) for m in range(32)}, LETTERS)
    assert [len(level) for level in diagram._levels] == [1] * 5
    assert diagram.weight[diagram.root] == (32,)
