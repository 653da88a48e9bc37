"""What each filter of a chain removes, in every order of the filters.

Spark reduces the documents to counts for each part and each set of failed
filters.  A part's counts become a decision diagram: one level for each filter,
an edge for passing and one for failing, equal sub-diagrams shared, every node
weighted with the documents below it.  Swapping two adjacent levels rewrites the
nodes of those two levels only, so all orders follow from one another by single
swaps, and in each of them the path of passing edges from the root gives the
steps: a step keeps what lies below the passing edge and removes what lies below
the failing one.

Null texts count as empty.  Null parts count as the empty string and are one with
it.  A text repeats if a row with a smaller doc_id has the same text, whatever
filter that row fails; rows with equal doc_id do not make each other repeat, and
rows without doc_id neither repeat nor make others repeat.  Several label rows of
a document count as one that has each mark that one of them has.  Texts are
compared by SHA-256.  No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanewise.plans.frozen import written

LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the code points
REPEATED = "E"

Weight = tuple[int, ...]

SCHEMA = """part string, filter_order string, step int, kept bigint, removed bigint,
    redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"""


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter; the text is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
        > MOST_CAPITALS * F.char_length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters.

    Bit i of the mask stands for the i-th letter.  Rows alike in all that matters
    are counted before anything is joined, and the joins go by doc_id, so neither
    a text nor a part that very many documents share meets in one task.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    tests = text_filters(F.col("text"))
    mask = sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests.values())), F.lit(0))
    rows = written(
        narrow.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"),
                      mask.alias("mask"))
        .groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n")), "failures")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("labelled")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    first = firsts.withColumnRenamed("key", "first_key")
    flagged = (
        rows.join(first, (rows["key"] == first["first_key"]) & (rows["doc_id"] == first["least"]), "left")
        .join(marks, F.col("doc_id") == F.col("labelled"), "left"))
    repeats = F.col("doc_id").isNotNull() & F.col("least").isNull()
    return flagged.groupBy(
        "part", (F.col("mask") + F.when(repeats, F.lit(1 << len(tests))).otherwise(F.lit(0))).alias("mask"),
    ).agg(F.sum("n").alias("n"),
          F.coalesce(F.sum(F.col("n") * F.col("good")), F.lit(0)).alias("good"),
          F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic"))


class Diagram:
    """Weights by set of failed filters as a shared, ordered decision diagram."""

    def __init__(self, weights: dict[int, Weight], letters: str):
        self.order = list(letters)
        self.low: dict[int, int] = {}
        self.high: dict[int, int] = {}
        self.weight: list[Weight] = []
        self._leaves: dict[Weight, int] = {}
        self._levels: list[dict[tuple[int, int], int]] = [{} for _ in letters]
        width = len(next(iter(weights.values())))
        row = [self._leaf(weights.get(mask, (0,) * width)) for mask in range(1 << len(letters))]
        for level in reversed(range(len(letters))):  # the last letter is the highest bit
            half = len(row) // 2
            row = [self._node(level, a, b) for a, b in zip(row[:half], row[half:])]
        self.root = row[0]

    def _leaf(self, weight: Weight) -> int:
        if weight not in self._leaves:
            self._leaves[weight] = len(self.weight)
            self.weight.append(weight)
        return self._leaves[weight]

    def _node(self, level: int, low: int, high: int) -> int:
        known = self._levels[level]
        if (low, high) not in known:
            node = known[low, high] = len(self.weight)
            self.low[node], self.high[node] = low, high
            self.weight.append(tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
        return known[low, high]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; nodes of all other levels stay as they are."""
        upper = list(self._levels[level].values())
        self._levels[level], self._levels[level + 1] = {}, {}
        low, high = self.low, self.high
        for node in upper:
            a, b = low[node], high[node]
            low[node], high[node] = (
                self._node(level + 1, low[a], low[b]), self._node(level + 1, high[a], high[b]))
            self._levels[level][low[node], high[node]] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(letter, kept, removed) for each step of the present order."""
        node = self.root
        for letter in self.order:
            yield letter, self.weight[self.low[node]], self.weight[self.high[node]]
            node = self.low[node]


def plain_changes(n: int) -> Iterator[int]:
    """Places whose swap with the next one leads through all orders of n things, each once."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def steps(weights: dict[int, Weight], letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good, toxic, shapley) of all orders."""
    diagram = Diagram(weights, letters)
    fails, alone, total, found = {}, {}, dict.fromkeys(letters, 0), []
    for place in [None, *plain_changes(len(letters))]:
        if place is not None:
            diagram.swap(place)
        path = list(diagram.path())
        fails[path[0][0]] = path[0][2][0]  # all documents meet the first filter
        alone[path[-1][0]] = path[-1][2][0]  # the last one meets those that passed the others
        found.append(("".join(diagram.order), path))
        for letter, _, removed in path:
            total[letter] += removed[0]
    return [
        (order, step, kept[0], removed[0], fails[letter] - removed[0], alone[letter],
         removed[1], removed[2], total[letter])
        for order, path in found
        for step, (letter, kept, removed) in enumerate(path, 1)]


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    def one(masks: pa.Table) -> pa.Table:
        held = masks.to_pydict()
        weights = {m: w for m, *w in zip(held["mask"], held["n"], held["good"], held["toxic"])}
        rows = steps({m: tuple(w) for m, w in weights.items()}, "ABCD" + REPEATED)
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table(
            [pa.repeat(held["part"][0], len(rows)),
             *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
            ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
             "good_lost", "toxic_lost", "shapley"])

    return failures(docs, labels, doc_id, text, part).groupBy("part").applyInArrow(one, SCHEMA)
