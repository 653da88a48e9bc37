"""Short codes for vectors: each part of a vector becomes the number of its nearest entry.

The components become whole numbers, a vector is cut into equal parts, and each
part position has a codebook that is refined in rounds.  The search for the
nearest entry follows LAESA: some fixed pivots are chosen from the first codebook
of a position, each part's distances to them are computed once and stored with the
rows; in each round the distances between pivots and entries bound a part's
distance to every entry from below (the difference of the two).  Entries are
evaluated in the order of that bound, exactly in whole numbers, until no bound is
as small as the best distance found.

A round is one pass over the stored rows.  What leaves a task is a sum and a count
for each entry; Spark adds them up, and the driver receives one row for each entry.

Vectors that are null or hold a null or non-finite component take no part, nor do
those whose length is not that of the vector with the smallest vec_id or cannot be
cut.  Rows without vec_id count and are coded like all others, but are the last to
give a first entry; repeated rows count each.  Components too large for exact
64-bit distances are an error.  Equal first entries may occur; the lower index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lanewise.plans.frozen import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256
ROWS = 8192  # coded together


def whole_numbers(df: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, x): usable vectors with components floor(scale * component)."""
    component = F.col("vector")
    usable = component.isNotNull() & ~F.exists(
        component, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector")).where(usable)
    return kept.select("vec_id", "label", F.transform("vector", lambda c: F.floor(c * scale)).alias("x"))


def _checked(x: np.ndarray, others: np.ndarray) -> None:
    """Squared distances summed over all parts must fit in 64 bits."""
    reach = max(int(np.abs(x.astype(np.float64)).max(initial=0)), int(np.abs(others.astype(np.float64)).max(initial=0)))
    if (2 * reach) ** 2 * x[0].size >= 1 << 63:
        raise OverflowError("components are too large for exact distances")


def pivots_of(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from one another: each next one has the largest sum of distances to those before."""
    entries = entries.astype(np.float64)
    chosen, far = [0], np.zeros(len(entries))
    while len(chosen) < min(count, len(entries)):
        far += np.sqrt(((entries - entries[chosen[-1]]) ** 2).sum(1))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return np.array(chosen)


def distances(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances between all rows of both, as 32-bit floats."""
    gaps = x[:, None, :] - others[None]
    return np.sqrt((gaps * gaps).sum(2).astype(np.float64)).astype(np.float32)


def nearest(x: np.ndarray, away: np.ndarray, entries: np.ndarray, between: np.ndarray):
    """Index of each row's nearest entry (ties: the lower) and the squared distance.

    away: distances of the rows to the pivots, between: of the pivots to the entries.
    Both are rounded; the bound is loosened by more than that.
    """
    n = len(x)
    slack = np.float32(max(away.max(initial=0), between.max(initial=0)) * 2.0 ** -20)
    bound = np.zeros((n, len(entries)), np.float32)
    for p in range(len(between)):
        np.maximum(bound, np.abs(away[:, p, None] - between[p]), out=bound)
    bound -= slack
    best, pick = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    reach = np.full(n, np.finfo(np.float32).max)
    open_rows = np.arange(n)
    while len(open_rows):
        left = bound[open_rows]
        at = left.argmin(1)
        worth = left[np.arange(len(at)), at] <= reach[open_rows]
        open_rows, at = open_rows[worth], at[worth]
        bound[open_rows, at] = np.inf
        gaps = x[open_rows] - entries[at]
        found = (gaps * gaps).sum(1)
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (at < pick[open_rows]))
        rows = open_rows[better]
        best[rows], pick[rows] = found[better], at[better]
        # a float is rounded; the next one above is surely not too small
        reach[rows] = np.nextafter(np.sqrt(found[better].astype(np.float64)).astype(np.float32), np.float32(np.inf))
    return pick, best


class Codebooks:
    """Entries of all part positions [part, entry, position] and the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.between = [distances(p, e) for p, e in zip(pivots, entries)]

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances [row, part, pivot] of all parts to their pivots."""
        _checked(x, self.pivots)
        return np.stack([distances(x[:, j], self.pivots[j]) for j in range(len(self.pivots))], 1)

    def assign(self, x: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry [row, part] and the squared distances summed over parts."""
        _checked(x, self.entries)
        picks, error = np.empty(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
        for j in range(x.shape[1]):
            picks[:, j], best = nearest(x[:, j], away[:, j], self.entries[j], self.between[j])
            error += best
        return picks, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], books: Codebooks, stored: bool = True):
    """Batches with their parts [row, part, position] and stored pivot distances."""
    parts, _, width = books.entries.shape
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
        away = batch.column("away").flatten().to_numpy().reshape(len(x), parts, -1) if stored else None
        for i in range(0, len(x), ROWS):
            yield batch.slice(i, ROWS), x[i: i + ROWS], away[i: i + ROWS] if stored else None


def _with_distances(rows: DataFrame, books: Codebooks) -> DataFrame:
    layout = T.StructType([*rows.schema, T.StructField("away", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch, x, _ in _blocks(batches, books, stored=False):
            away = books.away(x).reshape(len(x), -1)
            column = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * away.shape[1], pa.int32()), pa.array(away.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "away"])

    return rows.mapInArrow(run, layout)


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every used entry becomes the floor of the average of its parts."""
    parts, count, width = books.entries.shape

    def run(batches):
        sums, used = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for _, x, away in _blocks(batches, books):
            picks, _ = books.assign(x, away)
            for j in range(parts):
                np.add.at(sums[j], picks[:, j], x[:, j])
                used[j] += np.bincount(picks[:, j], minlength=count)
        part, entry = np.nonzero(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(used[part, entry]),
             *[pa.array(sums[part, entry, i]) for i in range(width)]],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    sums = [f"s{i}" for i in range(width)]
    partial = rows.mapInArrow(run, "part int, entry int, n bigint, " + ", ".join(f"{s} bigint" for s in sums))
    # one row for each part position and entry
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
    entries = books.entries.copy()
    for row in found:
        entries[row["part"], row["entry"]] = [row[s] // row["n"] for s in sums]
    return Codebooks(entries, books.pivots)


def first_books(rows: DataFrame, parts: int, entries: int, pivots: int) -> Codebooks | None:
    """Codebooks from the rows with the smallest vec_ids; None without rows."""
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["x"])
    smallest = rows.where(F.size("x") == length).orderBy(*order).limit(entries).collect()
    x = np.array([r["x"] for r in smallest], np.int64).reshape(len(smallest), parts, length // parts)
    _checked(x, x)
    made = np.ascontiguousarray(x.transpose(1, 0, 2))
    return Codebooks(made, np.stack([e[pivots_of(e, pivots)] for e in made]))


def codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          pivots: int = PIVOTS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding",
          label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable vector."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    usable = whole_numbers(df, scale, vec_id, vector, label)
    usable = usable.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    books = first_books(usable, parts, entries, pivots)
    if books is None:
        return df.sparkSession.createDataFrame(
            [], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    length = books.entries.shape[0] * books.entries.shape[2]
    rows = written(_with_distances(usable.where(F.size("x") == length), books), "pivot-distances")
    for _ in range(rounds):
        books = _refined(rows, books)

    def run(batches):
        for batch, x, away in _blocks(batches, books):
            picks, error = books.assign(x, away)
            digits = [bytes(p).hex() for p in picks.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(digits), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    layout = T.StructType([rows.schema["vec_id"], rows.schema["label"],
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = written(rows.mapInArrow(run, layout), "codes")
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # a label that very many rows share makes a skewed join side, which AQE splits
    return coded.join(per_label, coded["label"].eqNullSafe(per_label["of"])).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
