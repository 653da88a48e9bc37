"""Exact search for the largest inner products.

Vectors are scaled to whole numbers, floor(scale * x).  Candidates are sorted
by falling length and cut into blocks; queries are cut into blocks as well.  A
rotation, the singular vectors of a bounded sample, gathers most of the length
in the first coordinates.  Against a query's k-th best score so far

- a block is skipped if query length times its longest vector stays below;
- a vector is dropped if its partial sum over the first rotated coordinates
  plus the Cauchy-Schwarz bound of the rest stays below;
- the others get their exact whole-number product.

The block of the longest vectors is searched first and gives each query its
starting bound; all other blocks then go side by side.  Ties go to the smaller
vec_id.  A query is never its own result (by vec_id; repeated vec_ids are the
same vector's rows and are not returned to it either).

Every row counts, in all blocks: a candidate row that stands in the table
several times is as many results, and a query row that is asked several times
gives each of its results as often.  The rows of one query_id share one ranking.

Vectors that are null or hold null, NaN or infinite components take no part.
Only vectors of equal dimension are compared.  Scores must fit in a BIGINT;
larger ones are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanewise.llm.arrays import pack, unpack
from lanewise.plans.frozen import written

SAMPLE = 4_096  # vectors the rotation is fitted on; it only affects speed
BLOCK = 4_096  # candidates of a block
QUERY_BLOCK = 512
FIRST = 16  # rotated coordinates of the partial sum
_BLOCKS = "dim int, part bigint, longest double, ids binary, vectors binary"
_EXACT = float(1 << 53)


def scaled(df: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector, length) of the rows that take part."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    usable = ~F.exists(F.col(embedding).cast("array<double>"),
                       lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & usable)
        .select(F.col(vec_id).cast("bigint").alias("vec_id"), F.size(embedding).alias("dim"),
                x.cast("array<bigint>").alias("vector"))
        .withColumn("length", F.sqrt(F.aggregate(
            F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c)))
    )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension an orthogonal matrix, strongest direction of the sample first."""
    sample = vectors.select("dim", "vector").limit(SAMPLE).collect()
    out = {}
    for dim in {r["dim"] for r in sample} - {0}:
        rows = np.array([r["vector"] for r in sample if r["dim"] == dim], float)
        out[dim] = np.linalg.svd(rows, full_matrices=True)[2].T
    return out


def _blocked(size: int):
    """Rows in order of falling length to blocks of one dimension."""
    from pyspark import TaskContext

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            length = batch.column("length").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            flat, offsets = batch.column("vector").flatten().to_numpy(zero_copy_only=False), None
            offsets = np.append(0, np.cumsum(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                own = own[np.argsort(-length[own], kind="stable")]
                for start in range(0, len(own), size):
                    rows = own[start: start + size]
                    vectors = flat[(offsets[rows][:, None] + np.arange(dim)).ravel()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(dim)], pa.int32()), pa.array([task << 32 | number], pa.int64()),
                        pa.array([float(length[rows].max())]), pa.array([pack(ids[rows])], pa.binary()),
                        pa.array([pack(vectors.astype(np.int64))], pa.binary()),
                    ], ["dim", "part", "longest", "ids", "vectors"])
                    number += 1

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products of the rows of a with those of b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(a.shape[1]) * float(np.abs(a).max()) * float(np.abs(b).max())
    if bound < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best_of(q_ids, q, floor, c_ids, c, rotation, k) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k best of a block's vectors (in order of falling length) from ``floor`` on."""
    turned_q, turned_c = q.astype(float) @ rotation, c.astype(float) @ rotation
    width = min(FIRST, q.shape[1])
    rest_q = np.sqrt((turned_q[:, width:] ** 2).sum(1))
    rest_c = np.sqrt((turned_c[:, width:] ** 2).sum(1))
    size_q, size_c = np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(c.astype(float), axis=1)
    slack = 1e-9 * (1 + size_q * (size_c.max() if len(size_c) else 0))  # of the rotated sums
    out = []
    for i in range(len(q)):
        bound, ids, scores = floor[i], np.empty(0, np.int64), np.empty(0, np.int64)
        start = 0
        while start < len(c):
            end = min(len(c), start + 1024)
            if np.isfinite(bound) and size_q[i] * size_c[start] + slack[i] < bound:
                break  # all further vectors are shorter
            rows = np.arange(start, end)
            if np.isfinite(bound):
                partial = turned_c[start:end, :width] @ turned_q[i, :width]
                rows = rows[partial + rest_c[start:end] * rest_q[i] + slack[i] >= bound]
            rows = rows[c_ids[rows] != q_ids[i]]
            if len(rows):
                got = products(q[i: i + 1], c[rows])[0]
                ids, scores = np.append(ids, c_ids[rows]), np.append(scores, got)
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                if len(ids) == k:
                    bound = max(bound, float(scores[-1]))
            start = end
        out.append((int(q_ids[i]), ids, scores))
    return out


def _searched(sent, k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, floor = unpack(row["q_ids"], np.int64), unpack(row["q_floor"], np.float64)
                c_ids = unpack(row["ids"], np.int64)
                q = unpack(row["q_vectors"], np.int64).reshape(len(q_ids), dim)
                c = unpack(row["vectors"], np.int64).reshape(len(c_ids), dim)
                rotation = sent.value.get(dim, np.eye(dim))
                found = best_of(q_ids, q, floor, c_ids, c, rotation, k)
                sizes = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([f[0] for f in found], sizes).astype(np.int64)),
                    pa.array(np.concatenate([f[1] for f in found])),
                    pa.array(np.concatenate([f[2] for f in found])),
                    pa.array(np.repeat(unpack(row["q_times"], np.int64), sizes)),
                ], ["query_id", "vec_id", "score", "times"])

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint, times bigint"


def _query_blocks(batches):
    """Queries of a batch, with the bound each starts from, to blocks."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        offsets = np.append(0, np.cumsum(dims))
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy()
        floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
        length = batch.column("length").to_numpy()
        times = batch.column("times").to_numpy()
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            for start in range(0, len(own), QUERY_BLOCK):
                rows = own[start: start + QUERY_BLOCK]
                vectors = flat[(offsets[rows][:, None] + np.arange(dim)).ravel()]
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(length[rows] > 0, floor[rows] / length[rows], -np.inf)
                reach = np.where(np.isfinite(floor[rows]), reach, -np.inf)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(dim)], pa.int32()), pa.array([number], pa.int64()),
                    pa.array([float(reach.min())]), pa.array([pack(ids[rows])], pa.binary()),
                    pa.array([pack(vectors.astype(np.int64))], pa.binary()),
                    pa.array([pack(floor[rows])], pa.binary()), pa.array([pack(times[rows])], pa.binary()),
                ], ["q_dim", "q_part", "q_reach", "q_ids", "q_vectors", "q_floor", "q_times"])
                number += 1


_QUERIES = ("q_dim int, q_part bigint, q_reach double, q_ids binary, q_vectors binary, q_floor binary, "
            "q_times binary")


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each query."""
    spark = candidates.sparkSession
    vectors = written(scaled(candidates, scale), "vectors")
    # equal query rows are searched once
    asked = written(scaled(queries, scale).groupBy("vec_id", "dim", "vector", "length")
                    .agg(F.count(F.lit(1)).alias("times")), "queries")
    sent = spark.sparkContext.broadcast(rotations(vectors))  # dimension squared
    total = vectors.count()
    ordered = vectors.repartitionByRange(max(1, total // BLOCK + 1), F.desc("dim"), F.desc("length"))
    blocks = written(ordered.mapInArrow(_blocked(BLOCK), _BLOCKS), "vector-blocks")

    def found(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        start = F.lit(float("-inf")).alias("floor")
        if floors is None:
            given = asked.select("*", start)
        else:
            given = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select(
                asked["vec_id"], "dim", "vector", "length", "times",
                F.coalesce("floor", start).alias("floor"))
        held = written(given.mapInArrow(_query_blocks, _QUERIES), "query-blocks")
        # a block pair is left out if no product in it can reach a bound
        pairs = some.join(held, (F.col("dim") == F.col("q_dim"))
                          & (F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("q_reach")))
        return pairs.repartition(max(8, total // BLOCK + 1), "part", "q_part").mapInArrow(
            _searched(sent, k), _FOUND)

    longest = blocks.groupBy(F.col("dim").alias("_dim")).agg(
        F.max_by("part", F.struct("longest", "part")).alias("_part"))
    ahead = blocks.join(longest, (F.col("dim") == F.col("_dim")) & (F.col("part") == F.col("_part")))
    first = written(found(ahead.drop("_dim", "_part"), None), "first-best")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")) \
        .where(F.col("_n") >= k).select("query_id", F.col("_least").cast("double").alias("floor"))
    others = blocks.join(longest, (F.col("dim") == F.col("_dim")) & (F.col("part") == F.col("_part")),
                         "left_anti")
    every = first.unionByName(found(others, floors))
    # at most k rows of each block for a query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = best.select("query_id", "vec_id", "score", F.explode(  # more than k of a row never rank
        F.array_repeat(F.lit(True), F.least("times", F.lit(k)).cast("int"))).alias("_one"))
    return (each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
