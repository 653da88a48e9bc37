"""Connected components as a few joins and aggregations per round.

Alternating star steps: the large step hooks a vertex's larger neighbours onto
its smallest neighbour, the small step does so with the smaller ones and the
vertex itself.  Edges stay at most as many as before, paths halve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanewise.plans.frozen import written


def _hooked(edges: DataFrame, both: bool) -> DataFrame:
    if both:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "_a")
    return edges.join(least, F.col("a") == F.col("_a")).select("a", "b", "m")


def _large(edges: DataFrame) -> DataFrame:
    return _hooked(edges, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    # edges point from the larger to the smaller vertex here
    hooked = _hooked(edges, False)
    moved = hooked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = hooked.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every vertex a that is not the smallest, b, of its component."""
    now = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        now = written(_small(_large(now)), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now
