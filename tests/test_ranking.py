"""Distributed ranks against plain counting."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.functions import measures as m
from lanewise.plans.ranking import falling, keep_rank, number_rows, positions, rank_all, tiles
from plans import executed


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, late bigint, shipments bigint").repartition(5)


def rows_with_ties(seed, count):
    """A third of the rows share one rate; equal rates come as unequal fractions."""
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        if i % 3 == 0:
            k = rnd.randint(1, 5)
            rows.append((f"n{i:04}", k, 2 * k))
        else:
            n = rnd.randint(0, 30)
            rows.append((f"n{i:04}", rnd.randint(0, n), n))
    return rows


def rate(row):
    return Fraction(row[1], row[2]) if row[2] else Fraction(-1)


def ranks(rows):
    return {r[0]: 1 + sum(rate(o) > rate(r) for o in rows) for r in rows}


@pytest.mark.parametrize("seed, count, limit", [(1, 300, 10), (2, 40, 5), (3, 4, 10), (4, 1, 10)])
def test_keep_rank(spark, seed, count, limit):
    rows = rows_with_ties(seed, count)
    got = keep_rank(frame(spark, rows), m.exact_delay_rate(), limit, "rank")
    assert got.columns == ["name", "late", "shipments", "rank"]
    assert {r["name"]: r["rank"] for r in got.collect()} == {
        k: v for k, v in ranks(rows).items() if v <= limit}


def test_keep_rank_keeps_all_ties(spark):
    rows = [(f"n{i}", 1, 1) for i in range(500)] + [("slow", 0, 1)]
    got = keep_rank(frame(spark, rows), m.exact_delay_rate(), 10, "rank").collect()
    assert len(got) == 500 and {r["rank"] for r in got} == {1}


@pytest.mark.parametrize("seed, count", [(1, 300), (5, 7), (6, 0)])
def test_rank_all(spark, seed, count):
    rows = rows_with_ties(seed, count)
    got = rank_all(frame(spark, rows), m.exact_delay_rate(), ["name"], "rank").collect()
    assert {r["name"]: r["rank"] for r in got} == ranks(rows)


def test_row_numbers_follow_the_order(spark):
    rows = rows_with_ties(8, 200)
    got = number_rows(frame(spark, rows), [F.desc("late"), F.asc("name")]).collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["name"] for r in sorted(got, key=lambda r: r["position"])] == [r[0] for r in expected]
    assert sorted(r["position"] for r in got) == list(range(1, 201))


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 10, 101])
def test_tiles(spark, count):
    rows = [(f"n{i:03}", i, count) for i in range(count)]
    got = tiles(frame(spark, rows), falling("late"), 4, "tile").collect()
    tile = [r["tile"] for r in sorted(got, key=lambda r: -r["late"])]
    sizes = [tile.count(t) for t in (1, 2, 3, 4)]
    assert tile == sorted(tile)
    assert sizes == [count // 4 + (t < count % 4) for t in range(4)]


@pytest.mark.parametrize("ranges", ["1", "3", "8", "200"])
def test_positions_follow_the_order(spark, ranges):
    rows = [(None if i % 9 == 0 else f"n{i % 40:02}", i % 3, i) for i in range(333)]
    df = frame(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = positions(df, [*falling("late"), F.col("name"), F.col("shipments")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    expected = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or "", r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in got) == list(range(1, 334))


def test_nulls_are_ranked_last(spark):
    df = frame(spark, [(f"n{i}", None if i % 3 == 0 else i % 4, 1) for i in range(60)])
    got = {r["name"]: r["rank"] for r in rank_all(df, F.col("late"), ["name"], "rank").collect()}
    values = {f"n{i}": -1 if i % 3 == 0 else i % 4 for i in range(60)}
    assert got == {k: 1 + sum(o > v for o in values.values()) for k, v in values.items()}


@pytest.mark.parametrize("name", ["rk_carriers", "rk_supplier_quartiles", "rk_product_exposure", "yoy_warehouse_delay"])
def test_no_job_while_a_full_rank_is_built(spark, stars, name):
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", "")
    try:
        df = catalog.CLEAN[name](stars.clean)
        df._jdf.queryExecution().optimizedPlan()
        assert not context.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        context._jsc.clearJobGroup()
    assert df.count() > 0


def test_rows_below_a_rank_are_computed_once(stars):
    df = catalog.CLEAN["rk_product_exposure"](stars.clean)
    df.collect()
    plan = executed(df).split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert sum("FileScan" in line and "shipment_cost" in line for line in plan.splitlines()) == 1


def test_both_uses_of_ranked_rows_read_the_same_columns(spark, tmp_path):
    """Else their shuffles differ, and the table is read and dealt twice."""
    rows = [(f"n{i % 50}", i % 7, 10 + i % 3, i) for i in range(400)]
    spark.createDataFrame(rows, "name string, late bigint, shipments bigint, cost bigint").write.parquet(f"{tmp_path}/t")
    sums = [F.sum(c).alias(c) for c in ("late", "shipments", "cost")]
    df = spark.read.parquet(f"{tmp_path}/t").groupBy("name").agg(*sums)
    got = rank_all(df, m.exact_delay_rate(), ["name"], "rank")
    assert len(set(re.findall("ReadSchema: (.*)", executed(got)))) == 1
    groups = [tuple(r) for r in df.collect()]
    assert {r["name"]: (r["cost"], r["rank"]) for r in got.collect()} == {
        n: (c, 1 + sum(Fraction(a, b) > Fraction(late, all_) for _, a, b, _ in groups)) for n, late, all_, c in groups}
