"""Stored measure states and key bitmaps against the direct path, also after a source change."""

import random

import pytest
from pyspark.sql import functions as F

from lanewise import catalog, schema
from lanewise.functions import distinct
from lanewise.operators import kpi
from lanewise.sources import states
from lanewise.sources.star import MONTH, from_tables, read_star, write_by_month, write_star
from plans import executed

KEYS = list(schema.FOREIGN_KEYS)


def test_bitmaps_count_exactly(spark):
    r = random.Random(3)
    pool = [0, 1, -1, 32768, 32769, -32768, -32769, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63) + 1]
    pool += [r.randrange(-100_000, 100_000) for _ in range(400)]
    rows = [(r.randrange(6), r.choice([None, 7, 7, *pool]), r.choice(pool)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "month int, a bigint, b bigint").repartition(7)
    maps = distinct.bitmaps(df, ["a", "b"], {"month": F.col("month")})
    got = {(x["month"], x["key_name"]): x["n"] for x in distinct.counts(maps, ["month"]).collect()}
    assert got == {(m, k): len({row[i] for row in rows if row[0] == m and row[i] is not None})
                   for m in range(6) for i, k in ((1, "a"), (2, "b"))}
    some = maps.where("month in (1, 4, 5)")  # any months merge
    assert distinct.wide_counts(some, ["a", "b", "c"]).first().asDict() == {
        "a": len({row[1] for row in rows if row[0] in (1, 4, 5) and row[1] is not None}),
        "b": len({row[2] for row in rows if row[0] in (1, 4, 5)}), "c": 0}


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "a bigint")
    assert distinct.wide_counts(distinct.bitmaps(empty, ["a"]), ["a"]).first()["a"] == 0


def reads_no_shipments(df):
    scans = [line for line in executed(df).splitlines() if "FileScan" in line]
    return scans and not any("status" in line for line in scans)


@pytest.mark.parametrize("stored", [False, True])
def test_report_copies_no_rows(stars, stored):
    star = stars.summed if stored else stars.clean
    df = kpi.report(star)
    rows = {r["measure_name"]: r["measure_value"] for r in df.collect()}
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
    known = star.facts(*KEYS).where("status <> 'Data Error'").agg(*[F.count_distinct(k).alias(k) for k in KEYS]).first()
    assert [rows[f"Active {n}"] for n in ("Suppliers", "Carriers", "Routes", "Warehouses")] == [
        known[k] for k in KEYS[:4]]
    if stored:
        assert reads_no_shipments(df)


# by month or by one dimension, on clean tables
ANALYSES = [n for n in catalog.CLEAN if n.split("_")[0] in ("kpi", "rk", "ts", "cu", "yoy", "sg", "pw")]


def rows_of(name, star):
    return sorted(map(repr, catalog.CLEAN[name](star).collect()))


@pytest.fixture(scope="module")
def own(spark, stars, tmp_path_factory):
    """A stored star of its own: odd dates and costs, two keys that repeat within a month."""
    root = str(tmp_path_factory.mktemp("own"))
    tables = {n: stars.clean.table(n) for n in schema.TABLES}
    facts = tables["fact_shipments"].where("shipment_key % 3 = 0").withColumns({
        "shipment_cost": F.when(F.col("shipment_key") % 7 > 0, F.col("shipment_cost")),
        "status": F.when(F.col("shipment_key") % 11 > 0, F.col("status")),
        "carrier_key": F.col("carrier_key") % 9,
    })
    write_star(from_tables({**tables, "fact_shipments": facts}), root)
    return root


def stored_star(spark, root, by=("supplier_key", "carrier_key")):
    star = read_star(spark, root)
    held, made = states.refresh(spark, star, f"{root}/states", list(by))
    return star, star.with_states(held), made


@pytest.fixture(scope="module")
def changed(spark, own):
    """The star before and after one month is written anew, one added and one removed."""
    before, _, first = stored_star(spark, own)
    facts = before.facts(*KEYS)
    counts = {r[0]: r["count"] for r in facts.groupBy(MONTH).count().collect()}
    months = sorted(m for m in counts if m)
    kept = facts.where((F.col(MONTH) == F.lit(months[5])) & (F.col("shipment_key") % 2 == 0)).drop(MONTH)
    added = facts.where(F.col(MONTH) == F.lit(months[6])).limit(20).drop(MONTH).withColumn(
        "order_date", F.lit("2031-04-09").cast("date"))
    new = kept.unionByName(added)
    rows, layout = new.collect(), new.schema
    import shutil
    shutil.rmtree(f"{own}/fact_shipments/{MONTH}={months[5]}")
    shutil.rmtree(f"{own}/fact_shipments/{MONTH}={months[7]}")
    mode = "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(mode, "dynamic")
    try:
        write_by_month(spark.createDataFrame(rows, layout), f"{own}/fact_shipments")
    finally:
        spark.conf.unset(mode)
    return own, first, {f"{MONTH}={months[5]}", f"{MONTH}=2031-04-01"}


def test_only_changed_months_are_made_anew(spark, changed):
    root, first, expected = changed
    assert set(first) == {"none", "used_keys", "supplier_key", "carrier_key"}
    assert len({len(m) for m in first.values()}) == 1 and len(first["none"]) > 50
    _, _, made = stored_star(spark, root)
    assert {frozenset(m) for m in made.values()} == {frozenset(expected)}
    _, _, made = stored_star(spark, root)
    assert set(map(len, made.values())) == {0}


@pytest.fixture(scope="module")
def pair(spark, changed):
    return stored_star(spark, changed[0])[:2]


@pytest.mark.parametrize("name", ANALYSES)
def test_equals_the_direct_path_after_a_change(pair, name):
    direct, stored = pair
    assert rows_of(name, stored) == rows_of(name, direct)


@pytest.mark.parametrize("name", ["ts_month_trunc", "cu_year_delay_cost", "yoy_supplier_delay",
                                  "rk_warehouses_rank5", "kpi_report", "kpi_routes_used"])
def test_stored_analyses_read_no_shipments(stars, name):
    df = catalog.CLEAN[name](stars.summed)
    df.collect()
    assert reads_no_shipments(df)


def test_states_are_stored_where_they_are_short(stars):
    assert stars.summed.states.by("warehouse_key") is not None
    assert stars.summed.states.by("product_key") is None  # hardly two shipments a month and product


def test_empty_shipments(spark, stars, tmp_path):
    tables = {n: stars.clean.table(n) for n in schema.TABLES}
    write_star(from_tables({**tables, "fact_shipments": tables["fact_shipments"].limit(0)}), str(tmp_path))
    direct, stored, made = stored_star(spark, str(tmp_path))
    assert set(map(len, made.values())) == {0}
    for name in ("kpi_report", "kpi_total_shipments", "kpi_total_cost", "kpi_carriers_used", "ts_year", "cu_month_cost"):
        assert rows_of(name, stored) == rows_of(name, direct)
