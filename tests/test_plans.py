"""Plan shapes that matter at scale: pushdown, pruning, one scan, hot keys."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise import catalog, schema
from lanewise.operators import distribution, ranking, reports, trend
from lanewise.plans.rollup import roll_up
from lanewise.sources.star import from_tables, read_star, write_star
from plans import executed, final_part


def run(df):
    rows = df.collect()
    return rows, final_part(df)


def test_filters_and_columns_reach_the_scan(stars):
    _, plan = run(trend.by_year(stars.clean))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "IsNotNull(order_date)" in scan
    assert "Not(EqualTo(status,Data Error))" in scan
    schema_read = scan.split("ReadSchema: ")[1]
    assert "supplier_key" not in schema_read and "quantity" not in schema_read


@pytest.mark.parametrize("name", ["pw_country_volume", "pw_tier_cost", "pw_warehouse_volume",
                                  "rk_suppliers_rank10", "rk_routes_rank10", "rk_warehouses_rank5"])
def test_totals_and_ranks_reuse_the_shuffle(stars, name):
    """The subquery reads the aggregated shuffle, not the shipments again."""
    df = catalog.CLEAN[name](stars.clean)
    _, plan = run(df)
    assert "ReusedExchange" in plan


def test_no_window_over_all_suppliers(stars):
    _, plan = run(ranking.suppliers(stars.clean))
    assert "Window" not in plan


def test_period_prunes_partitions(stars):
    df = reports.drill(stars.clean, ["delay_severity"], period=(date(1998, 1, 15), date(1998, 3, 20)))
    rows, plan = run(df)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "order_month" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    kept = stars.clean.facts().where(
        F.col("order_date").between("1998-01-15", "1998-03-20") & (F.col("status") != "Data Error"))
    assert sum(r["total_shipments"] for r in rows) == kept.count()


def test_report_joins_only_what_is_asked(stars):
    _, plan = run(reports.shipments(stars.clean, ["shipment_key", "transport_mode"]).limit(5))
    assert plan.count("Join") == 1


def hot_star(stars):
    """A third of the shipments on one supplier, a third without a known one."""
    key = (F.when(F.col("shipment_key") % 3 == 0, F.lit(1))
           .when(F.col("shipment_key") % 3 == 1, F.lit(None)).otherwise(F.col("supplier_key")))
    facts = stars.clean.table("fact_shipments").withColumn("supplier_key", key.cast("bigint"))
    tables = {n: stars.clean.table(n) for n in schema.DIMENSION_KEYS}
    return from_tables({**tables, "fact_shipments": facts.repartition(16)})


def test_hot_key_is_aggregated_before_the_join(spark, stars):
    star = hot_star(stars)
    states = ["shipments", "late", "cost"]
    by = {"country": F.col("country")}
    got = roll_up(star.facts("supplier_key"), states, dimension=star.suppliers,
                  key="supplier_key", by=by).collect()
    plain = star.facts("supplier_key").join(star.suppliers.select("supplier_key", "country"),
                                            "supplier_key", "left").groupBy("country").agg(
        F.count("shipment_key").alias("shipments"), F.count_if(F.col("delay_days") > 0).alias("late"),
        F.sum("shipment_cost").alias("cost"))
    expected = {r["country"]: (r["shipments"], r["late"], int(r["cost"] * 100)) for r in plain.collect()}
    assert {r["country"]: (r["shipments"], r["late"], r["cost"]) for r in got} == expected


def test_large_dimensions_are_shuffled_not_broadcast(spark, stars):
    """Beyond the size threshold the same plans run as sort-merge joins."""
    star = stars.clean
    small = sorted(map(tuple, distribution.by_mode(star).collect()))
    full = reports.shipments(star, ["shipment_key", "supplier_name", "transport_mode"])
    expected = full.groupBy("supplier_name", "transport_mode").count()
    rows = sorted(map(tuple, expected.collect()), key=repr)
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = distribution.by_mode(star)
        assert sorted(map(tuple, df.collect())) == small
        assert "SortMergeJoin" in executed(df) and "BroadcastHashJoin" not in executed(df)
        again = reports.shipments(star, ["shipment_key", "supplier_name", "transport_mode"])
        again = again.groupBy("supplier_name", "transport_mode").count()
        assert sorted(map(tuple, again.collect()), key=repr) == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_key_in_the_flat_report_is_split(spark, stars):
    """AQE cuts the partition of the frequent key when the dimension is shuffled."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    star = hot_star(stars)
    before = reports.shipments(star, ["shipment_key", "supplier_name"])
    expected = sorted(map(tuple, before.collect()), key=repr)
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = reports.shipments(star, ["shipment_key", "supplier_name"])
        assert sorted(map(tuple, df.collect()), key=repr) == expected
        assert "skewed" in executed(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_star_reads_back(spark, stars, tmp_path):
    write_star(stars.clean, str(tmp_path))
    again = read_star(spark, str(tmp_path))
    for name in schema.TABLES:
        assert again.table(name).exceptAll(stars.clean.table(name)).count() == 0
        assert again.table(name).count() == stars.clean.table(name).count()


def test_drill_aggregates_below_every_dimension_join(stars):
    df = reports.drill(stars.clean, ["route_region", "transport_mode"], {"warehouse_status": "High Load"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    first_aggregate = [i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line]
    assert len(joins) == 3 and max(joins) < max(first_aggregate)
    rows = df.collect()
    flat = reports.shipments(stars.clean, ["route_region", "transport_mode", "warehouse_status"])
    wanted = flat.where("warehouse_status = 'High Load'").groupBy("route_region", "transport_mode").count()
    assert {(r[0], r[1]): r[2] for r in wanted.collect()} == {
        (r["route_region"], r["transport_mode"]): r["total_shipments"] for r in rows}


def test_published_report_is_pruned_by_month(spark, stars, tmp_path):
    reports.publish(stars.clean, date(2001, 1, 1), str(tmp_path), database="default")
    one = spark.table("default.report_shipments").where("order_month = date'1998-03-01'")
    rows, plan = run(one.agg(F.count("*")))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "order_month" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert rows[0][0] > 0
    assert spark.sql("select count(*) from default.report_shipments").first()[0] > rows[0][0]
    spark.sql("drop view default.report_shipments")
    spark.sql("drop view default.report_suppliers")


def test_profile_does_not_expand_rows(stars):
    from lanewise.operators import explore
    plan = explore.profile(stars.raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


@pytest.mark.parametrize("tuples", [1, 500, 1 << 20])
def test_profile_counts_columns_together(stars, tuples, monkeypatch):
    """Few scans, the same counts whatever is counted together."""
    from lanewise.operators import explore
    monkeypatch.setattr(explore, "TUPLES", tuples)
    df = explore.profile(stars.raw)
    got = {(r["table_name"], r["column_name"]): r["n_distinct"] for r in df.collect()}
    for name in ("ref_carriers", "fact_shipments"):
        table = stars.raw.table(name)
        known = table.agg(*[F.count_distinct(c).alias(c) for c in table.columns]).first().asDict()
        assert {c: got[name, c] for c in table.columns} == known
    scans = [line for line in final_part(df).splitlines() if "FileScan" in line]
    assert len(scans) <= {1: 54, 500: 40, 1 << 20: 6}[tuples]


def test_no_task_holds_all_unnamed_warehouses(spark, stars):
    from lanewise.operators import benchmark
    unnamed = stars.clean.warehouses.withColumn("location", F.lit(None).cast("string"))
    tables = {n: stars.clean.table(n) for n in schema.TABLES}
    star = from_tables({**tables, "ref_warehouses": unnamed})
    df = benchmark.warehouse_delay(star)
    rows, plan = run(df)
    assert "windowspecdefinition(warehouse_location" not in plan and len(rows) > 100
    assert {r["warehouse_location"] for r in rows} == {"Unknown"}
    assert sum(r["py_delay_rate"] is None for r in rows) == 1
