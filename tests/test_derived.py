"""The derived star has no fixed domains, and the prepared star follows its source."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanewise.operators import audit, explore
from lanewise.sources.derived import SOURCE_TABLES, derived_star
from lanewise.sources.prepared import prepared


@pytest.fixture
def own(sf_dir, tmp_path):
    small = sf_dir.replace("sf0.01", "sf0.001")
    for name in SOURCE_TABLES:
        shutil.copy(f"{small}/{name}.parquet", tmp_path / f"{name}.parquet")
    return tmp_path


def test_a_further_nation_has_lanes_of_its_own(spark, own):
    nation = spark.read.parquet(str(own / "nation.parquet"))
    added = nation.limit(1).withColumn("n_nationkey", F.lit(25)).withColumn("n_name", F.lit("ATLANTIS"))
    nation.unionByName(added).write.parquet(str(own / "more"))
    (own / "nation.parquet").unlink()
    (own / "more").rename(own / "nation.parquet")
    customer = spark.read.parquet(str(own / "customer.parquet"))
    moved = F.when(F.col("c_custkey") % 5 == 0, 25).otherwise(F.col("c_nationkey")).cast("int")
    customer.withColumn("c_nationkey", moved).write.parquet(str(own / "moved"))
    (own / "customer.parquet").unlink()
    (own / "moved").rename(own / "customer.parquet")
    star = derived_star(spark, str(own))
    facts = star.facts("route_key", "warehouse_key").select("route_key", "warehouse_key")
    lanes = star.routes.select(F.col("route_key").alias("k"), "destination", "origin")
    joined = facts.join(lanes, facts["route_key"] == lanes["k"], "left")
    assert joined.where("k is null").count() == 0
    there = joined.where("warehouse_key = 25")
    assert there.count() > 0
    assert {r[0] for r in there.select("destination").distinct().collect()} <= {"ATLANTIS", " "}
    assert joined.where("destination = 'ATLANTIS' and warehouse_key <> 25").count() == 0


def test_shipments_use_all_carriers(spark, sf_dir):
    star = derived_star(spark, sf_dir)
    used = star.facts("carrier_key").groupBy("carrier_key").count()
    known = star.carriers.select("carrier_key").join(used, "carrier_key", "left_semi").count()
    assert known > 0.9 * star.carriers.count()
    total, most = used.agg(F.sum("count"), F.max("count")).first()
    assert 0.3 < most / total < 0.4
    assert used.where("carrier_key < 0").count() > 100


def test_prepared_star_follows_its_source(spark, own):
    def shipments():
        return (entry.queries()["kpi_total_shipments"](spark, str(own)).first()[0],
                {r[0]: r[1] for r in entry.queries()["ex_row_counts"](spark, str(own)).collect()})

    before, counts = shipments()
    assert counts["fact_shipments"] > 1000
    lines = spark.read.parquet(str(own / "lineitem.parquet")).limit(100).collect()
    layout = spark.read.parquet(str(own / "lineitem.parquet")).schema
    (own / "lineitem.parquet").unlink()
    spark.createDataFrame(lines, layout).coalesce(1).write.parquet(str(own / "lineitem.parquet"))
    after, counts = shipments()
    assert after <= 100 < before and counts["fact_shipments"] == 100


def test_lost_tables_are_made_again(spark, own):
    first = prepared(spark, str(own), lambda: derived_star(spark, str(own)))
    folder = next(iter(first.raw.table("fact_shipments").inputFiles())).removeprefix("file:")
    table = folder.split("/fact_shipments/")[0] + "/fact_shipments"
    again = prepared(spark, str(own), lambda: derived_star(spark, str(own)))
    assert again is first
    shutil.rmtree(table.replace("file://", ""))
    made = prepared(spark, str(own), lambda: derived_star(spark, str(own)))
    assert made is not first
    assert made.raw.table("fact_shipments").count() == explore.row_counts(made.raw).where(
        "table_name = 'fact_shipments'").first()[1]
    assert audit.before(made.raw).count() > 0
