"""What the preparation and the reports shuffle and store."""

import datetime

import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import distinct
from lanewise.operators import reports
from lanewise.operators.clean import clean_star
from lanewise.plans import versions
from lanewise.sources import delimited
from lanewise.sources.derived import derived_star
from lanewise.sources.star import MONTH, from_tables, read_star, write_star


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Source tables of a few rows: unknown order and supplier, null date, keys that repeat."""
    root = str(tmp_path_factory.mktemp("tiny"))
    day = [datetime.datetime(1997, 1 + i % 7, 1 + i % 27) if i % 11 else None for i in range(400)]
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(i, f"N{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", i % 4, 1.0, "AIR") for i in range(9)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"S{i}", i % 3, 1.0) for i in range(5)],
                     "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(i, f"P{i}", "b", "t", i % 50, 9.5) for i in range(20)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, i % 10, "O") for i in range(90)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string"),
        "lineitem": ([(i % 97, i % 21, i % 6, i % 4, float(i % 50), i * 13.37, d) for i, d in enumerate(day)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                     " l_quantity double, l_extendedprice double, l_shipdate timestamp"),
    }
    for name, (rows, layout) in tables.items():
        spark.createDataFrame(rows, layout).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(df):
    return sorted(map(repr, df.select(*schema.TABLES["fact_shipments"].fieldNames()).collect()))


def test_shipments_are_dealt_by_month_while_narrow(spark, tiny):
    star = derived_star(spark, tiny)
    dealt = star.by_month()
    assert rows_of(dealt) == rows_of(star.table("fact_shipments")) and dealt.count() == 400
    plan = optimized(dealt)
    above, below = plan.split("RebalancePartitions")
    assert "SHP-" in above and "SHP-" not in below


def test_cleaning_of_stored_months_shuffles_nothing(spark, tiny, tmp_path):
    write_star(derived_star(spark, tiny), f"{tmp_path}/raw")
    raw = read_star(spark, f"{tmp_path}/raw")
    cleaned = clean_star(raw)
    assert "RebalancePartitions" not in optimized(cleaned.by_month())
    write_star(cleaned, f"{tmp_path}/clean")
    again = read_star(spark, f"{tmp_path}/clean")
    assert rows_of(again.facts()) == rows_of(cleaned.table("fact_shipments"))
    assert again.facts().where(~F.col(MONTH).eqNullSafe(F.trunc("order_date", "MM"))).count() == 0
    folders = [{p.name for p in (tmp_path / s / "fact_shipments").glob("order_month=*")} for s in ("raw", "clean")]
    assert folders[0] == folders[1] and len(folders[0]) == 8


def test_stars_of_loose_tables_are_dealt_when_written(spark, tiny, tmp_path):
    star = derived_star(spark, tiny)
    loose = from_tables({n: star.table(n) for n in schema.TABLES})
    assert loose.by_month is None and clean_star(loose).by_month is None
    write_star(loose, str(tmp_path))
    assert rows_of(read_star(spark, str(tmp_path)).facts()) == rows_of(star.table("fact_shipments"))


def test_keys_reach_the_shuffle_as_words(spark):
    df = spark.range(0, 64 * 50, 1, 1).select(F.col("id").alias("a"), (F.col("id") * 64).alias("far"))
    maps = distinct.bitmaps(df, ["a"])
    assert "_word" in optimized(maps)
    assert distinct.wide_counts(distinct.bitmaps(df, ["a", "far"]), ["a", "far"]).first().asDict() == {
        "a": 3200, "far": 3200}


@pytest.fixture(scope="module")
def clean(spark, tiny, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clean"))
    write_star(clean_star(derived_star(spark, tiny)), root)
    return read_star(spark, root)


def test_report_rows_are_narrow_until_they_are_joined(clean):
    plan = optimized(reports.shipments(clean, ["shipment_key", "carrier_name", "delivery_flag"]))
    above, below = plan.split("Join", 1)
    assert "On Time" in above and "On Time" not in below


@pytest.mark.parametrize("small", [8 << 20, -1])
def test_published_rows_stay_with_their_month(clean, monkeypatch, small):
    """Shuffled by month once, before the small dimensions, and only where one is large."""
    monkeypatch.setattr(reports, "SMALL", small)
    made = reports._flat(clean, None, False, None, reports.sizes_of(clean), dealt=MONTH)
    plan = optimized(made)
    assert plan.count("RebalancePartitions") == (small < 0)
    assert made.where(~F.col(MONTH).eqNullSafe(F.trunc("order_date", "MM"))).count() == 0
    assert sorted(map(repr, made.drop(MONTH).collect())) == sorted(map(repr, reports.shipments(clean).collect()))


def test_exported_text_is_compressed_and_loads_alike(spark, clean, tmp_path):
    rows = clean.table("fact_shipments")
    delimited.export(rows, f"{tmp_path}/text")
    files = [p.name for p in (tmp_path / "text").glob("part-*")]
    assert files and all(name.endswith(".gz") for name in files)
    assert rows_of(delimited.load(spark, "fact_shipments", f"{tmp_path}/text").rows) == rows_of(rows)


def test_dealt_months_are_written_whole_and_the_setting_restored(spark, clean, tmp_path, monkeypatch):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    facts = clean.facts()
    monkeypatch.setattr(versions, "OPEN_MONTHS", 2)  # rows of further months are sorted
    versions.write_dealt(facts, MONTH, str(tmp_path / "t"))
    assert spark.conf.get(setting) == before
    assert spark.read.parquet(str(tmp_path / "t")).count() == facts.count()
