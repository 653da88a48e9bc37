"""Bucketed shipments with a large dimension, and texts that compare without case."""

import pytest
from pyspark.sql import functions as F

from lanewise import catalog, schema
from lanewise.operators import explore, ranking, reports
from lanewise.sources.bucketed import spread_keys, store
from lanewise.sources.star import MONTH, SALT, collated, from_tables
from plans import executed

COLUMNS = ["shipment_key", "carrier_name", "transport_mode", "supplier_name"]


@pytest.fixture(scope="module")
def odd(stars):
    """One carrier has a third of the shipments, a fifth have none."""
    facts = stars.clean.table("fact_shipments").withColumn(
        "carrier_key", F.when(F.col("shipment_key") % 5 > 0, F.col("carrier_key")))
    return from_tables({**{n: stars.clean.table(n) for n in schema.TABLES}, "fact_shipments": facts})


@pytest.fixture(scope="module")
def buckets(spark, odd, tmp_path_factory):
    star = store(odd, "ref_carriers", str(tmp_path_factory.mktemp("buckets")), 8)
    yield star
    for name in ("fact_shipments", "ref_carriers"):
        spark.sql(f"drop table if exists default.{name}_by_carrier_key")


def test_frequent_keys_are_spread(odd, buckets):
    spread = spread_keys(odd.facts("carrier_key"), "carrier_key", 8)
    assert set(spread) == {None, 7} and all(1 < n <= 8 for n in spread.values())
    rows = buckets.facts("carrier_key").groupBy("carrier_key", SALT).count()
    total = odd.facts().count()
    assert rows.agg(F.max("count")).first()[0] < 1.2 * total / 8
    assert buckets.carriers.count() == odd.carriers.count()  # copies are no further carriers


def test_bucketed_join_needs_no_exchange(spark, odd, buckets):
    expected = sorted(map(tuple, reports.shipments(odd, COLUMNS).collect()))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        narrow = reports.shipments(buckets, COLUMNS[:3])
        assert sorted(map(tuple, narrow.collect())) == [r[:3] for r in expected]
        plan = executed(narrow).split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        whole = reports.shipments(buckets, COLUMNS)
        assert sorted(map(tuple, whole.collect())) == expected
        assert executed(whole).split("Initial Plan")[0].count("Exchange hashpartitioning(carrier_key") == 0
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["rk_carriers", "kpi_report", "yoy_carrier_otd", "drill"])
def test_other_analyses_read_buckets_alike(odd, buckets, name):
    def run(star):
        if name == "drill":
            return reports.drill(star, ["transport_mode", "delay_severity"], {"contract_tier": "Gold"})
        return catalog.CLEAN[name](star)

    assert sorted(map(repr, run(buckets).collect())) == sorted(map(repr, run(odd).collect()))


def test_months_of_buckets_are_pruned(buckets):
    from datetime import date
    df = reports.shipments(buckets, COLUMNS[:2], period=(date(1998, 3, 1), date(1998, 3, 31)))
    df.collect()
    scan = next(line for line in executed(df).splitlines() if "FileScan" in line and "shipment_key" in line)
    assert MONTH in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def mixed(stars):
    """Every third spelling in capitals, every fourth with spaces after it."""
    def odd_case(df, key, names):
        return df.withColumns({n: F.when(F.col(key) % 3 == 0, F.upper(n))
                               .when(F.col(key) % 4 == 0, F.concat(n, F.lit("  "))).otherwise(F.col(n)) for n in names})

    tables = {n: stars.raw.table(n) for n in schema.TABLES}
    tables["ref_suppliers"] = odd_case(tables["ref_suppliers"], "supplier_key", ["country", "status", "category"])
    tables["fact_shipments"] = odd_case(tables["fact_shipments"], "shipment_key", ["status"])
    return from_tables(tables)


def folded(value):
    return None if value is None else value.lower().rstrip(" ")


@pytest.mark.parametrize("name, text, numbers", [
    ("vc_supplier_country", 0, 1), ("vc_supplier_category", 0, 1), ("vc_status", 0, 1), ("ex_supplier_statuses", 0, None),
    ("ex_shipment_statuses", 0, None), ("ex_supplier_countries", 0, None)])
def test_groups_without_case(stars, name, text, numbers):
    star = mixed(stars)
    plain = [tuple(r) for r in catalog.RAW[name](star).collect()]
    got = [tuple(r) for r in catalog.RAW[name](collated(star)).collect()]
    expected = {}
    for row in plain:
        expected[folded(row[text])] = expected.get(folded(row[text]), 0) + (row[numbers] if numbers else 1)
    assert len(got) == len(expected) < len(plain)
    assert {folded(r[text]) for r in got} == set(expected)
    if numbers:
        assert {folded(r[text]): r[numbers] for r in got} == expected


def test_filters_without_case(stars):
    """A flag written in small letters is the flag."""
    tables = {n: stars.clean.table(n) for n in schema.TABLES}
    tables["fact_shipments"] = tables["fact_shipments"].withColumn("status", F.lower("status"))
    star = from_tables(tables)
    assert catalog.CLEAN["kpi_total_shipments"](collated(star)).first() == catalog.CLEAN["kpi_total_shipments"](
        stars.clean).first() != catalog.CLEAN["kpi_total_shipments"](star).first()


def test_texts_compare_by_bytes_by_default(stars):
    assert explore.listing(mixed(stars), "ex_supplier_statuses").count() > len(
        explore.listing(stars.raw, "ex_supplier_statuses").collect())
    assert ranking.suppliers(stars.clean).schema["country"].dataType.simpleString() == "string"
