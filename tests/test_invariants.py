"""Relations that hold between the analyses."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.operators import clean, explore, kpi, ranking, reports, share, trend
from lanewise.operators.scope import dated, valid


def one(df):
    return df.collect()[0][0]


def test_on_time_and_delayed_make_all(stars):
    star = stars.clean
    assert one(kpi.on_time(star)) + one(kpi.delayed(star)) == one(kpi.total_shipments(star))


@pytest.mark.parametrize("name", ["vc_supplier_country", "vc_mode_cost", "vc_route_region",
                                  "vc_warehouse", "vc_fragility", "vc_status"])
def test_groups_add_up_to_all_shipments(stars, name):
    groups = catalog.RAW[name](stars.raw)
    assert one(groups.agg(F.sum("total_shipments"))) == stars.raw.facts().count()


@pytest.mark.parametrize("name", ["pw_country_volume", "pw_mode_cost", "pw_region_delays"])
def test_shares_add_up(stars, name):
    df = catalog.CLEAN[name](stars.clean)
    assert abs(one(df.agg(F.sum(df.columns[-1]))) - 100) < 1


def test_last_running_total_is_the_total(stars):
    rows = catalog.CLEAN["cu_month_cost"](stars.clean).collect()
    assert rows[-1]["running_total_cost"] == sum(r["monthly_cost"] for r in rows)
    assert rows == sorted(rows, key=lambda r: r["shipment_month"])


@pytest.mark.parametrize("name, step", list(clean._STEPS.items()))
def test_cleaning_twice_changes_nothing(stars, name, step):
    once = step(stars.raw.table(name))
    assert once.exceptAll(step(once)).count() == 0
    assert once.count() == stars.raw.table(name).count()
    assert once.dtypes == stars.raw.table(name).dtypes


def test_rank_ten_contains_the_top_five(stars):
    names = ["supplier_name", "country", "contract_tier"]
    ten = {tuple(r[n] for n in names) for r in ranking.suppliers(stars.clean, 50).collect()}
    five = {tuple(r[n] for n in names) for r in ranking.worst_suppliers(stars.clean).collect()}
    assert len(five) == 5 and five <= ten


def test_shipment_report_keeps_every_valid_shipment(stars):
    report = reports.shipments(stars.clean)
    assert len(report.columns) == 47
    assert report.count() == dated(stars.clean.facts()).count()


def test_month_labels_sort_as_text(stars):
    months = [r[0] for r in trend.by_month_label(stars.clean).collect()]
    assert months == sorted(months) and months[0].endswith("Apr")


def test_null_status_is_not_valid(spark):
    df = spark.createDataFrame([(None,), ("",), ("Data Error",), ("Delivered",)], "status string")
    assert [r[0] for r in valid(df).collect()] == ["", "Delivered"]


def test_flag_wins_over_blank_status(spark):
    rows = [("2024-01-10", "2024-01-12", "2024-01-09", " ", None),
            ("2024-01-10", "2024-01-12", "2024-01-14", None, None),
            ("2024-01-10", None, "2024-01-14", "Delivered", None)]
    df = spark.createDataFrame(rows, "o string, p string, a string, status string, delay_days int")
    df = df.select(F.to_date("o").alias("order_date"), F.to_date("p").alias("promised_date"),
                   F.to_date("a").alias("actual_date"), "status", "delay_days",
                   *[F.lit(None).cast("decimal(12,2)").alias(c) for c in ("shipment_cost", "weight_kg")],
                   F.lit(None).cast("int").alias("quantity"))
    got = [(r["status"], r["delay_days"]) for r in clean.clean_shipments(df).collect()]
    assert got == [("Data Error", -3), ("Unknown", 2), ("Delivered", None)]


def test_listing_can_merge_spellings(stars):
    exact = explore.listing(stars.raw, "ex_carrier_modes")
    merged = explore.listing(stars.raw, "ex_carrier_modes", case_insensitive=True)
    folded = {(r[0] or "").rstrip().lower() for r in exact.collect() if r[0] is not None}
    assert {r[0].rstrip().lower() for r in merged.collect() if r[0] is not None} == folded
    assert merged.count() < exact.count()


def test_sketched_profile_is_close(stars):
    exact = {(r["table_name"], r["column_name"]): r for r in explore.profile(stars.raw).collect()}
    for r in explore.profile(stars.raw, approximate=True).collect():
        e = exact[r["table_name"], r["column_name"]]
        assert (r["n_null"], r["n_blank"]) == (e["n_null"], e["n_blank"])
        assert abs(r["n_distinct"] - e["n_distinct"]) <= 0.2 * e["n_distinct"] + 1


def test_drill_over_all_groups_equals_the_total(stars):
    g = reports.drill(stars.clean, ["transport_mode", "cost_band"])
    assert one(g.agg(F.sum("total_shipments"))) == dated(stars.clean.facts()).count()


def test_published_views(spark, stars, tmp_path):
    from datetime import date
    reports.publish(stars.clean, date(2001, 11, 5), str(tmp_path))
    assert spark.table("report_shipments").columns == reports.SHIPMENT_REPORT
    assert spark.table("report_suppliers").count() > 0


def test_shares_of_nothing(spark, stars):
    nothing = stars.clean.transformed({"fact_shipments": lambda df: df.where("false")})
    assert share.country_volume(nothing).collect() == []
    assert one(kpi.on_time_rate(nothing)) is None
    assert reduce(lambda a, b: a + b, [len(ranking.carriers(nothing).collect())]) == 0
