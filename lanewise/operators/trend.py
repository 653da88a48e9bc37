"""Volume, delay and cost over time: valid, dated shipments of the clean tables.

The groups are calendar buckets, so a window over them holds a few rows per
year of data, however many shipments there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.functions import labels, measures as m
from lanewise.functions.exprs import unknown
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star


def _rate() -> Column:
    return m.delay_rate().alias("delay_rate_pct")


def _cost() -> Column:
    return m.total_cost().alias("total_cost")


def _average() -> Column:
    return m.average_cost().alias("avg_cost_per_shipment")


def _year() -> Column:
    return F.year("order_date")


def _month() -> Column:
    return F.trunc("order_date", "MM")


def _over_time(star: Star, at: dict[str, Column], states: list[str], *figures: Column) -> DataFrame:
    g = totals(star, states, ("dated",), at=at)
    return g.select(*at, *figures).orderBy(*at)


def by_year_and_month(star: Star) -> DataFrame:
    return _over_time(
        star, {"shipment_year": _year(), "shipment_month": F.month("order_date")},
        ["shipments", "late", "cost", "costed", "late_days"],
        m.total_shipments(), m.delayed_shipments(), _rate(), _cost(), _average(),
        m.average_delay().alias("avg_delay_days_when_late"))


def by_month(star: Star) -> DataFrame:
    return _over_time(star, {"shipment_month": _month()}, ["shipments", "late", "cost", "costed"],
                      m.total_shipments(), m.delayed_shipments(), _rate(), _cost(), _average())


def by_month_label(star: Star) -> DataFrame:
    """Labels sort as text: April comes before January."""
    # one label per month, not per shipment: formatting follows the aggregation
    g = totals(star, ["shipments", "late", "cost"], ("dated",), at={"month": _month()})
    return g.select(
        F.date_format("month", "yyyy-MMM").alias("shipment_month"),
        m.total_shipments(), m.delayed_shipments(), _rate(), _cost(),
    ).orderBy("shipment_month")


def by_quarter(star: Star) -> DataFrame:
    return _over_time(
        star, {"shipment_year": _year(), "shipment_quarter": F.quarter("order_date")},
        ["shipments", "late", "cost"], m.total_shipments(), m.delayed_shipments(), _rate(), _cost(),
        labels.at_least(m.exact_delay_rate(), labels.QUARTER_RISK).alias("quarter_risk_flag"))


def by_year(star: Star) -> DataFrame:
    return _over_time(star, {"shipment_year": _year()}, ["shipments", "late", "cost", "costed"],
                      m.total_shipments(), m.delayed_shipments(), _rate(), _cost(), _average())


def month_over_month(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late", "cost"], ("dated",), at={"shipment_month": _month()})
    rates = g.select("shipment_month", _rate(), m.total_cost().alias("monthly_cost"))
    previous = F.lag("delay_rate_pct").over(Window.orderBy("shipment_month"))
    return (
        rates.withColumn("prev_month_delay_rate", previous)
        .withColumn("mom_delay_change", F.col("delay_rate_pct") - F.col("prev_month_delay_rate"))
        .withColumn("trend_direction",
                    direction("mom_delay_change", "prev_month_delay_rate", "Worsening", "Improving"))
        .orderBy("shipment_month")
    )


def by_year_and_mode(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late", "cost"], ("dated",),
               at={"shipment_year": _year()}, dimension=star.carriers, key="carrier_key",
               by={"transport_mode": unknown("transport_mode")})
    return g.select("shipment_year", "transport_mode", m.total_shipments(), _rate(), _cost()).orderBy(
        "shipment_year", "transport_mode")


def by_year_and_region(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late", "cost"], ("dated",),
               at={"shipment_year": _year()}, dimension=star.routes, key="route_key",
               by={"route_region": unknown("region")})
    return g.select("shipment_year", "route_region", m.total_shipments(), _rate(), _cost()).orderBy(
        "shipment_year", "route_region")


def direction(change: str, previous: str, up: str, down: str) -> Column:
    """Label of a change against the previous row; the first row is the baseline."""
    return (
        F.when(F.col(change) > 0, F.lit(up))
        .when(F.col(change) < 0, F.lit(down))
        .when(F.col(previous).isNull(), F.lit("Baseline"))
        .otherwise(F.lit("No Change"))
    )
