"""Running totals and moving averages over calendar buckets (clean tables).

Shipments are aggregated to months or years first; the windows then run over
those few rows.  Averages of money and rates are taken over exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.functions import measures as m
from lanewise.functions.exprs import percentage
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star


def _so_far(bucket: str):
    return Window.orderBy(bucket)


def _running(column: str, bucket: str) -> Column:
    return F.sum(column).over(_so_far(bucket))


def _float_average(column: str, window) -> Column:
    """Average as double of an exact sum, so the order of addition is irrelevant."""
    return F.sum(column).over(window).cast("double") / F.count(column).over(window)


def _buckets(star: Star, unit: str, name: str, states: list[str], *scopes: str) -> DataFrame:
    return totals(star, states, ("dated", *scopes), at={name: F.trunc("order_date", unit)})


def monthly_cost(star: Star) -> DataFrame:
    bucket = "shipment_month"
    g = _buckets(star, "MM", bucket, ["shipments", "late", "cost"], "costed")
    months = g.select(
        bucket,
        F.col("shipments").alias("monthly_shipments"),
        m.total_cost().alias("monthly_cost"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("_rate"),
    )
    return (
        months.withColumn("running_total_cost", _running("monthly_cost", bucket))
        .withColumn("moving_avg_delay_rate", F.avg("_rate").over(_so_far(bucket)))
        .drop("_rate").orderBy(bucket)
    )


def monthly_delayed(star: Star) -> DataFrame:
    """The rolling average covers three rows, which need not be adjacent months."""
    bucket = "shipment_month"
    g = _buckets(star, "MM", bucket, ["late"])
    rolling = Window.orderBy(bucket).rowsBetween(-2, Window.currentRow)
    return g.select(bucket, F.col("late").alias("monthly_delayed")).withColumns({
        "running_total_delayed": _running("monthly_delayed", bucket),
        "rolling_3m_avg_delayed": _float_average("monthly_delayed", rolling),
    }).orderBy(bucket)


def yearly_cost(star: Star) -> DataFrame:
    bucket = "shipment_year"
    g = _buckets(star, "year", bucket, ["shipments", "late", "late_days", "cost"], "costed")
    years = g.select(
        bucket,
        F.col("shipments").alias("yearly_shipments"),
        m.total_cost().alias("yearly_cost"),
        F.col("late").alias("yearly_delayed"),
        m.average_delay(2).alias("_delay"),
    )
    return years.withColumns({
        "running_total_cost": _running("yearly_cost", bucket),
        "moving_avg_yearly_cost": _float_average("yearly_cost", _so_far(bucket)),
        "moving_avg_delay_days": _float_average("_delay", _so_far(bucket)),
    }).drop("_delay").orderBy(bucket)


def monthly_on_time(star: Star) -> DataFrame:
    bucket = "shipment_month"
    g = _buckets(star, "MM", bucket, ["on_time", "late"])
    months = g.select(bucket, F.col("on_time").alias("monthly_on_time"),
                      F.col("late").alias("monthly_delayed"))
    return (
        months.withColumns({
            "running_total_on_time": _running("monthly_on_time", bucket),
            "running_total_delayed": _running("monthly_delayed", bucket),
        })
        .withColumn("cumulative_otd_rate_pct", percentage(
            F.col("running_total_on_time"),
            F.col("running_total_on_time") + F.col("running_total_delayed")))
        .orderBy(bucket)
    )


def yearly_delay_cost(star: Star) -> DataFrame:
    bucket = "shipment_year"
    g = _buckets(star, "year", bucket, ["late_cost", "cost"], "costed")
    return (
        g.withColumns({
            "_late": _running("late_cost", bucket),
            "_all": _running("cost", bucket),
        })
        .select(
            bucket,
            m.late_cost().alias("cost_of_delays"),
            m.total_cost().alias("total_cost"),
            m.from_cents(F.col("_late")).alias("running_cost_of_delays"),
            m.from_cents(F.col("_all")).alias("running_total_cost"),
            percentage(F.col("_late"), F.col("_all")).alias("cumulative_delay_cost_pct"),
        )
        .orderBy(bucket)
    )
