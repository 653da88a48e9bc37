"""Date ranges, delivery windows and date sanity counts on the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions.exprs import month_span, whole_division, year_span
from lanewise.sources.star import Star


def order_span(star: Star) -> DataFrame:
    return star.facts().agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    ).withColumn("data_range_months", month_span("first_order_date", "last_order_date"))


def delivery_span(star: Star) -> DataFrame:
    return star.facts().agg(
        F.min("actual_date").alias("first_delivery_date"),
        F.max("actual_date").alias("last_delivery_date"),
    ).withColumn("delivery_range_months", month_span("first_delivery_date", "last_delivery_date"))


def promised_window(star: Star) -> DataFrame:
    return _day_range(star, "promised_date", "promised_window_days")


def actual_transit(star: Star) -> DataFrame:
    return _day_range(star, "actual_date", "actual_transit_days")


def _day_range(star: Star, end: str, suffix: str) -> DataFrame:
    days = F.date_diff(end, "order_date")
    return star.facts().agg(
        F.min(days).alias(f"shortest_{suffix}"),
        F.max(days).alias(f"longest_{suffix}"),
        whole_division(F.sum(days), F.count(days)).alias(f"avg_{suffix}"),
    )


def supplier_span(star: Star) -> DataFrame:
    return star.suppliers.agg(
        F.min("onboarded_date").alias("first_supplier_onboarded"),
        F.max("onboarded_date").alias("last_supplier_onboarded"),
    ).withColumn("supplier_network_span_years",
                 year_span("first_supplier_onboarded", "last_supplier_onboarded"))


def yearly_volume(star: Star) -> DataFrame:
    dated = star.facts().where(F.col("order_date").isNotNull())
    return (
        dated.groupBy(F.year("order_date").alias("shipment_year"))
        .agg(F.count("shipment_key").alias("total_shipments"))
        .orderBy("shipment_year")
    )


def _count_where(star: Star, test: Column, name: str) -> DataFrame:
    return star.facts().where(test).agg(F.count(F.lit(1)).alias(name))


def impossible_dates(star: Star) -> DataFrame:
    return _count_where(star, F.col("actual_date") < F.col("order_date"), "impossible_date_records")


def promised_before_ordered(star: Star) -> DataFrame:
    return _count_where(star, F.col("promised_date") < F.col("order_date"), "promised_before_ordered")


def missing_actual(star: Star) -> DataFrame:
    return _count_where(star, F.col("actual_date").isNull(), "shipments_missing_actual_date")
