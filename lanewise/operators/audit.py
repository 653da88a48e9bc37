"""Counts of dirty records before, between and after cleaning.

All checks on one table are conditional counts in a single pass over it.  The
names of the checks are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions.exprs import blank
from lanewise.functions.labels import DATA_ERROR
from lanewise.sources.star import Star


def _checks(df: DataFrame, checks: dict[str, Column], value: str) -> DataFrame:
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    return counts.unpivot([], [F.col(f"`{name}`") for name in checks], "check_name", value)


def _all_checks(parts, value: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_checks(df, checks, value) for df, checks in parts])


def before(star: Star) -> DataFrame:
    """Thirteen counts on the raw tables."""
    parts = [
        (star.suppliers, {
            "suppliers_missing_name": blank("supplier_name"),
            "suppliers_missing_country": blank("country"),
            "suppliers_missing_tier": blank("contract_tier"),
            "suppliers_missing_rating": F.col("rating").isNull(),
            "suppliers_missing_status": blank("status"),
        }),
        (star.carriers, {
            "carriers_missing_mode": blank("transport_mode"),
            "carriers_missing_otd_rate": F.col("on_time_rate").isNull(),
        }),
        (star.routes, {
            "routes_missing_origin_or_destination": blank("origin") | blank("destination"),
        }),
        (star.facts(), {
            "shipments_missing_actual_date": F.col("actual_date").isNull(),
            "shipments_delay_not_calculated": _delay_missing(),
            "impossible_date_records": F.col("actual_date") < F.col("order_date"),
            "shipments_missing_cost": F.col("shipment_cost").isNull(),
            "shipments_missing_status": blank("status"),
        }),
    ]
    return _all_checks(parts, "issues")


def after(star: Star) -> DataFrame:
    """Eleven counts on the clean tables.

    The last one counts the shipments that cleaning flags on purpose, so it is
    above zero whenever there was an impossible date.
    """
    parts = [
        (star.suppliers, {
            "ref_suppliers — dirty names": blank("supplier_name"),
            "ref_suppliers — dirty countries": blank("country"),
        }),
        (star.carriers, {
            "ref_carriers — dirty modes": blank("transport_mode"),
            "ref_carriers — null on_time_rate": F.col("on_time_rate").isNull(),
        }),
        (star.routes, {
            "ref_routes — dirty origins": blank("origin"),
            "ref_routes — dirty destinations": blank("destination"),
        }),
        (star.products, {
            "ref_products — dirty names": blank("product_name"),
        }),
        (star.facts(), {
            "fact_shipments — blank status": blank("status"),
            "fact_shipments — null cost": F.col("shipment_cost").isNull(),
            "fact_shipments — null delay_days": _delay_missing(),
            "fact_shipments — impossible dates": F.col("status") == DATA_ERROR,
        }),
    ]
    return _all_checks(parts, "remaining_issues")


def confirm_suppliers(star: Star) -> DataFrame:
    dirty = blank("supplier_name") | blank("country") | blank("contract_tier") | blank("status")
    return star.suppliers.agg(F.count_if(dirty).alias("remaining_dirty_supplier_records"))


def confirm_carriers(star: Star) -> DataFrame:
    dirty = (blank("carrier_name") | blank("transport_mode")
             | F.col("on_time_rate").isNull() | F.col("avg_cost_per_km").isNull())
    return star.carriers.agg(F.count_if(dirty).alias("remaining_dirty_carrier_records"))


def confirm_routes(star: Star) -> DataFrame:
    dirty = blank("origin") | blank("destination") | blank("region")
    return star.routes.agg(F.count_if(dirty).alias("remaining_dirty_route_records"))


def confirm_products(star: Star) -> DataFrame:
    dirty = blank("product_name") | blank("category") | blank("fragility")
    return star.products.agg(F.count_if(dirty).alias("remaining_dirty_product_records"))


def confirm_shipments(star: Star) -> DataFrame:
    return star.facts().agg(
        F.count_if(_delay_missing()).alias("delay_days_still_null_with_actual_date"),
        F.count_if(blank("status")).alias("remaining_blank_statuses"),
        F.count_if(F.col("shipment_cost").isNull()).alias("remaining_null_costs"),
    )


def _delay_missing() -> Column:
    return F.col("delay_days").isNull() & F.col("actual_date").isNotNull()
