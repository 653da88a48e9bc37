"""Headline figures over valid shipments of the clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions import distinct, measures as m
from lanewise.functions.exprs import from_cents, quotient
from lanewise.operators.scope import valid
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star


def _figure(star: Star, states: list[str], figure: Column, name: str) -> DataFrame:
    return totals(star, states, ("valid",)).select(figure.alias(name))


def total_shipments(star: Star) -> DataFrame:
    return _figure(star, ["shipments"], F.col("shipments"), "total_shipments")


def on_time(star: Star) -> DataFrame:
    kept = valid(star.facts()).where(m.is_on_time())
    return kept.agg(F.count("shipment_key").alias("on_time_shipments"))


def delayed(star: Star) -> DataFrame:
    kept = valid(star.facts()).where(m.is_late())
    return kept.agg(F.count("shipment_key").alias("delayed_shipments"))


def on_time_rate(star: Star) -> DataFrame:
    return _figure(star, ["on_time", "shipments"], m.on_time_rate(), "on_time_delivery_rate_pct")


def average_delay(star: Star) -> DataFrame:
    return _figure(star, ["late", "late_days"], m.average_delay(), "avg_delay_days_when_late")


def total_cost(star: Star) -> DataFrame:
    return _figure(star, ["cost"], m.total_cost(), "total_network_cost")


def average_cost(star: Star) -> DataFrame:
    return _figure(star, ["cost", "costed"], m.average_cost(), "avg_shipment_cost")


def total_weight(star: Star) -> DataFrame:
    return _figure(star, ["weight"], from_cents(F.col("weight")), "total_weight_shipped_kg")


def _used(star: Star, keys: list[str]) -> DataFrame:
    """Bitmaps of the keys in use, stored or from one narrow scan for each key."""
    if star.states:
        return star.states.used().where(F.col(distinct.KEY).isin(keys))
    return distinct.bitmaps(valid(star.facts(*keys)), keys)


def _distinct(star: Star, key: str, name: str) -> DataFrame:
    return distinct.wide_counts(_used(star, [key]), [key]).withColumnRenamed(key, name)


def active_suppliers(star: Star) -> DataFrame:
    return _distinct(star, "supplier_key", "total_active_suppliers")


def carriers_used(star: Star) -> DataFrame:
    return _distinct(star, "carrier_key", "total_carriers_used")


def routes_used(star: Star) -> DataFrame:
    return _distinct(star, "route_key", "total_routes_used")


def warehouses_used(star: Star) -> DataFrame:
    return _distinct(star, "warehouse_key", "total_warehouses_used")


def registered_suppliers(star: Star) -> DataFrame:
    return star.suppliers.agg(F.count("supplier_key").alias("total_registered_suppliers"))


def product_categories(star: Star) -> DataFrame:
    return star.products.agg(F.count_distinct("category").alias("total_product_categories"))


def report(star: Star, approximate: bool = False) -> DataFrame:
    """All thirteen figures as rows.

    The keys in use are counted exactly by bitmaps that merge over months, so no
    row is copied for a counted key; ``approximate`` takes sketches instead, in
    the pass of the other figures.
    """
    keys = ["supplier_key", "carrier_key", "route_key", "warehouse_key"]
    states = ["shipments", "on_time", "late", "late_days", "cost", "costed", "weight"]
    if approximate:
        figures = valid(star.facts(*keys)).agg(
            *m.first_pass(states), *[F.approx_count_distinct(k).alias(k) for k in keys])
    else:
        used = distinct.wide_counts(_used(star, keys), keys)
        whole = used.agg(F.first(F.struct(*keys))).scalar()
        figures = totals(star, states, ("valid",)).withColumn("_used", whole).select("*", "_used.*")
    whole_cost = F.round(from_cents(F.col("cost")), 0)
    # Names of the figures.
    rows = {
        "Total Shipments": F.col("shipments"),
        "On-Time Shipments": F.col("on_time"),
        "Delayed Shipments": F.col("late"),
        "Total Network Cost (USD)": whole_cost,
        "Avg Shipment Cost (USD)": F.round(quotient(F.col("cost"), F.col("costed") * 100), 0),
        "Avg Delay Days (Late Only)": m.average_delay(0),
        "Total Weight Shipped (kg)": F.round(from_cents(F.col("weight")), 0),
        "Active Suppliers": F.col("supplier_key"),
        "Registered Suppliers": registered_suppliers(star).scalar(),
        "Active Carriers": F.col("carrier_key"),
        "Active Routes": F.col("route_key"),
        "Active Warehouses": F.col("warehouse_key"),
        "Total Product Categories": product_categories(star).scalar(),
    }
    return figures.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure_name"), value.cast("double").alias("measure_value"))
        for name, value in rows.items()])))
