"""Segments of suppliers, shipments, warehouses and routes (clean tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanewise.functions import labels, measures as m
from lanewise.functions.exprs import month_span, quotient, utilisation
from lanewise.operators.scope import costed, valid
from lanewise.plans.rollup import DIMENSION_KEY, roll_up, totals
from lanewise.sources.star import Star


def _per_supplier(star: Star, states: list[str]) -> DataFrame:
    return totals(star, states, ("valid",),
                   dimension=star.suppliers, key="supplier_key",
                   by={"supplier_key": F.col(DIMENSION_KEY),
                       "supplier_name": F.col("supplier_name"),
                       "contract_tier": F.col("contract_tier")})


def supplier_tiers(star: Star) -> DataFrame:
    """Shipments of unregistered suppliers form a group that counts no supplier."""
    tier = labels.at_least(m.delay_rate(), labels.SUPPLIER_TIERS)
    return _count_suppliers(_per_supplier(star, ["shipments", "late"]), tier, "performance_tier")


def supplier_relationship(star: Star) -> DataFrame:
    g = _per_supplier(star, ["shipments", "first_order", "last_order"])
    segment = labels.relationship(month_span("first_order", "last_order"), "shipments")
    return _count_suppliers(g, segment, "supplier_segment")


def _count_suppliers(g: DataFrame, segment, name: str) -> DataFrame:
    return (
        g.groupBy(segment.alias(name))
        .agg(F.count("supplier_key").alias("total_suppliers"))
        .orderBy(F.desc("total_suppliers"))
    )


def cost_bands(star: Star, strict_bands: bool = False) -> DataFrame:
    band = labels.band("shipment_cost", labels.COST_BANDS, strict_bands)
    g = roll_up(costed(valid(star.facts())), ["shipments", "late"], at={"cost_band": band})
    return g.select("cost_band", m.total_shipments(), F.col("late").alias("delayed_shipments"),
                    m.delay_rate().alias("delay_rate_pct")).orderBy(F.desc("total_shipments"))


def delay_tiers(star: Star) -> DataFrame:
    known = valid(star.facts()).where(F.col("delay_days").isNotNull())
    g = roll_up(known, ["shipments", "cost", "costed"],
                at={"delay_tier": labels.at_most("delay_days", labels.DELAY_TIERS)})
    return g.select("delay_tier", m.total_shipments(), m.total_cost().alias("total_cost_in_tier"),
                    m.average_cost().alias("avg_cost_in_tier")).orderBy(F.desc("total_shipments"))


def warehouse_load(star: Star) -> DataFrame:
    """Unknown capacity or load counts as low load."""
    load = labels.at_least(utilisation("current_load", "capacity"), labels.WAREHOUSE_LOAD)
    return (
        star.warehouses.groupBy(load.alias("load_segment"))
        .agg(F.count("warehouse_key").alias("total_warehouses"))
        .orderBy(F.desc("total_warehouses"))
    )


def route_distance(star: Star) -> DataFrame:
    """Averages over routes, each route counting once."""
    g = totals(star, ["shipments", "late"], ("valid",),
                dimension=star.routes, key="route_key",
                by={"route_key": F.col(DIMENSION_KEY),
                    **{c: F.col(c) for c in ("origin", "destination", "region", "distance_km")}})
    band = labels.band("distance_km", labels.DISTANCE_BANDS)
    rates = g.withColumn("rate", m.delay_rate())
    bands = rates.groupBy(band.alias("distance_band")).agg(
        F.count("route_key").alias("total_routes"),
        F.avg("rate").alias("rate"),
        F.sum("distance_km").alias("km"),
        F.count("distance_km").alias("measured"),
    )
    return bands.select(
        "distance_band", "total_routes",
        F.round("rate", 2).alias("avg_delay_rate_pct"),
        F.round(quotient(F.col("km"), F.col("measured")), 0).alias("avg_distance_km"),
    ).orderBy(F.desc("avg_delay_rate_pct"))
