"""Volume, cost and delay by dimension attribute, on the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions import labels, measures as m
from lanewise.functions.exprs import average_from_cents, from_cents, unknown, whole_division
from lanewise.plans.rollup import roll_up
from lanewise.sources.star import Star


def _cost() -> Column:
    return m.total_cost().alias("total_cost")


def _average() -> Column:
    return m.average_cost().alias("avg_cost_per_shipment")


def _most_first(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns).orderBy(F.desc("total_shipments"))


def by_supplier_country(star: Star) -> DataFrame:
    g = roll_up(star.facts("supplier_key"), ["shipments"], dimension=star.suppliers, key="supplier_key",
                by={"country": unknown("country")})
    return _most_first(g, "country", m.total_shipments())


def by_supplier_category(star: Star) -> DataFrame:
    g = roll_up(star.facts("supplier_key"), ["shipments"], dimension=star.suppliers, key="supplier_key",
                by={"supplier_category": unknown("category")})
    return _most_first(g, "supplier_category", m.total_shipments())


def by_supplier_tier(star: Star) -> DataFrame:
    g = roll_up(star.facts("supplier_key"), ["shipments"], dimension=star.suppliers, key="supplier_key",
                by={"contract_tier": unknown("contract_tier")})
    return _most_first(g, "contract_tier", m.total_shipments())


def by_mode(star: Star) -> DataFrame:
    g = roll_up(star.facts("carrier_key"), ["shipments", "cost", "costed"],
                dimension=star.carriers, key="carrier_key",
                by={"transport_mode": unknown("transport_mode")})
    return _most_first(g, "transport_mode", m.total_shipments(), _cost(), _average())


def by_coverage_region(star: Star) -> DataFrame:
    g = roll_up(star.facts("carrier_key"), ["shipments", "cost", "costed"],
                dimension=star.carriers, key="carrier_key",
                by={"coverage_region": unknown("coverage_region")})
    return _most_first(g, "coverage_region", m.total_shipments(), _average())


def by_route_region(star: Star) -> DataFrame:
    """The average distance weighs each route by its shipments and is a whole number."""
    rows = F.when(F.col("distance_km").isNotNull(), F.col("fact_rows"))
    g = roll_up(star.facts("route_key"), ["fact_rows", "shipments", "cost", "costed"],
                dimension=star.routes, key="route_key",
                by={"route_region": unknown("region")},
                extra=[F.sum(F.col("distance_km") * rows).alias("distance"),
                       F.sum(rows).alias("measured")])
    average = whole_division(F.col("distance"), F.col("measured")).alias("avg_distance_km")
    return _most_first(g, "route_region", m.total_shipments(), _average(), average)


def by_warehouse(star: Star) -> DataFrame:
    g = roll_up(star.facts("warehouse_key"), ["shipments", "cost"],
                dimension=star.warehouses, key="warehouse_key",
                by={"warehouse_location": unknown("location"),
                    "warehouse_region": unknown("region")})
    return _most_first(g, "warehouse_location", "warehouse_region", m.total_shipments(), _cost())


def by_product_category(star: Star) -> DataFrame:
    """The average weight is that of the shipments, not of the products."""
    g = roll_up(star.facts("product_key"), ["shipments", "cost", "weight", "weighed"],
                dimension=star.products, key="product_key",
                by={"product_category": unknown("category")})
    weight = average_from_cents(F.col("weight"), F.col("weighed")).alias("avg_weight_kg")
    return _most_first(g, "product_category", m.total_shipments(), _cost(), weight)


def by_fragility(star: Star) -> DataFrame:
    g = roll_up(star.facts("product_key"), ["shipments", "cost", "costed"],
                dimension=star.products, key="product_key",
                by={"fragility_level": unknown("fragility")})
    return _most_first(g, "fragility_level", m.total_shipments(), _cost(), _average())


def by_status(star: Star) -> DataFrame:
    """A blank status stays a group of its own."""
    g = roll_up(star.facts(), ["shipments", "cost"],
                at={"shipment_status": F.coalesce(F.trim("status"), F.lit("Unknown"))})
    return _most_first(g, "shipment_status", m.total_shipments(), _cost())


def by_delay_bucket(star: Star) -> DataFrame:
    known = star.facts().where(F.col("delay_days").isNotNull())
    g = roll_up(known, ["shipments", "cost", "costed"],
                at={"delay_bucket": labels.at_most("delay_days", labels.DELAY_BUCKETS)})
    return _most_first(g, "delay_bucket", m.total_shipments(),
                       m.average_cost().alias("avg_cost_in_bucket"))


def tier_cost(star: Star) -> DataFrame:
    g = roll_up(star.facts("supplier_key"), ["shipments", "cost", "costed"],
                dimension=star.suppliers, key="supplier_key",
                by={"contract_tier": unknown("contract_tier")})
    return g.select("contract_tier", m.total_shipments(), _cost(), _average()).orderBy(
        F.desc("avg_cost_per_shipment"))


def mode_cost_range(star: Star) -> DataFrame:
    costed = star.facts("carrier_key").where(F.col("shipment_cost").isNotNull())
    g = roll_up(costed, ["cost", "costed", "min_cost", "max_cost", "weight"],
                dimension=star.carriers, key="carrier_key",
                by={"transport_mode": unknown("transport_mode")})
    return g.select(
        "transport_mode",
        m.average_cost().alias("avg_cost"),
        from_cents(F.col("min_cost")).alias("min_cost"),
        from_cents(F.col("max_cost")).alias("max_cost"),
        from_cents(F.col("weight")).alias("total_weight_kg"),
    ).orderBy(F.desc("avg_cost"))
