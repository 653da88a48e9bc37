"""Best and worst performers, on the clean tables.

Flagged shipments are counted here, unlike in the other analyses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanewise.functions import labels, measures as m
from lanewise.functions.exprs import unknown, utilisation
from lanewise.plans.ranking import falling, keep_rank, rank_all, tiles
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star

SUPPLIER = ["supplier_name", "country", "contract_tier"]


def _by_supplier(star: Star, states: list[str], more: dict | None = None) -> DataFrame:
    return totals(star, states,
                   dimension=star.suppliers, key="supplier_key",
                   by={**{c: F.col(c) for c in SUPPLIER}, **(more or {})})


def _top_five(df: DataFrame, rate: str) -> DataFrame:
    """Exactly five rows; equal rates are ordered by the group columns."""
    return df.orderBy(F.desc(rate), *[F.asc_nulls_first(c) for c in SUPPLIER]).limit(5)


def worst_suppliers(star: Star) -> DataFrame:
    g = _by_supplier(star, ["shipments", "late"])
    return _top_five(g.select(
        *SUPPLIER,
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
    ), "delay_rate_pct")


def best_suppliers(star: Star) -> DataFrame:
    g = _by_supplier(star, ["shipments", "on_time"])
    return _top_five(g.select(
        *SUPPLIER,
        F.col("shipments").alias("total_shipments"),
        m.on_time_rate().alias("on_time_rate_pct"),
    ), "on_time_rate_pct")


def suppliers(star: Star, limit: int = 10) -> DataFrame:
    g = _by_supplier(star, ["shipments", "late", "cost"], {"supplier_rating": F.col("rating")})
    return keep_rank(g, m.exact_delay_rate(), limit, "delay_rank").select(
        *SUPPLIER, "supplier_rating",
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
        m.total_cost().alias("total_cost"),
        "delay_rank",
    )


def carriers(star: Star) -> DataFrame:
    """Contracted against delivered on-time rate, every carrier ranked."""
    groups = ["carrier_name", "transport_mode", "contracted_otd_rate"]
    g = totals(star, ["shipments", "on_time", "cost", "costed"],
                dimension=star.carriers, key="carrier_key",
                by={"carrier_name": F.col("carrier_name"),
                    "transport_mode": F.col("transport_mode"),
                    "contracted_otd_rate": F.col("on_time_rate")})
    gap = F.round(F.col("contracted_otd_rate").cast("decimal(7,2)") - m.exact_on_time_rate(), 2)
    return rank_all(g, m.exact_on_time_rate(), groups, "reliability_rank").select(
        *groups,
        F.col("shipments").alias("total_shipments"),
        m.on_time_rate().alias("actual_otd_rate_pct"),
        gap.cast("decimal(20,2)").alias("otd_gap_vs_contract"),
        m.average_cost().alias("avg_shipment_cost"),
        "reliability_rank",
    ).orderBy("reliability_rank")


def routes(star: Star, limit: int = 10) -> DataFrame:
    g = totals(star, ["shipments", "late", "late_days"],
                dimension=star.routes, key="route_key",
                by={"origin": F.col("origin"), "destination": F.col("destination"),
                    "region": F.col("region"), "distance_km": F.col("distance_km"),
                    "expected_transit_days": F.col("avg_transit_days")})
    return keep_rank(g, m.exact_delay_rate(), limit, "route_delay_rank").select(
        "origin", "destination", "region", "distance_km", "expected_transit_days",
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
        m.average_delay().alias("avg_delay_days_when_late"),
        "route_delay_rank",
    )


def warehouses(star: Star, limit: int = 5) -> DataFrame:
    columns = ["location", "region", "capacity", "current_load", "processing_time_avg"]
    g = totals(star, ["shipments", "late"],
                dimension=star.warehouses, key="warehouse_key",
                by={c: F.col(c) for c in columns})
    return keep_rank(g, m.exact_delay_rate(), limit, "bottleneck_rank").select(
        "location", "region", "capacity", "current_load",
        utilisation("current_load", "capacity").alias("utilisation_pct"),
        "processing_time_avg",
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
        "bottleneck_rank",
    )


def supplier_quartiles(star: Star) -> DataFrame:
    """Four groups by descending delay rate; ties follow the group columns."""
    g = _by_supplier(star, ["shipments", "late"]).select(
        *SUPPLIER,
        F.col("shipments").alias("total_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
    )
    order = [*falling("delay_rate_pct"), *map(F.col, SUPPLIER)]
    quartile = F.col("performance_quartile")
    label = F.element_at(F.create_map(*[F.lit(x) for p in labels.QUARTILES.items() for x in p]),
                         quartile)
    return (
        tiles(g, order, 4, "performance_quartile")
        .withColumn("quartile_label", label)
        .orderBy("performance_quartile", F.desc("delay_rate_pct"))
    )


def product_exposure(star: Star) -> DataFrame:
    """Product categories by the cost of their delayed shipments."""
    g = totals(star, ["shipments", "late", "late_cost"],
                dimension=star.products, key="product_key",
                by={"product_category": unknown("category")})
    return rank_all(g, F.col("late_cost"), ["product_category"], "cost_exposure_rank").select(
        "product_category",
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.late_cost().alias("cost_of_delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
        "cost_exposure_rank",
    ).orderBy("cost_exposure_rank")
