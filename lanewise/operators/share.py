"""Each group's share of the overall total: valid shipments of the clean tables.

The overall totals are a scalar subquery over the same groups.  All states are
totalled in one struct, so the subquery has the plan of the groups and reuses
their shuffle: one scan, and no task sees all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions import measures as m
from lanewise.functions.exprs import from_cents, percentage, unknown
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star


def _cost() -> Column:
    return m.total_cost().alias("total_cost")


def _with_totals(groups: DataFrame, states: list[str]) -> DataFrame:
    whole = groups.agg(F.struct(*[F.sum(s).alias(s) for s in states])).scalar()
    return groups.withColumn("overall", whole)


def _grouped(star: Star, scopes: tuple[str, ...], states: list[str], dimension: DataFrame, key: str,
             by: dict[str, Column]) -> DataFrame:
    return _with_totals(totals(star, states, scopes, dimension=dimension, key=key, by=by), states)


def _share(state: str) -> Column:
    return percentage(F.col(state), F.col(f"overall.{state}"))


def country_volume(star: Star) -> DataFrame:
    g = _grouped(star, ("valid",), ["shipments"],
                 star.suppliers, "supplier_key", {"supplier_country": unknown("country")})
    return g.select("supplier_country", m.total_shipments(),
                    F.col("overall.shipments").alias("overall_shipments"),
                    _share("shipments").alias("percentage_of_total"),
                    ).orderBy(F.desc("total_shipments"))


def mode_cost(star: Star) -> DataFrame:
    g = _grouped(star, ("valid", "costed"), ["cost"],
                 star.carriers, "carrier_key", {"transport_mode": unknown("transport_mode")})
    return g.select("transport_mode", _cost(),
                    from_cents(F.col("overall.cost")).alias("overall_cost"),
                    _share("cost").alias("percentage_of_total"),
                    ).orderBy(F.desc("total_cost"))


def region_delays(star: Star) -> DataFrame:
    g = _grouped(star, ("valid",), ["shipments", "late"],
                 star.routes, "route_key", {"route_region": unknown("region")})
    return g.select("route_region", F.col("late").alias("total_delayed"), m.total_shipments(),
                    F.col("overall.late").alias("overall_delayed"),
                    _share("late").alias("percentage_of_total_delays"),
                    ).orderBy(F.desc("total_delayed"))


def product_cost(star: Star) -> DataFrame:
    g = _grouped(star, ("valid", "costed"), ["shipments", "cost"],
                 star.products, "product_key", {"product_category": unknown("category")})
    return g.select("product_category", m.total_shipments(), _cost(),
                    from_cents(F.col("overall.cost")).alias("overall_cost"),
                    _share("cost").alias("percentage_of_total"),
                    ).orderBy(F.desc("total_cost"))


def warehouse_volume(star: Star) -> DataFrame:
    g = _grouped(star, ("valid",), ["shipments", "cost"],
                 star.warehouses, "warehouse_key",
                 {"warehouse_location": unknown("location"), "warehouse_region": unknown("region")})
    return g.select("warehouse_location", "warehouse_region", m.total_shipments(), _cost(),
                    F.col("overall.shipments").alias("overall_shipments"),
                    _share("shipments").alias("percentage_of_total"),
                    ).orderBy(F.desc("total_shipments"))


def tier_cost(star: Star) -> DataFrame:
    g = _grouped(star, ("valid", "costed"), ["shipments", "late", "cost"],
                 star.suppliers, "supplier_key", {"contract_tier": unknown("contract_tier")})
    return g.select("contract_tier", m.total_shipments(), _cost(), F.col("late").alias("total_delayed"),
                    from_cents(F.col("overall.cost")).alias("overall_cost"),
                    _share("cost").alias("pct_of_total_cost"),
                    m.delay_rate().alias("delay_rate_within_tier"),
                    ).orderBy(F.desc("total_cost"))
