"""Cleaning: raw tables in, clean tables out, one projection per table.

The rules apply in order, so a later rule sees the result of an earlier one.
Warehouses are not cleaned, nor are onboarding dates.  The replacement texts
(``Unknown ...``) are fixed values.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanewise import schema
from lanewise.functions.exprs import blank, fill_blank, title_case
from lanewise.functions.labels import DATA_ERROR
from lanewise.plans import versions
from lanewise.sources.star import MONTH, Star, marks_of, months_of, read_star


def _or_zero(df: DataFrame, *names: str) -> dict:
    return {n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType)) for n in names}


def clean_suppliers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "supplier_name": fill_blank("supplier_name", "Unknown Supplier"),
        "country": title_case(fill_blank("country", "Unknown")),
        "category": fill_blank("category", "Unknown"),
        "contract_tier": fill_blank("contract_tier", "Unknown"),
        "status": fill_blank("status", "Unknown"),
        **_or_zero(df, "rating"),
    })


def clean_carriers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "carrier_name": fill_blank("carrier_name", "Unknown Carrier"),
        "transport_mode": title_case(fill_blank("transport_mode", "Unknown")),
        "coverage_region": fill_blank("coverage_region", "Unknown"),
        "status": fill_blank("status", "Unknown"),
        **_or_zero(df, "on_time_rate", "avg_cost_per_km"),
    })


def clean_routes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "origin": fill_blank("origin", "Unknown"),
        "destination": fill_blank("destination", "Unknown"),
        "region": fill_blank("region", "Unknown"),
        **_or_zero(df, "distance_km", "avg_transit_days"),
    })


def clean_products(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "product_name": fill_blank("product_name", "Unknown Product"),
        "category": fill_blank("category", "Unknown"),
        "fragility": fill_blank("fragility", "Unknown"),
        **_or_zero(df, "weight_kg", "value_usd"),
    })


def clean_shipments(df: DataFrame) -> DataFrame:
    """A delivery before its order is flagged, not removed.

    The flag comes before the blank rule: a flagged shipment with a blank
    status stays flagged.  A missing delay is filled for flagged rows too.
    """
    late_by = F.date_diff("actual_date", "promised_date")
    return df.withColumns({
        "delay_days": F.coalesce(F.col("delay_days"), late_by),
        "status": F.when(F.col("actual_date") < F.col("order_date"), F.lit(DATA_ERROR))
        .when(blank("status"), F.lit("Unknown")).otherwise(F.col("status")),
        **_or_zero(df, "shipment_cost", "weight_kg", "quantity"),
    })


_STEPS = {
    "ref_suppliers": clean_suppliers,
    "ref_carriers": clean_carriers,
    "ref_routes": clean_routes,
    "ref_products": clean_products,
    "fact_shipments": clean_shipments,
}


def clean_star(star: Star) -> Star:
    return star.transformed(_STEPS)


def clean_stored(spark: SparkSession, raw: str, clean: str) -> dict[str, list[str]]:
    """Bring the clean tables stored below ``clean`` up to the raw ones below ``raw``.

    Only what has changed is cleaned: months of shipments whose files are not those
    their clean month was made from, and other tables as a whole.  Gives the parts
    written, by table.  Readers keep the versions they have resolved.
    """
    star = read_star(spark, raw)

    def one(name: str) -> list[str]:
        step, there = _STEPS.get(name, lambda df: df), f"{clean}/{name}"
        rows = star.facts(*schema.FOREIGN_KEYS) if name == "fact_shipments" else star.table(name)
        if name != "fact_shipments":
            made = versions.refresh_whole(spark, there, marks_of(spark, raw, [name]), lambda: step(rows))
            return [versions.ROWS] * made
        return versions.refresh(
            spark, there, months_of(spark, raw), MONTH,
            lambda parts: step(versions.of_months(rows, MONTH, parts)), dealt=True)

    with ThreadPoolExecutor(len(schema.TABLES)) as pool:  # the tables are independent
        return dict(zip(schema.TABLES, pool.map(one, schema.TABLES)))
