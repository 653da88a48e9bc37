"""Each entity's year against its own average and its previous year.

Shipments are aggregated to one row per year and entity first.  The windows are
partitioned by entity name; one name holds at most a row per year and per value
of the other group columns, also the shared name of the unnamed entities.
"Previous" is the previous row of the entity, whether or not years are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.functions import measures as m
from lanewise.functions.exprs import unknown, utilisation
from lanewise.operators.trend import direction
from lanewise.plans.ranking import positions
from lanewise.plans.rollup import totals
from lanewise.sources.star import Star


def _by_year() -> dict[str, Column]:
    return {"shipment_year": F.year("order_date")}


def _against_history(
    df: DataFrame, entity: str, value: str, average: str, previous: str,
    labels: tuple[str, str], ties: list[str],
) -> DataFrame:
    own = Window.partitionBy(entity)
    order = own.orderBy("shipment_year", *[F.asc_nulls_first(c) for c in ties])
    off_average = F.col(value) - F.col(average)
    return (
        # the lag sorts by entity and year, which the average can use as it is
        df.withColumn(previous, F.lag(value).over(order))
        .withColumn(average, F.avg(value).over(own))
        .withColumn("diff_from_avg", F.round(off_average, 2))
        .withColumn("avg_change", F.when(off_average > 0, F.lit("Above Avg"))
                    .when(off_average < 0, F.lit("Below Avg")).otherwise(F.lit("Avg")))
        .withColumn("diff_py", F.col(value) - F.col(previous))
        .withColumn("py_change", direction("diff_py", previous, *labels))
    )


def supplier_delay(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late"], ("dated",), at=_by_year(),
               dimension=star.suppliers, key="supplier_key",
               by={c: F.col(c) for c in ("supplier_name", "country", "contract_tier")})
    rates = g.select("shipment_year", "supplier_name", "country", "contract_tier",
                     m.delay_rate().alias("current_delay_rate"))
    return _against_history(
        rates, "supplier_name", "current_delay_rate", "avg_delay_rate", "py_delay_rate",
        ("Worsening", "Improving"), ["country", "contract_tier"],
    ).orderBy("supplier_name", "shipment_year")


def carrier_on_time(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "on_time"], ("dated",), at=_by_year(),
               dimension=star.carriers, key="carrier_key",
               by={c: F.col(c) for c in ("carrier_name", "transport_mode")})
    rates = g.select("shipment_year", "carrier_name", "transport_mode",
                     m.on_time_rate().alias("current_otd_rate"))
    return _against_history(
        rates, "carrier_name", "current_otd_rate", "avg_otd_rate", "py_otd_rate",
        ("Improving", "Declining"), ["transport_mode"],
    ).orderBy("carrier_name", "shipment_year")


def region_cost(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late", "cost"], ("dated", "costed"), at=_by_year(),
               dimension=star.routes, key="route_key",
               by={"route_region": unknown("region")})
    costs = g.select("shipment_year", "route_region",
                     m.total_cost().alias("current_cost"),
                     m.delay_rate().alias("current_delay_rate"))
    return _against_history(
        costs, "route_region", "current_cost", "avg_cost", "py_cost",
        ("Increase", "Decrease"), [],
    ).orderBy("route_region", "shipment_year")


def _against_numbered_history(
    df: DataFrame, entity: str, value: str, average: str, previous: str,
    labels: tuple[str, str], order: list[str],
) -> DataFrame:
    """As :func:`_against_history` for an entity that may hold any number of rows.

    No task has to hold all rows of an entity: the average is an aggregation
    with a join, the previous row comes from row numbers by key range.
    """
    laid = positions(df, [F.col(c) for c in (entity, "shipment_year", *order)], "_place")
    before = laid.select((F.col("_place") + 1).alias("_next"), F.col(entity).alias("_entity"),
                         F.col(value).alias("_before"))
    means = df.groupBy(F.col(entity).alias("_of")).agg(F.avg(value).alias(average))
    off_average = F.col(value) - F.col(average)
    return (
        laid.join(before, (F.col("_place") == F.col("_next")) & F.col(entity).eqNullSafe(F.col("_entity")), "left")
        .withColumn(previous, F.col("_before"))
        .join(means, F.col(entity).eqNullSafe(F.col("_of")), "left")
        .withColumn("diff_from_avg", F.round(off_average, 2))
        .withColumn("avg_change", F.when(off_average > 0, F.lit("Above Avg"))
                    .when(off_average < 0, F.lit("Below Avg")).otherwise(F.lit("Avg")))
        .withColumn("diff_py", F.col(value) - F.col(previous))
        .withColumn("py_change", direction("diff_py", previous, *labels))
        .drop("_place", "_next", "_entity", "_before", "_of")
    )


def warehouse_delay(star: Star) -> DataFrame:
    g = totals(star, ["shipments", "late"], ("dated",), at=_by_year(),
               dimension=star.warehouses, key="warehouse_key",
               by={"warehouse_location": unknown("location"),
                    "warehouse_region": unknown("region"),
                    "current_load": F.col("current_load"), "capacity": F.col("capacity")})
    rates = g.withColumn("utilisation_pct", utilisation("current_load", "capacity")).withColumn(
        "current_delay_rate", m.delay_rate()).drop("shipments", "late")
    # all warehouses without a name share one
    return _against_numbered_history(
        rates, "warehouse_location", "current_delay_rate", "avg_delay_rate", "py_delay_rate",
        ("Worsening", "Improving"), ["warehouse_region", "current_load", "capacity"],
    ).drop("current_load", "capacity").orderBy("warehouse_location", "shipment_year")
