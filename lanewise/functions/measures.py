"""Mergeable measures over shipments.

A *state* is a partial result that can be computed per foreign key first and
merged per attribute later (counts, sums, extremes).  The finishing functions
turn merged states into the published figures.  Money and weight are summed as
BIGINT hundredths: exact, and inside Spark's 8-byte aggregation buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from lanewise.functions.exprs import (
    average_from_cents, cents, from_cents, percentage, quotient,
)


def is_late() -> Column:
    return F.col("delay_days") > 0


def is_on_time() -> Column:
    """A shipment without a delay figure counts as on time."""
    return F.coalesce(F.col("delay_days"), F.lit(0)) <= 0


def _states() -> dict[str, tuple[Column, str]]:
    late = is_late()
    cost = cents("shipment_cost")
    weight = cents("weight_kg")
    return {
        "fact_rows": (F.count(F.lit(1)), "sum"),
        "shipments": (F.count("shipment_key"), "sum"),
        "late": (F.count_if(late), "sum"),
        "on_time": (F.count_if(is_on_time()), "sum"),
        "late_days": (F.sum(F.when(late, F.col("delay_days"))), "sum"),
        "cost": (F.sum(cost), "sum"),
        "costed": (F.count("shipment_cost"), "sum"),
        "min_cost": (F.min(cost), "min"),
        "max_cost": (F.max(cost), "max"),
        "late_cost": (F.sum(F.when(late, cost).otherwise(F.lit(0))), "sum"),
        "weight": (F.sum(weight), "sum"),
        "weighed": (F.count("weight_kg"), "sum"),
        "first_order": (F.min("order_date"), "min"),
        "last_order": (F.max("order_date"), "max"),
    }


def names_and_types() -> list[tuple[str, T.DataType]]:
    """All states with the types of their columns."""
    day = {"first_order", "last_order"}
    return [(n, T.DateType() if n in day else T.LongType()) for n in _states()]


def first_pass(names: list[str]) -> list[Column]:
    """Aggregates over shipment rows."""
    states = _states()
    return [states[n][0].alias(n) for n in names]


def second_pass(names: list[str]) -> list[Column]:
    """Aggregates that merge the columns made by :func:`first_pass`."""
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    states = _states()
    return [merge[states[n][1]](n).alias(n) for n in names]


def whole_pass(names: list[str]) -> list[Column]:
    """As :func:`second_pass` over all rows, of which there may be none: counts are 0 then."""
    counts = {"fact_rows", "shipments", "late", "on_time", "costed", "weighed"}
    return [F.coalesce(c, F.lit(0)).alias(n) if n in counts else c for n, c in zip(names, second_pass(names))]


# --- finishing ----------------------------------------------------------------


def total_shipments() -> Column:
    return F.col("shipments").alias("total_shipments")


def delayed_shipments() -> Column:
    return F.col("late").alias("delayed_shipments")


def delay_rate() -> Column:
    return percentage(F.col("late"), F.col("shipments"))


def on_time_rate() -> Column:
    return percentage(F.col("on_time"), F.col("shipments"))


def exact_delay_rate() -> Column:
    return quotient(F.col("late"), F.col("shipments"), 100)


def exact_on_time_rate() -> Column:
    return quotient(F.col("on_time"), F.col("shipments"), 100)


def total_cost() -> Column:
    return from_cents(F.col("cost"))


def average_cost() -> Column:
    return average_from_cents(F.col("cost"), F.col("costed"))


def late_cost() -> Column:
    return from_cents(F.col("late_cost"))


def average_delay(digits: int = 1) -> Column:
    """Average days late over late shipments only; NULL when none is late."""
    return F.round(quotient(F.col("late_days"), F.col("late")), digits).cast(f"decimal(20,{digits})")
