"""Group shipments by dimension attributes without joining every shipment.

Shipments are first aggregated per foreign key, on the map side, so that the
shuffle and the dimension join see one row per key however many shipments a
key has.  A key that holds a third of the table is absorbed by the partial
aggregate and never meets in one task.  The join is a left join, so shipments
without a matching dimension row stay, and a repeated dimension key counts its
shipments once per repetition, just as a row-level join would.

No side is broadcast by hand: Catalyst broadcasts a dimension whose size
statistics lie under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks
with the real size) and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise.functions.measures import first_pass, second_pass, whole_pass
from lanewise.operators.scope import SCOPES, STATE_SCOPES
from lanewise.sources.star import Star

# The key as the dimension knows it: NULL for shipments without a match.
DIMENSION_KEY = "dimension_key"


def roll_up(
    facts: DataFrame,
    states: list[str],
    at: dict[str, Column] | None = None,
    dimension: DataFrame | None = None,
    key: str | None = None,
    by: dict[str, Column] | None = None,
    extra: list[Column] | None = None,
    first=first_pass,
) -> DataFrame:
    """One row per group with the asked measure states.

    at: group columns over shipment columns.
    by: group columns over dimension columns (``DIMENSION_KEY`` is its key).
    extra: further aggregates over states and dimension columns.
    first: aggregates over the rows; :func:`second_pass` where these hold states already.
    """
    at, by = at or {}, by or {}
    own = [expr.alias(name) for name, expr in at.items()]
    if dimension is None:
        return facts.groupBy(*own).agg(*first(states))
    per_key = facts.groupBy(F.col(key), *own).agg(*first(states))
    attributes = dimension.withColumnRenamed(key, DIMENSION_KEY)
    joined = per_key.join(attributes, per_key[key] == attributes[DIMENSION_KEY], "left")
    groups = [F.col(name) for name in at] + [expr.alias(name) for name, expr in by.items()]
    return joined.groupBy(*groups).agg(*second_pass(states), *(extra or []))


def totals(
    star: Star,
    states: list[str],
    scopes: tuple[str, ...] = (),
    at: dict[str, Column] | None = None,
    dimension: DataFrame | None = None,
    key: str | None = None,
    by: dict[str, Column] | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """As :func:`roll_up` over the star's shipments in the named scopes.

    The columns of ``at`` must follow from the month of ``order_date``.  Where the
    star has stored states by this key they are merged, else shipments are read.
    """
    rows = star.states.by(key) if star.states else None
    stored = rows is not None
    if not stored:
        rows = star.facts(*([key] if key else []))
    for scope in scopes:
        rows = (STATE_SCOPES if stored else SCOPES)[scope](rows)
    if not at and dimension is None:
        return rows.agg(*(whole_pass if stored else first_pass)(states))
    return roll_up(rows, states, at, dimension, key, by, extra, second_pass if stored else first_pass)
