"""Row scopes shared by the analyses."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from lanewise.functions.labels import DATA_ERROR
from lanewise.sources.star import MONTH


def valid(facts: DataFrame) -> DataFrame:
    """Shipments not flagged as data errors; a NULL status is left out too."""
    return facts.where(F.col("status") != DATA_ERROR)


def dated(facts: DataFrame) -> DataFrame:
    return valid(facts).where(F.col("order_date").isNotNull())


def costed(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("shipment_cost").isNotNull())


# by name, over shipments and over stored states
SCOPES = {"valid": valid, "dated": dated, "costed": costed}
STATE_SCOPES = {
    "valid": lambda rows: rows.where(F.col("is_valid")),
    "dated": lambda rows: rows.where(F.col("is_valid") & F.col("order_date").isNotNull()),
    "costed": lambda rows: rows.where(F.col("is_costed")),
}


def ordered_between(facts: DataFrame, first: date, last: date) -> DataFrame:
    """Shipments ordered in a period, both days included.

    On stored shipments only the partitions of the months touched are read.
    """
    kept = facts.where(F.col("order_date").between(F.lit(first), F.lit(last)))
    if MONTH in facts.columns:
        kept = kept.where(F.col(MONTH).between(F.lit(first.replace(day=1)), F.lit(last)))
    return kept
