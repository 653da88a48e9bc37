"""Shipments and one large dimension in the same buckets.

A dimension beyond broadcast size makes every flat report shuffle all shipments by
its key.  Stored in buckets of that key, both sides are joined bucket by bucket
without an exchange.  A key that more shipments share than fit one bucket (or that
many lack) would make one bucket long, so such keys are spread: shipments get a salt
next to the key, the dimension row is stored once for each salt, and both columns
make up the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanewise import schema
from lanewise.sources.star import MONTH, SALT, Star


def spread_keys(facts: DataFrame, key: str, buckets: int) -> dict[int | None, int]:
    """Keys that hold more than a bucket's share, each with its number of salts.

    There are fewer such keys than buckets, so the result is bounded.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * buckets / F.col("rows")
    many = counts.withColumn("rows", facts.agg(F.count(F.lit(1))).scalar()).where(share > 1)
    return {row[0]: row[1] for row in many.select(key, F.ceil(share).cast("int")).collect()}


def _salts(key: str, spread: dict[int | None, int]) -> Column:
    """The number of salts of a row's key."""
    number = F.lit(1)
    for value, salts in spread.items():
        same = F.col(key).isNull() if value is None else F.col(key) == value
        number = F.when(same, F.lit(salts)).otherwise(number)
    return number


def store(star: Star, dimension: str, path: str, buckets: int, database: str = "default") -> Star:
    """Store both tables in buckets, as tables of the catalogue; the star that reads them.

    Other dimensions stay as they are.  Each bucket of a month is one file.
    """
    key = schema.DIMENSION_KEYS[dimension]
    facts = star.facts(*schema.FOREIGN_KEYS)
    if MONTH not in facts.columns:
        facts = facts.withColumn(MONTH, F.trunc("order_date", "MM"))
    spread = spread_keys(facts, key, buckets)
    salted = facts.withColumn(SALT, F.pmod(F.xxhash64("shipment_key"), _salts(key, spread)).cast("int"))
    copies = star.dimension(dimension).withColumn(
        SALT, F.explode(F.sequence(F.lit(0), _salts(key, spread) - 1)))

    def write(df: DataFrame, name: str, month: list[str]) -> DataFrame:
        table = f"`{database}`.`{name}_by_{key}`"
        # the same hash deals rows to tasks and to buckets, so a task writes one bucket
        writer = df.repartition(buckets, key, SALT).write.mode("overwrite").option("path", f"{path}/{name}")
        if month:
            writer = writer.partitionBy(*month)
        writer.bucketBy(buckets, key, SALT).sortBy(key, SALT).saveAsTable(table)
        return df.sparkSession.table(table)

    stored = write(salted, "fact_shipments", [MONTH])
    held = write(copies, dimension, [])
    return star.replaced({dimension: held}, stored, dimension)
