"""Exact distinct counts of whole-number keys that can be merged.

The keys of a group become bitmaps: one row for each run of 32,768 neighbouring
key values that occurs, with a bit for each value.  Bitmaps of several groups (of
months, say) are united bit by bit, so a count over any of them needs neither the
rows again nor a copy of each row for every counted key.  A run takes 4 KB in
memory however few of its values occur; stored and sent it is compressed, so keys
that lie far apart cost some tens of bytes each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KEY, BUCKET, BITS = "key_name", "key_bucket", "key_bits"


def bitmaps(rows: DataFrame, keys: list[str], by: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group, key column and run of values that occurs in the group.

    The keys of a task meet before the shuffle as 64-bit words, one row for up to 64
    neighbouring values, whatever their number.
    """
    by = by or {}

    def of(key: str) -> DataFrame:
        value = F.col(key).cast("bigint")
        words = (
            rows.where(value.isNotNull())
            .select(*[c.alias(n) for n, c in by.items()], F.bitmap_bucket_number(value).alias(BUCKET),
                    F.bitmap_bit_position(value).alias("_at"))
            .groupBy(*by, BUCKET, F.shiftright("_at", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
        )
        met = (
            words.withColumn("_place", F.explode(F.expr("sequence(0, 63)")))
            .where(F.getbit("_bits", F.col("_place")) == 1)
            .withColumn("_bit", F.col("_word") * 64 + F.col("_place"))
        )
        return met.groupBy(*by, F.lit(key).alias(KEY), BUCKET).agg(F.bitmap_construct_agg("_bit").alias(BITS))

    return reduce(DataFrame.unionByName, map(of, keys))


def words(rows: DataFrame, key: str) -> DataFrame:
    """One row for each 64 neighbouring values of which some occur, with a bit for each value.

    Shorter than the values where these repeat and lie close together.
    """
    value = F.col(key).cast("bigint")
    bit = F.expr("shiftleft(1L, cast(_value & 63 as int))")
    return (
        rows.where(value.isNotNull()).select(value.alias("_value"))
        .groupBy(F.shiftright("_value", 6).alias("_word")).agg(F.bit_or(bit).alias(BITS))
    )


def merged(maps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The bitmaps of all rows that agree in ``by``, the key column and the run."""
    return maps.groupBy(*(by or []), KEY, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def counts(maps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, key_name, n): distinct values, bitmaps of one group merged before."""
    return merged(maps, by).groupBy(*(by or []), KEY).agg(F.sum(F.bitmap_count(BITS)).alias("n"))


def wide_counts(maps: DataFrame, keys: list[str]) -> DataFrame:
    """One row with a column for each key; 0 where none occurs."""
    found = counts(maps)
    return found.agg(*[
        F.coalesce(F.sum(F.when(F.col(KEY) == k, F.col("n"))), F.lit(0)).alias(k) for k in keys])
