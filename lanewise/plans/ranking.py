"""Ranks over a whole result without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.functions.exprs import whole_division
from lanewise.plans.frozen import freeze

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def keep_rank(df: DataFrame, value: Column, limit: int, name: str) -> DataFrame:
    """Rows whose RANK by descending value is at most ``limit``, ties included.

    A row's rank is one more than the number of larger values.  If that rank is
    within the limit, all larger values are among the ``limit`` largest rows, so
    those few rows decide it.  They come from a distributed top-k and reach the
    rows as a scalar subquery; any number of ties stays distributed.  The whole
    rows are kept in the subquery so that its plan equals the outer one and
    Spark reuses the aggregation shuffle instead of reading the table again.
    Every row looks at the ``limit`` values: meant for short lists, see
    :func:`rank_all` for deep ones.
    """
    ranked = df.withColumn("_value", F.coalesce(value, F.lit(-1)))
    top = (
        ranked.orderBy(F.desc("_value")).limit(limit)
        .agg(F.collect_list(F.struct(*ranked.columns)).alias("rows"))
    )
    larger = F.filter("_top", lambda row: row["_value"] > F.col("_value"))
    return (
        ranked.withColumn("_top", top.scalar())
        .withColumn(name, F.size(larger) + 1)
        .where(F.col(name) <= limit)
        .drop("_value", "_top")
    )


def _sorted_once(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in sorted partitions, written down with their place.

    Partition and row number are then the same for every later reader, also
    after an executor is lost.
    """
    return freeze(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))


def _positions(laid: DataFrame, name: str) -> DataFrame:
    """1-based row numbers; only one count per partition is brought together."""
    rows = laid.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        "_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row per sort partition, at most spark.sql.shuffle.partitions: safe to broadcast
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within + 1)
        .drop("_at", "_part", "_start")
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Row numbers in a total order over the whole result.

    Sorting and a reliable checkpoint run at once, while the frame is built.
    """
    return _positions(_sorted_once(df, order), name)


# --- positions without writing anything down ----------------------------------

SAMPLED = 20  # rows looked at for each range


def falling(value: Column | str) -> list[Column]:
    """Sort keys that put large values first and NULL last."""
    value = F.col(value) if isinstance(value, str) else value
    return [value.isNull(), -value]


def _all_of(df: DataFrame) -> Column:
    """1, told from all columns: every use of the rows then has the same plan below
    it, so Spark computes their shuffle once and reuses it."""
    return F.lit(1) + F.pmod(F.xxhash64(*df.columns), F.lit(1))


def _ranges(df: DataFrame, key: Column) -> tuple[Column, Column]:
    """The number of the key range a row belongs to, in the order of the key, and the bounds.

    The range bounds are taken from a bounded sample, the rows with the smallest
    hashes, and reach the rows as a scalar subquery; the sample decides how even
    the ranges are, not what any row's position is.
    """
    count = max(1, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # whole rows, not just keys: the plan below is the one of the other uses
    seen = df.orderBy(F.xxhash64(*df.columns)).limit(count * SAMPLED).agg(
        F.collect_list(F.struct(*df.columns, key.alias("_key"))).alias("rows"))
    keys = F.sort_array(F.transform("rows", lambda row: row["_key"]))
    bounds = seen.select(F.filter(keys, lambda _, i: i % SAMPLED == SAMPLED - 1)).scalar()
    return F.size(F.filter("_bounds", lambda bound: bound <= F.col("_key"))), bounds


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based row numbers in the total order of ``order`` (ascending, NULL first).

    Rows are dealt into key ranges, numbered within each range, and moved up by the
    sizes of the ranges before.  Only those sizes are brought together.  Nothing
    runs before the result is used.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    number, bounds = _ranges(df, key)
    laid = (
        df.withColumns({"_weight": _all_of(df), "_key": key, "_bounds": bounds})
        .withColumn("_range", number).drop("_bounds"))
    sizes = laid.groupBy("_range").agg(F.sum("_weight").alias("_size"))
    starts = sizes.select(
        F.col("_range").alias("_of"),
        (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    # one row per range, at most 1000: safe to broadcast
    return (
        laid.withColumn("_within", within).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
        .withColumn(name, F.col("_start") + F.col("_within"))
        .select(*df.columns, name)
    )


def rank_all(df: DataFrame, value: Column, ties: list[str], name: str) -> DataFrame:
    """RANK by descending value for every row.  ``ties`` make the order total."""
    valued = df.withColumn("_value", value)
    narrow = valued.select("_value", *ties, _all_of(valued).alias("_one"))
    laid = positions(narrow, [*falling("_value"), *map(F.col, ties)], "_position")
    # The first position of a value is the rank of all its rows.  A value that
    # many rows share makes a skewed join side, which AQE splits.
    place = F.col("_position") + F.col("_one") - 1
    firsts = laid.groupBy(F.col("_value").alias("_first")).agg(F.min(place).alias(name))
    return (
        valued.join(firsts, valued["_value"].eqNullSafe(firsts["_first"]))
        .drop("_value", "_first")
    )


def tiles(df: DataFrame, order: list[Column], count: int, name: str) -> DataFrame:
    """NTILE over the whole result: tile sizes differ by one, larger ones first.

    ``order`` is total and ascending; see :func:`falling`.
    """
    rows = positions(df, order, "_position")
    total = df.agg(F.sum(_all_of(df))).scalar()
    size = whole_division(F.col("_total"), F.lit(count))
    larger = F.col("_total") % count
    before = F.col("_position") - 1
    inside = whole_division(before, size + 1)
    after = whole_division(before - larger * (size + 1), size) + larger
    return (
        rows.withColumn("_total", total)
        .withColumn(name, (F.when(before < larger * (size + 1), inside).otherwise(after) + 1).cast("int"))
        .drop("_position", "_total")
    )
