"""Measure states of the stored shipments by month and key, kept beside them.

For a foreign key (or none) the states of all measures are stored for each month,
scope and key, and the keys in use as bitmaps for each month and scope.  Analyses
by month, quarter or year and by one dimension merge these rows instead of reading
shipments.  The tables know which shipment files each month was made from: they
are read when those are the present ones, and months whose files have changed are
made anew before, those alone.

States by a key that hardly repeats within a month would be about as long as the
shipments.  They are not stored, as the keys' bitmaps tell beforehand, and such
analyses go on reading shipments.  Results are the same either way.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lanewise import schema
from lanewise.functions import distinct
from lanewise.functions.labels import DATA_ERROR
from lanewise.functions.measures import first_pass, names_and_types
from lanewise.plans import versions
from lanewise.sources.star import MONTH, MONTH_FIELD, Star, months_of

# scope of a state row, as scope.py keeps shipments
VALID, COSTED = "is_valid", "is_costed"
SHRINK = 3  # shipments a state row stands for, at least

_NO_KEY = "none"
_USED = "used_keys"


def _scopes() -> dict:
    return {VALID: F.coalesce(F.col("status") != DATA_ERROR, F.lit(False)),
            COSTED: F.col("shipment_cost").isNotNull()}


def worth_storing(states: DataFrame, used: DataFrame) -> list[str]:
    """The keys by which states are short, told from the tables without and of keys."""
    rows = states.agg(F.sum("fact_rows")).first()[0] or 0
    pairs = used.groupBy(distinct.KEY).agg(F.sum(F.bitmap_count(distinct.BITS))).collect()
    return sorted(key for key, n in pairs if n * SHRINK <= rows)


def _layout(key: str | None) -> T.StructType:
    named = [T.StructField(key, T.LongType())] if key else []
    scopes = [T.StructField(c, T.BooleanType()) for c in (VALID, COSTED)]
    return T.StructType([*named, *scopes, *[T.StructField(n, t) for n, t in names_and_types()]])


_USED_LAYOUT = T.StructType([
    T.StructField(VALID, T.BooleanType()), T.StructField(distinct.KEY, T.StringType()),
    T.StructField(distinct.BUCKET, T.LongType()), T.StructField(distinct.BITS, T.BinaryType())])


def states_of(facts: DataFrame, key: str | None) -> DataFrame:
    """All states by month, scope and key of shipments that are stored by month."""
    scopes = [c.alias(n) for n, c in _scopes().items()]
    layout = _layout(key)
    made = facts.groupBy(MONTH, *([key] if key else []), *scopes).agg(*first_pass([n for n, _ in names_and_types()]))
    return made.select(*layout.fieldNames(), MONTH)


def used_keys(facts: DataFrame) -> DataFrame:
    """Bitmaps of the keys in use by month and validity."""
    by = {MONTH: F.col(MONTH), VALID: _scopes()[VALID]}
    return distinct.bitmaps(facts, list(schema.FOREIGN_KEYS), by).select(*_USED_LAYOUT.fieldNames(), MONTH)


class States:
    """The stored states of one shipment table."""

    def __init__(self, spark: SparkSession, root: str, by: list[str]):
        self._rows = {k: versions.read(spark, f"{root}/{k or _NO_KEY}", _layout(k), MONTH_FIELD)
                      for k in (None, *by)}
        self._used = versions.read(spark, f"{root}/{_USED}", _USED_LAYOUT, MONTH_FIELD)

    def by(self, key: str | None) -> DataFrame | None:
        """States by key; ``order_date`` is the first day of the month.  None: not stored."""
        rows = self._rows.get(key)
        return rows if rows is None else rows.withColumnRenamed(MONTH, "order_date")

    def used(self) -> DataFrame:
        return self._used.where(F.col(VALID))


def refresh(spark: SparkSession, star: Star, root: str,
            by: list[str] | None = None) -> tuple[States, dict[str, list[str]]]:
    """Bring the states below ``root`` up to the shipments of a stored star.

    Gives them and, for each table, the months that were made anew.  Without
    ``by`` the keys of the earlier tables are kept, or chosen if there are none.
    """
    held, facts = months_of(spark, star.root), star.facts(*schema.FOREIGN_KEYS)

    def build(name: str):
        def rows(parts: list[str]) -> DataFrame:
            kept = versions.of_months(facts, MONTH, parts)
            return used_keys(kept) if name == _USED else states_of(kept, None if name == _NO_KEY else name)

        return versions.refresh(spark, f"{root}/{name}", held, MONTH, rows, split=False)

    def all_of(names: list[str]) -> dict[str, list[str]]:
        with ThreadPoolExecutor(max(len(names), 1)) as pool:  # the tables are independent
            return dict(zip(names, pool.map(build, names)))

    if by is None:
        by = [e.name for e in versions.children(spark, root) if e.name in schema.FOREIGN_KEYS]
    made = all_of([_NO_KEY, _USED, *by])
    if not by:
        first = States(spark, root, [])
        by = worth_storing(first.by(None), first.used())
        made |= all_of(by)
    return States(spark, root, by), made
