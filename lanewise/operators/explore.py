"""Profiling of the raw tables: row counts, column profiles, value listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lanewise import schema
from lanewise.functions import distinct
from lanewise.functions.exprs import blank
from lanewise.sources.star import Star

# listing -> (table, columns)
LISTINGS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ex_supplier_countries": ("ref_suppliers", ("country",)),
    "ex_supplier_categories": ("ref_suppliers", ("category",)),
    "ex_supplier_tiers": ("ref_suppliers", ("contract_tier",)),
    "ex_supplier_breakdown": ("ref_suppliers", ("country", "category", "contract_tier")),
    "ex_supplier_statuses": ("ref_suppliers", ("status",)),
    "ex_carrier_modes": ("ref_carriers", ("transport_mode",)),
    "ex_carrier_regions": ("ref_carriers", ("coverage_region",)),
    "ex_carrier_breakdown": ("ref_carriers", ("transport_mode", "coverage_region")),
    "ex_route_regions": ("ref_routes", ("region",)),
    "ex_route_origins": ("ref_routes", ("origin",)),
    "ex_route_destinations": ("ref_routes", ("destination",)),
    "ex_warehouse_regions": ("ref_warehouses", ("region",)),
    "ex_warehouse_countries": ("ref_warehouses", ("country",)),
    "ex_product_categories": ("ref_products", ("category",)),
    "ex_product_fragilities": ("ref_products", ("fragility",)),
    "ex_product_breakdown": ("ref_products", ("category", "fragility")),
    "ex_shipment_statuses": ("fact_shipments", ("status",)),
}


def listing(star: Star, name: str, case_insensitive: bool = False) -> DataFrame:
    """Distinct values of one to three columns, sorted.

    ``case_insensitive`` merges spellings that differ in case or in trailing
    spaces and shows the first of them.
    """
    table, columns = LISTINGS[name]
    df = star.facts() if table == "fact_shipments" else star.dimension(table)
    if case_insensitive:
        folded = [F.lower(F.rtrim(c)).alias(f"_{c}") for c in columns]
        values = df.groupBy(*folded).agg(*[F.min(c).alias(c) for c in columns]).select(*columns)
    else:
        values = df.select(*columns).distinct()
    return values.orderBy(*columns)


def suppliers_missing_name(star: Star) -> DataFrame:
    columns = ["supplier_key", "supplier_id", "supplier_name"]
    return star.suppliers.where(blank("supplier_name")).select(*columns).distinct()


def shipments_missing_status(star: Star) -> DataFrame:
    columns = ["shipment_key", "shipment_id", "status"]
    return star.facts().where(blank("status")).select(*columns).distinct()


def missing_actual_date(star: Star) -> DataFrame:
    missing = star.facts().where(F.col("actual_date").isNull())
    return missing.agg(F.count(F.lit(1)).alias("shipments_missing_actual_date"))


def delay_not_calculated(star: Star) -> DataFrame:
    missing = star.facts().where(F.col("delay_days").isNull() & F.col("actual_date").isNotNull())
    return missing.agg(F.count(F.lit(1)).alias("delay_days_not_calculated"))


def row_counts(star: Star) -> DataFrame:
    def count(name: str) -> DataFrame:
        df = star.facts() if name == "fact_shipments" else star.dimension(name)
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")

    return reduce(DataFrame.unionByName, map(count, schema.TABLES)).orderBy("table_name")


TUPLES = 1 << 20  # distinct value combinations that columns counted together may have


def profile(star: Star, approximate: bool = False) -> DataFrame:
    """Per column: position, type, nullability, declared width and value counts.

    A first pass over each table counts missing values of all columns at once and
    sketches their distinct ones; it runs while the frame is built.  The exact
    distinct counts then take a scan for each column with very many values and one
    for each set of columns with few (:func:`_together`).  Whole numbers that repeat
    and lie close together are shuffled as bits (:func:`_as_bits`).
    """
    tables = {name: star.table(name) for name in schema.TABLES}
    if approximate:
        return reduce(DataFrame.unionByName, [
            _described(name, _sketched(df)) for name, df in tables.items()])
    looks = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.count_if(F.trim(F.col(c).cast("string")) == "").alias("n_blank"),
            F.approx_count_distinct(c).alias("about"),
            *[(end(c) if isinstance(df.schema[c].dataType, T.IntegralType) else F.lit(None))
              .cast("bigint").alias(at) for end, at in ((F.min, "least"), (F.max, "most"))])
        for c in df.columns]).alias("columns")) for name, df in tables.items()]
    seen = {row["name"]: row for row in reduce(DataFrame.unionByName, looks).collect()}
    return reduce(DataFrame.unionByName, [
        _described(name, _counted(df, seen[name]["n"], seen[name]["columns"]))
        for name, df in tables.items()])


def _described(name: str, counted: DataFrame) -> DataFrame:
    fields = list(schema.TABLES[name])

    def fact(values: list) -> Column:
        """A fact about the column, by its position."""
        texts = ", ".join("null" if v is None else repr(v) for v in values)
        return F.element_at(F.expr(f"array({texts})"), F.col("ordinal_position"))

    widths = [f.metadata.get("max_length") for f in fields]
    return counted.select(
        F.lit(name).alias("table_name"),
        "ordinal_position",
        fact([f.name for f in fields]).alias("column_name"),
        fact([f.dataType.simpleString() for f in fields]).alias("data_type"),
        F.lit("YES").alias("is_nullable"),
        fact(widths).cast("int").alias("character_maximum_length"),
        "n_null", "n_blank", "n_distinct",
    )


def _together(about: dict[str, int], rows: int) -> list[list[str]]:
    """Sets of columns whose combinations of values are few, told from sketched counts."""
    if rows <= TUPLES:
        return [list(about)]
    sets, combinations = [[]], 1
    for column, n in sorted(about.items(), key=lambda item: item[1]):
        if sets[-1] and combinations * max(n, 1) > TUPLES:
            sets.append([])
            combinations = 1
        sets[-1].append(column)
        combinations *= max(n, 1)
    return sets


def _as_bits(look, rows: int) -> bool:
    """Whether a column's values, whole numbers, repeat and lie close together."""
    if look["least"] is None:
        return False
    words = (look["most"] >> 6) - (look["least"] >> 6) + 1
    return words * 4 <= look["about"] and look["about"] * 8 <= rows


def _counted(df: DataFrame, rows: int, look: list) -> DataFrame:
    """Exact distinct counts next to the counts of the first pass.

    The columns of a set are grouped together on the map side; each of them is then
    counted from that shuffle, which Spark reuses, not from the table again.  A column
    on its own is shuffled as its values alone, or as bits.
    """
    at = {c: i for i, c in enumerate(df.columns)}
    parts = []

    def add(c: str, values: DataFrame, n: Column) -> None:
        parts.append(values.agg(
            F.lit(at[c] + 1).alias("ordinal_position"),
            F.lit(look[at[c]]["n_null"]).cast("bigint").alias("n_null"),
            F.lit(look[at[c]]["n_blank"]).cast("bigint").alias("n_blank"),
            n.alias("n_distinct")))

    for columns in _together({c: look[i]["about"] for c, i in at.items()}, rows):
        if len(columns) == 1:
            c = columns[0]
            if _as_bits(look[at[c]], rows):
                add(c, distinct.words(df, c), F.coalesce(F.sum(F.bit_count(distinct.BITS)), F.lit(0)))
            else:
                add(c, df.select(c).distinct(), F.count(c))
            continue
        met = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        for c in columns:
            # the count is looked at only to keep the shuffle one and the same
            values = met.groupBy(c).agg(F.sum("_n").alias("_n"))
            add(c, values, F.count(F.when(F.col("_n") > 0, F.col(c))))
    return reduce(DataFrame.unionByName, parts)


def _sketched(df: DataFrame) -> DataFrame:
    """Same columns with HyperLogLog distinct counts: one row per task shuffled."""
    figures = df.agg(*[
        F.struct(
            F.lit(i).alias("ordinal_position"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.count_if(F.trim(F.col(c).cast("string")) == "").alias("n_blank"),
            F.approx_count_distinct(c).alias("n_distinct"),
        ).alias(c)
        for i, c in enumerate(df.columns, 1)
    ])
    return figures.select(F.inline(F.array(*[F.col(c) for c in df.columns])))
