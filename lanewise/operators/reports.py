"""The two flat reports, their publication, and free grouping of the second."""

from __future__ import annotations

import hashlib
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanewise.functions import labels, measures as m
from lanewise.functions.measures import second_pass
from lanewise.functions.exprs import month_span, quotient, utilisation, whole_division
from lanewise.operators.scope import dated, ordered_between
from lanewise.plans import versions
from lanewise.plans.rollup import DIMENSION_KEY, roll_up, totals
from lanewise.sources.star import MONTH, MONTH_FIELD, SALT, Star, marks_of, months_of, write_by_month


def suppliers(star: Star, as_of: date | Column | None = None) -> DataFrame:
    """One row per supplier with shipments; recency counts up to ``as_of``."""
    today = F.current_date() if as_of is None else as_of
    if isinstance(today, date):
        today = F.lit(today)
    g = totals(
        star,
        ["shipments", "late", "on_time", "late_days", "cost", "costed", "first_order", "last_order"],
        ("dated",),
        dimension=star.suppliers, key="supplier_key",
        by={
            "supplier_key": F.col(DIMENSION_KEY),
            **{c: F.col(c) for c in
               ("supplier_id", "supplier_name", "country", "category", "contract_tier")},
            "supplier_rating": F.col("rating"),
            "onboarded_date": F.col("onboarded_date"),
        },
    ).withColumn("lifespan", month_span("first_order", "last_order"))
    monthly = F.when(F.col("lifespan") == 0, F.col("shipments")).otherwise(
        whole_division(F.col("shipments"), F.col("lifespan")))
    on_time_cost = F.round(quotient(F.col("cost"), F.col("on_time")), 0)
    return g.select(
        "supplier_key", "supplier_id", "supplier_name", "country", "category", "contract_tier",
        "supplier_rating", "onboarded_date",
        F.col("last_order").alias("last_shipment_date"),
        month_span("last_order", today).alias("recency_months"),
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("total_delayed"),
        F.col("on_time").alias("total_on_time"),
        m.total_cost().alias("total_cost"),
        m.average_cost().alias("avg_cost_per_shipment"),
        m.average_delay().alias("avg_delay_days_when_late"),
        "lifespan",
        m.on_time_rate().alias("on_time_rate_pct"),
        m.delay_rate().alias("delay_rate_pct"),
        monthly.alias("avg_monthly_shipments"),
        m.from_cents(on_time_cost).alias("cost_per_on_time_delivery"),
        labels.at_least(m.delay_rate(), labels.REPORT_SUPPLIER_TIERS).alias("performance_tier"),
        labels.relationship("lifespan", "shipments").alias("relationship_segment"),
        labels.lookup("contract_tier", labels.ACCOUNT_TYPES, labels.ACCOUNT_TYPE_OTHER)
        .alias("account_type"),
    )


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _from_dimensions() -> dict[str, tuple[str, dict[str, tuple[Column, object]]]]:
    """Per dimension: its key and its report columns.

    A column has a value, computed once per dimension row, and the default that
    a NULL value and a shipment without a matching row get.
    """
    used = utilisation(_zero("current_load"), "capacity")
    return {
        "ref_suppliers": ("supplier_key", {
            "supplier_key": (F.col("supplier_key"), None),
            "supplier_name": (F.col("supplier_name"), "Unknown Supplier"),
            "supplier_country": (F.col("country"), "Unknown"),
            "contract_tier": (F.col("contract_tier"), "Unknown"),
            "supplier_category": (F.col("category"), "Unknown"),
            "supplier_rating": (F.col("rating").cast("string"), "Unrated"),
        }),
        "ref_carriers": ("carrier_key", {
            "carrier_key": (F.col("carrier_key"), None),
            "carrier_name": (F.col("carrier_name"), "Unknown Carrier"),
            "transport_mode": (F.col("transport_mode"), "Unknown"),
            "avg_cost_per_km": (F.col("avg_cost_per_km"), 0),
        }),
        "ref_routes": ("route_key", {
            "route_key": (F.col("route_key"), None),
            "route_origin": (F.col("origin"), "Unknown"),
            "route_destination": (F.col("destination"), "Unknown"),
            "route_region": (F.col("region"), "Unknown"),
            "distance_km": (F.col("distance_km"), 0),
            "expected_transit_days": (F.col("avg_transit_days"), 0),
            "route_distance_band": (
                labels.band(_zero("distance_km"), labels.REPORT_DISTANCE_BANDS),
                labels.REPORT_DISTANCE_BANDS[0][2]),
        }),
        "ref_warehouses": ("warehouse_key", {
            "warehouse_key": (F.col("warehouse_key"), None),
            "warehouse_location": (F.col("location"), "Unknown"),
            "warehouse_region": (F.col("region"), "Unknown"),
            "warehouse_capacity": (F.col("capacity"), 0),
            "warehouse_load": (F.col("current_load"), 0),
            "warehouse_utilisation_pct": (used, None),
            "warehouse_status": (labels.at_least(used, labels.REPORT_WAREHOUSE_STATUS),
                                 labels.REPORT_WAREHOUSE_STATUS[-1][1]),
        }),
        "ref_products": ("product_key", {
            "product_key": (F.col("product_key"), None),
            "product_name": (F.col("product_name"), "Unknown Product"),
            "product_category": (F.col("category"), "Unknown"),
            "product_fragility": (F.col("fragility"), "Unknown"),
            "product_value_usd": (F.col("value_usd"), 0),
        }),
    }


def _from_shipment(strict_bands: bool) -> dict[str, Column]:
    delay = _zero("delay_days")
    cost = _zero("shipment_cost").cast("decimal(12,2)")
    return {
        "shipment_key": F.col("shipment_key"),
        "shipment_id": F.col("shipment_id"),
        "order_date": F.col("order_date"),
        "promised_date": F.col("promised_date"),
        "actual_date": F.col("actual_date"),
        "delay_days": delay,
        "shipment_status": F.coalesce(F.trim("status"), F.lit("Unknown")),
        "shipment_cost": cost,
        "weight_kg": _zero("weight_kg").cast("decimal(10,2)"),
        "quantity": _zero("quantity"),
        "actual_transit_days": F.date_diff("actual_date", "order_date"),
        "days_vs_promise": F.date_diff("actual_date", "promised_date"),
        "delayed_shipment_cost": F.when(delay > 0, cost).otherwise(F.lit(0)).cast("decimal(12,2)"),
        "delivery_flag": F.when(delay <= 0, F.lit("On Time")).otherwise(F.lit("Delayed")),
        "delay_severity": labels.at_most(delay, labels.DELAY_TIERS),
        "cost_band": labels.band(cost, labels.COST_BANDS, strict_bands),
    }


def _combined() -> dict[str, Column]:
    """Columns that need the shipment and its product."""
    late = F.col("delay_days") > 0
    risk = labels.lookup("product_fragility", labels.FRAGILITY_RISK, labels.FRAGILITY_RISK_OTHER)
    return {
        "product_value_at_risk": F.when(late, F.col("product_value_usd"))
        .otherwise(F.lit(0)).cast("decimal(12,2)"),
        "fragility_risk_flag": F.when(late, risk).otherwise(F.lit(labels.FRAGILITY_NO_RISK)),
    }


_NEEDS = {
    "product_value_at_risk": ["delay_days", "product_value_usd"],
    "fragility_risk_flag": ["delay_days", "product_fragility"],
}

SHIPMENT_REPORT = [
    "shipment_key", "shipment_id", "order_date", "promised_date", "actual_date",
    "delay_days", "shipment_status", "shipment_cost", "weight_kg", "quantity",
    "supplier_key", "supplier_name", "supplier_country", "contract_tier",
    "supplier_category", "supplier_rating",
    "carrier_key", "carrier_name", "transport_mode", "avg_cost_per_km",
    "route_key", "route_origin", "route_destination", "route_region", "distance_km",
    "expected_transit_days",
    "warehouse_key", "warehouse_location", "warehouse_region", "warehouse_capacity",
    "warehouse_load", "warehouse_utilisation_pct",
    "product_key", "product_name", "product_category", "product_fragility", "product_value_usd",
    "actual_transit_days", "days_vs_promise", "delayed_shipment_cost", "product_value_at_risk",
    "delivery_flag", "delay_severity", "cost_band", "warehouse_status", "route_distance_band",
    "fragility_risk_flag",
]


def shipments(star: Star, columns: list[str] | None = None, strict_bands: bool = False,
              period: tuple[date, date] | None = None) -> DataFrame:
    """One row per valid, dated shipment with its five dimensions and classes.

    ``period`` keeps the shipments ordered between two days.

    Only dimensions that contribute to ``columns`` are joined.  The joins carry
    no hints: small dimensions are broadcast by their size statistics, large
    ones are shuffled and AQE splits the partitions of frequent keys.  The largest
    stored dimensions come first and what follows from a shipment comes last, so
    that rows are narrow where they are shuffled.
    """
    return _flat(star, columns, strict_bands, period, sizes_of(star))


def _flat(star: Star, columns: list[str] | None, strict_bands: bool, period: tuple[date, date] | None,
          sizes: dict[str, int], dealt: str | None = None) -> DataFrame:
    """As :func:`shipments`.  With ``dealt``, a column of shipments that lie by it, the rows
    lie by it too and have it as their last column: dimensions too large to be broadcast
    are joined first and only then the rows are dealt anew.
    """
    wanted = list(columns or SHIPMENT_REPORT)
    missing = set(wanted) - set(SHIPMENT_REPORT)
    if missing:
        raise ValueError(f"not in the shipment report: {sorted(missing)}")
    base = set(wanted).union(*[_NEEDS.get(c, []) for c in wanted])
    own = {n: e for n, e in _from_shipment(strict_bands).items() if n in base}
    parts = {
        table: (key, {n: e for n, e in named.items() if n in base})
        for table, (key, named) in _from_dimensions().items()
    }
    used = {table: parts[table] for table in sorted(parts, key=lambda t: -sizes.get(t, 0)) if parts[table][1]}
    if star.salted in used:  # first, while the shipments lie in its buckets
        used = {star.salted: used.pop(star.salted), **used}
    keys = [key for key, _ in used.values()]

    facts = dated(star.facts(*keys))
    if period:
        facts = ordered_between(facts, *period)
    read = [c for c in _OWN if c in facts.columns]  # what no expression needs is pruned
    flat = facts.select(
        *[F.col(c).alias(f"_own_{c}") for c in read],
        *[F.col(k).alias(f"_{k}") for k in keys],
        *([F.col(SALT).alias("_salt")] if star.salted in used else []),
        *([dealt] if dealt else []),
    )
    large = {t: part for t, part in used.items() if sizes.get(t, SMALL + 1) > SMALL} if dealt else {}
    if large:
        flat = _joined(star, flat, large).hint("rebalance", dealt)
    flat = _joined(star, flat, {t: part for t, part in used.items() if t not in large}, broadcast=bool(dealt))
    kept = [c for c in flat.columns if not c.startswith("_own_")]
    flat = flat.select(*kept, *[F.col(f"_own_{c}").alias(c) for c in read]).select(
        *kept, *[expr.alias(n) for n, expr in own.items()])
    return _with_combined(flat, base).select(*wanted, *([dealt] if dealt else []))


# The shipment columns that :func:`_from_shipment` reads.
_OWN = ["shipment_key", "shipment_id", "order_date", "promised_date", "actual_date", "delay_days",
        "status", "shipment_cost", "weight_kg", "quantity"]

SMALL = 8 << 20  # bytes of a stored dimension that each executor can hold


def sizes_of(star: Star) -> dict[str, int]:
    """Bytes of the stored dimensions, listed by the driver; empty where the star is not stored."""
    if not star.root:
        return {}
    spark = star.suppliers.sparkSession
    return {t: sum(e.size for e in versions.listing(spark, versions.folder(spark, f"{star.root}/{t}")))
            for t in _from_dimensions()}


def _with_dimensions(star: Star, flat: DataFrame, used: dict, base: set[str]) -> DataFrame:
    """Rows with the foreign keys ``_<key>``, joined with the used dimensions' columns."""
    return _with_combined(_joined(star, flat, used), base)


def _joined(star: Star, flat: DataFrame, used: dict, broadcast: bool = False) -> DataFrame:
    for table, (key, named) in used.items():
        salt = table == star.salted and "_salt" in flat.columns
        rows = (star.copies(table) if salt else star.dimension(table)).select(
            F.col(key).alias("_match"), *([F.col(SALT).alias("_copy")] if salt else []),
            *[value.alias(n) for n, (value, _) in named.items()])
        if broadcast:  # its stored size was looked at
            rows = rows.hint("broadcast")
        same = F.col(f"f._{key}") == F.col("d._match")
        if salt:
            same = same & (F.col("f._salt") == F.col("d._copy"))
        defaults = {
            n: F.coalesce(F.col(f"d.{n}"), F.lit(default).cast(rows.schema[n].dataType))
            if default is not None else F.col(f"d.{n}")
            for n, (_, default) in named.items()
        }
        flat = (
            flat.alias("f").join(rows.alias("d"), same, "left")
            .select("f.*", *[expr.alias(n) for n, expr in defaults.items()])
            .drop(f"_{key}", "_salt")
        )
    return flat


def _with_combined(flat: DataFrame, base: set[str]) -> DataFrame:
    """With the columns that need the shipment and its product."""
    for name, expr in _combined().items():
        if name in base:
            flat = flat.withColumn(name, expr)
    return flat


def publish(star: Star, as_of: date | None = None, root: str | None = None,
            database: str | None = None) -> dict[str, list[str]]:
    """Register both reports as views of this session.

    With ``root`` they are stored first, the shipments by order month in even
    files.  Of a stored star only what has changed is written: the months whose
    shipment files are not those they were made from, all months when a dimension
    has changed, the suppliers when either has or ``as_of`` is another day.  Views
    made before keep giving the version they were made for.  Gives the parts written.

    With ``database`` too, the stored reports get views by name in that database of
    the catalogue, where other sessions find them; the one of the shipments also
    shows ``order_month``, by which a filter reads its months only.
    """
    made = {"report_suppliers": suppliers(star, as_of), "report_shipments": shipments(star)}
    written: dict[str, list[str]] = {}
    for name, df in made.items():
        spark = df.sparkSession
        if root:
            written[name] = _store(spark, star, name, df, f"{root}/{name}", as_of)
            if name == "report_shipments":
                text = versions.as_sql(spark, f"{root}/{name}", [*df.columns, MONTH])
                df = versions.read(spark, f"{root}/{name}", df.schema, MONTH_FIELD).select(*df.columns)
            else:
                path = versions.folder(spark, f"{root}/{name}")
                text = f"select * from parquet.`{path}`"
                df = spark.read.schema(df.schema).parquet(path)
            if database:
                spark.sql(f"create or replace view `{database}`.`{name}` as {text}")
        df.createOrReplaceTempView(name)
    return written


def _store(spark: SparkSession, star: Star, name: str, df: DataFrame, path: str, as_of: date | None) -> list[str]:
    """Write what the stored report lacks; all of it where nothing tells what has changed."""
    unknown = uuid.uuid4().hex  # equal to no earlier mark
    dimensions = marks_of(spark, star.root, list(_from_dimensions())) if star.root else unknown
    months = months_of(spark, star.root) if star.root else {}
    if name == "report_suppliers":
        marks = f"{dimensions} {sorted(months.items())} {as_of or date.today()}"
        covers = hashlib.sha256(marks.encode()).hexdigest()
        return [versions.ROWS] * versions.refresh_whole(spark, path, covers, lambda: df)
    if star.root:
        sizes = sizes_of(star)

        def of(parts: list[str]) -> DataFrame:
            own = star.transformed({"fact_shipments": lambda facts: versions.of_months(facts, MONTH, parts)})
            return _flat(own, None, False, None, sizes, dealt=MONTH)

        dated_months = {part: mark for part, mark in months.items() if not part.endswith("__")}
        return versions.refresh(spark, path, dated_months, MONTH, of, dimensions, dealt=True)
    run = versions.new_run()
    write_by_month(df, f"{path}/{run}")
    parts = [e.name for e in versions.children(spark, f"{path}/{run}") if "=" in e.name]
    versions.commit(spark, path, versions.current(spark, path), {p: f"{run}/{p}" for p in parts})
    return parts


def drill(star: Star, by: list[str], where: dict[str, object] | None = None,
          period: tuple[date, date] | None = None) -> DataFrame:
    """Group the shipment report by any of its columns, after optional filters.

    ``where`` maps report columns to a value or a list of values to keep.
    Shipments are aggregated by their own columns and the foreign keys of the
    dimensions that are used; those rows are joined, filtered and merged.
    """
    kept = {c: v if isinstance(v, (list, tuple, set)) else [v] for c, v in (where or {}).items()}
    named = {*by, *kept}
    if missing := named - set(SHIPMENT_REPORT):
        raise ValueError(f"not in the shipment report: {sorted(missing)}")
    base = named.union(*[_NEEDS.get(c, []) for c in named])
    parts = {
        table: (key, {n: e for n, e in columns.items() if n in base})
        for table, (key, columns) in _from_dimensions().items()
    }
    used = {table: part for table, part in parts.items() if part[1]}
    keys = [key for key, _ in used.values()]
    facts = dated(star.facts(*keys))
    if period:
        facts = ordered_between(facts, *period)
    own = {n: e for n, e in _from_shipment(False).items() if n in base}
    for column in [c for c in kept if c in own]:  # on shipment columns: before anything else
        facts = facts.where(own[column].isin(*kept.pop(column)))
    states = ["shipments", "late", "cost", "late_cost"]
    summed = roll_up(facts, states, at={**own, **{f"_{k}": F.col(k) for k in keys}})
    flat = _with_dimensions(star, summed, used, base)
    for column, values in kept.items():
        flat = flat.where(F.col(column).isin(*values))
    g = flat.groupBy(*by).agg(*second_pass(states))
    return g.select(
        *by,
        F.col("shipments").alias("total_shipments"),
        F.col("late").alias("delayed_shipments"),
        m.delay_rate().alias("delay_rate_pct"),
        m.total_cost().alias("total_cost"),
        m.late_cost().alias("cost_of_delayed_shipments"),
    ).orderBy(*by)
