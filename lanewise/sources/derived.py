"""A star derived from order-line tables, with deterministic dirt.

Used where no shipment files are at hand: region, nation, customer, supplier,
part, orders and lineitem give all six tables.  A shipment is an order line, so
the shipment table has exactly the rows of lineitem.  Order, customer and
supplier keys are unique in these tables; the joins that fetch the lane and the
warehouse of a line are therefore left joins that neither drop nor repeat
lines, and they are only built when one of these two keys is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanewise.schema import FOREIGN_KEYS
from lanewise.sources.star import MONTH, Star

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# A lane is numbered origin * 2^32 + destination: nation keys are 32-bit numbers.
_LANE = "shiftleft(cast(s_nationkey as bigint), 32) + c_nationkey"

# A third of the shipments goes with one carrier, one in 31 of the others with a
# carrier nobody knows, the rest over all customer keys.
_HOT_CARRIER = 7
_CARRIER = f"""case when h % 3 = 0 then {_HOT_CARRIER}
    when u % 31 = 0 then -1 - u % customers else 1 + u % customers end"""


def derived_star(spark: SparkSession, root: str) -> Star:
    def source(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    return Star(
        {
            "ref_suppliers": lambda: _suppliers(source),
            "ref_carriers": lambda: _carriers(source),
            "ref_routes": lambda: _routes(source, _shipments(source, ("route_key",))),
            "ref_warehouses": lambda: _warehouses(source),
            "ref_products": lambda: _products(source),
        },
        lambda keys: _shipments(source, keys),
        late={"ref_routes": lambda facts: _routes(source, facts)},
        by_month=lambda: _shipments(source, FOREIGN_KEYS, dealt=True),
    )


def _suppliers(source) -> DataFrame:
    s, n = source("supplier"), source("nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").selectExpr(
        "s_suppkey as supplier_key",
        "concat('SUP-', s_suppkey) as supplier_id",
        "case when s_suppkey % 31 = 7 then null when s_suppkey % 37 = 9 then ' ' else s_name end"
        " as supplier_name",
        "case when s_suppkey % 23 = 5 then null when s_suppkey % 29 = 6 then ' '"
        " when s_suppkey % 7 = 3 then lower(n_name) else n_name end as country",
        "case when s_suppkey % 19 = 8 then null else concat('CAT-', s_suppkey % 10) end as category",
        "case s_suppkey % 5 when 0 then 'Bronze' when 1 then 'Silver' when 2 then 'Gold'"
        " when 3 then 'Platinum' else '' end as contract_tier",
        "case when s_suppkey % 13 = 4 then null"
        " else cast((s_suppkey * 7 % 36 + 15) * 0.1 as decimal(3,1)) end as rating",
        "case when s_suppkey % 41 = 9 then null"
        " else date_add(date'2012-01-01', cast(s_suppkey * 37 % 4000 as int)) end as onboarded_date",
        "case when s_suppkey % 17 = 2 then ' ' when s_suppkey % 9 = 0 then 'Inactive'"
        " when s_suppkey % 10 = 1 then 'Suspended' else 'Active' end as status",
    )


def _carriers(source) -> DataFrame:
    c, n, r = source("customer"), source("nation"), source("region")
    return (
        c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
        .join(r, n["n_regionkey"] == r["r_regionkey"], "left")
        .selectExpr(
            "c_custkey as carrier_key",
            "concat('CAR-', c_custkey) as carrier_id",
            "case when c_custkey % 15 = 4 then null else c_name end as carrier_name",
            "case when c_custkey % 17 = 2 then ' ' when c_custkey % 5 = 1 then lower(c_mktsegment)"
            " else c_mktsegment end as transport_mode",
            "case when c_custkey % 11 = 3 then null"
            " else cast((5000 + c_custkey * 79 % 4800) * 0.01 as decimal(5,2)) end as on_time_rate",
            "case when c_custkey % 12 = 5 then null"
            " else cast((4000 + c_custkey * 1531 % 86000) * 0.0001 as decimal(8,4)) end"
            " as avg_cost_per_km",
            "case when c_custkey % 30 = 7 then ' ' else r_name end as coverage_region",
            "case when c_custkey % 13 = 1 then null when c_custkey % 6 = 0 then 'Inactive'"
            " else 'Active' end as status",
        )
    )


# What the dirt of a line hangs on.
_MIX = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 3) % 1000"


def _lines(source) -> DataFrame:
    """Order lines, as narrow as shipments can be made from."""
    return source("lineitem").withColumn("h", F.expr(_MIX)).selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "cast(l_shipdate as date) as d0",
        "case when h % 33 = 20 then null else cast(cast(cast(round(l_extendedprice * 100) as bigint)"
        " % 1500000 as decimal(12,0)) * 0.01 as decimal(12,2)) end as shipment_cost",
        "case when h % 60 = 31 then null else cast(l_quantity as int) end as quantity",
    )


def _lanes(source) -> DataFrame:
    """Order lines with the nation keys of their supplier and of their customer."""
    orders, customer = source("orders"), source("customer")
    buyers = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    supplier = source("supplier").select("s_suppkey", "s_nationkey")
    return (
        _lines(source)
        .join(buyers.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )


def _routes(source, shipments: DataFrame) -> DataFrame:
    """The lanes that shipments have: their distinct keys, taken apart."""
    nation, region = source("nation"), source("region")
    used = shipments.select(F.col("route_key").alias("k")).distinct().selectExpr(
        "k", "shiftright(k, 32) as s_nationkey", "k & 4294967295 as c_nationkey")
    start = nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("from_name"))
    end = nation.select(F.col("n_nationkey").alias("to_nation"), F.col("n_name").alias("to_name"))
    return (
        used.join(start, used["s_nationkey"] == start["n_nationkey"])
        .join(end, used["c_nationkey"] == end["to_nation"])
        .join(region, start["n_regionkey"] == region["r_regionkey"], "left")
        .selectExpr(
            "k as route_key",
            "concat('RTE-', k) as route_id",
            "case when k % 29 = 4 then null else from_name end as origin",
            "case when k % 31 = 5 then ' ' else to_name end as destination",
            "case when k % 37 = 6 then null else r_name end as region",
            "case when k % 19 = 3 then null else cast(300 + k * 97 % 13500 as int) end as distance_km",
            "case when k % 23 = 2 then null else cast(1 + k % 22 as smallint) end as avg_transit_days",
        )
    )


def _warehouses(source) -> DataFrame:
    n, r = source("nation"), source("region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").selectExpr(
        "cast(n_nationkey as bigint) as warehouse_key",
        "concat('WH-', n_nationkey) as warehouse_id",
        "case when n_nationkey % 20 = 17 then null else concat(n_name, ' DEPOT') end as location",
        "n_name as country",
        "case when n_nationkey = 3 then ' ' else r_name end as region",
        "case when n_nationkey % 13 = 9 then null else 10000 + n_nationkey * 2791 end as capacity",
        "case when n_nationkey = 20 then null else"
        " cast((10000 + n_nationkey * 2791) * (40 + n_nationkey * 7 % 66) div 100 as int) end"
        " as current_load",
        "cast((3 + n_nationkey * 11 % 52) * 0.1 as decimal(4,1)) as processing_time_avg",
    )


def _products(source) -> DataFrame:
    return source("part").selectExpr(
        "p_partkey as product_key",
        "concat('PRD-', p_partkey) as product_id",
        "case when p_partkey % 27 = 1 then null when p_partkey % 28 = 2 then ' ' else p_name end"
        " as product_name",
        "case when p_partkey % 25 = 3 then ' ' else p_type end as category",
        "case when p_partkey % 23 = 4 then null"
        " else cast((100 + p_partkey * 7919 % 350000) * 0.01 as decimal(10,2)) end as weight_kg",
        "case when p_partkey % 18 = 5 then null when p_size <= 15 then 'Low'"
        " when p_size <= 35 then 'Medium' else 'High' end as fragility",
        "case when p_partkey % 11 = 6 then null else cast(p_retailprice as decimal(12,2)) end"
        " as value_usd",
    )


def _shipments(source, keys: tuple[str, ...], dealt: bool = False) -> DataFrame:
    """Shipments with the named keys; ``dealt`` to tasks by order month, while rows are narrow."""
    lines, extra = _lines(source), []
    if "route_key" in keys:
        lines = _lanes(source)
        extra.append(f"{_LANE} as route_key")
    elif "warehouse_key" in keys:
        orders, customer = source("orders"), source("customer")
        buyers = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
        lines = lines.join(buyers.select("o_orderkey", "c_nationkey"),
                           F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "warehouse_key" in keys:
        extra.append("cast(c_nationkey as bigint) as warehouse_key")
    if dealt:
        of = F.expr(f"case when {_MIX} = 499 then null else trunc(d0, 'MM') end")
        own = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "d0", "shipment_cost", "quantity"]
        found = [c for c in ("s_nationkey", "c_nationkey") if c in lines.columns]
        lines = lines.select(*own, *found, of.alias(MONTH)).hint("rebalance", MONTH)
    if "carrier_key" in keys:
        customers = source("customer").agg(F.max("c_custkey")).scalar()
        lines = lines.withColumn("customers", customers)
        extra.append(f"{_CARRIER} as carrier_key")
    base = lines.selectExpr(
        "*",
        f"{_MIX} as h",
        "l_orderkey * 7 + l_partkey * 13 + l_linenumber as u",
    ).selectExpr(
        "*",
        "cast(3 + h % 18 as int) as win",
        "cast(case when h < 290 then 1 + h % 25 else -(h % 4) end as int) as dl",
    )
    return base.selectExpr(
        "l_orderkey * 10 + l_linenumber as shipment_key",
        "concat('SHP-', l_orderkey, '-', l_linenumber) as shipment_id",
        "l_suppkey as supplier_key",
        "l_partkey as product_key",
        *extra,
        "case when h = 499 then null else d0 end as order_date",
        "date_add(d0, win) as promised_date",
        "case when h % 25 = 24 then null when h % 200 = 7 then date_add(d0, -2)"
        " else date_add(d0, win + dl) end as actual_date",
        "case when h % 50 = 11 then null when h % 40 = 13 then ' ' when h < 290 then 'Delayed'"
        " else 'Delivered' end as status",
        "case when h % 25 = 24 or h % 30 = 17 then null else dl end as delay_days",
        "shipment_cost",
        "case when h % 45 = 21 then null"
        " else cast(cast(100 + l_partkey * 7919 % 350000 as decimal(10,0)) * 0.01 as decimal(10,2))"
        " end as weight_kg",
        "quantity",
    )
