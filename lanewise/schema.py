"""Column layout of the six tables.

Keys are BIGINT so that they keep growing with the data.  The declared text
width and range are kept as field metadata; the profile lists the widths, and
the text load checks both where asked to.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _text(name: str, width: int) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"max_length": width})


def _typed(name: str, kind: T.DataType, span: tuple[int, int] | None = None) -> T.StructField:
    return T.StructField(name, kind, True, {"range": list(span)} if span else None)


def _key(name: str) -> T.StructField:
    return _typed(name, T.LongType())


REF_SUPPLIERS = T.StructType([
    _key("supplier_key"),
    _text("supplier_id", 50),
    _text("supplier_name", 100),
    _text("country", 50),
    _text("category", 50),
    _text("contract_tier", 20),
    _typed("rating", T.DecimalType(3, 1)),
    _typed("onboarded_date", T.DateType()),
    _text("status", 20),
])

REF_CARRIERS = T.StructType([
    _key("carrier_key"),
    _text("carrier_id", 50),
    _text("carrier_name", 100),
    _text("transport_mode", 20),
    _typed("on_time_rate", T.DecimalType(5, 2)),
    _typed("avg_cost_per_km", T.DecimalType(8, 4)),
    _text("coverage_region", 50),
    _text("status", 20),
])

REF_ROUTES = T.StructType([
    _key("route_key"),
    _text("route_id", 50),
    _text("origin", 100),
    _text("destination", 100),
    _text("region", 50),
    _typed("distance_km", T.IntegerType()),
    _typed("avg_transit_days", T.ShortType(), (0, 255)),
])

REF_WAREHOUSES = T.StructType([
    _key("warehouse_key"),
    _text("warehouse_id", 50),
    _text("location", 100),
    _text("country", 50),
    _text("region", 50),
    _typed("capacity", T.IntegerType()),
    _typed("current_load", T.IntegerType()),
    _typed("processing_time_avg", T.DecimalType(4, 1)),
])

REF_PRODUCTS = T.StructType([
    _key("product_key"),
    _text("product_id", 50),
    _text("product_name", 100),
    _text("category", 50),
    _typed("weight_kg", T.DecimalType(10, 2)),
    _text("fragility", 20),
    _typed("value_usd", T.DecimalType(12, 2)),
])

FACT_SHIPMENTS = T.StructType([
    _key("shipment_key"),
    _text("shipment_id", 50),
    _key("supplier_key"),
    _key("carrier_key"),
    _key("route_key"),
    _key("warehouse_key"),
    _key("product_key"),
    _typed("order_date", T.DateType()),
    _typed("promised_date", T.DateType()),
    _typed("actual_date", T.DateType()),
    _text("status", 20),
    _typed("delay_days", T.IntegerType()),
    _typed("shipment_cost", T.DecimalType(12, 2)),
    _typed("weight_kg", T.DecimalType(10, 2)),
    _typed("quantity", T.IntegerType()),
])

TABLES: dict[str, T.StructType] = {
    "ref_suppliers": REF_SUPPLIERS,
    "ref_carriers": REF_CARRIERS,
    "ref_routes": REF_ROUTES,
    "ref_warehouses": REF_WAREHOUSES,
    "ref_products": REF_PRODUCTS,
    "fact_shipments": FACT_SHIPMENTS,
}

DIMENSION_KEYS: dict[str, str] = {
    "ref_suppliers": "supplier_key",
    "ref_carriers": "carrier_key",
    "ref_routes": "route_key",
    "ref_warehouses": "warehouse_key",
    "ref_products": "product_key",
}

FOREIGN_KEYS: tuple[str, ...] = tuple(DIMENSION_KEYS.values())
