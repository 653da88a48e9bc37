"""Small random stars: repeated and missing keys, hot keys, all kinds of dirt."""

import random
from datetime import date, timedelta
from decimal import Decimal

from lanewise import schema
from lanewise.sources.star import Star, from_tables

BLANKS = (None, "", " ", "   ")


def tables(seed: int, shipments: int = 400) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)

    def text(*values: str) -> str | None:
        return rnd.choice(BLANKS) if rnd.random() < 0.2 else rnd.choice(values)

    def maybe(value):
        return None if rnd.random() < 0.15 else value

    def amount(top: int, places: int) -> Decimal:
        return Decimal(rnd.randint(0, top)).scaleb(-places)

    def day(spread: int) -> date:
        return date(2021, 1, 1) + timedelta(days=rnd.randint(0, spread))

    def keys(count: int) -> list[int]:
        return [*range(count), 0, 1]  # two keys are repeated

    def fact(i: int) -> tuple:
        def ref(top: int):
            # a third of the shipments share one key; some have none or an unknown one
            return rnd.choice([0, rnd.randint(0, top + 2), maybe(rnd.randint(0, top))])

        ordered = maybe(day(1200))
        promised = maybe((ordered or date(2022, 5, 5)) + timedelta(days=rnd.randint(2, 20)))
        actual = maybe((promised or date(2022, 5, 9)) + timedelta(days=rnd.randint(-12, 20)))
        # delays of a few days only, so that equal rates and true halves occur
        delay = maybe(rnd.choice([-3, 0, 0, 1, 2, 3, 4, 7, 8, 14, 15, 20]))
        cost = maybe(rnd.choice([Decimal("1500.50"), Decimal("1500.00"), Decimal("5000.50"),
                                 Decimal("499.99"), amount(1_500_000, 2)]))
        return (maybe(i), f"S-{i}", ref(12), ref(8), ref(10), ref(6), ref(10), ordered, promised,
                actual, text("Delivered", "Delayed", "Data Error"), delay, cost,
                maybe(amount(90_000, 2)), maybe(rnd.randint(1, 50)))

    return {
        "ref_suppliers": [
            (k, f"SUP-{k}", text("Acme", "Bolt", "Core"), text("UAE", "saudi ARABIA", " turkey "),
             text("A", "B"), text("Gold", "Silver", "Platinum", "Bronze"), maybe(amount(50, 1)),
             maybe(day(900)), text("Active", "Inactive")) for k in keys(12)],
        "ref_carriers": [
            (k, f"CAR-{k}", text("Fast", "Slow"), text("SEA", "road", "Air"), maybe(amount(10000, 2)),
             maybe(amount(90000, 4)), text("Global", "EU"), text("Active")) for k in keys(8)],
        "ref_routes": [
            (k, f"RTE-{k}", text("Oslo", "Rome"), text("Lima", "Pune"), text("EU", "Asia"),
             maybe(rnd.randint(300, 9000)), maybe(rnd.randint(1, 22))) for k in keys(10)],
        "ref_warehouses": [
            (k, f"WH-{k}", text("North", "South"), text("NO", "IN"), text("EU", "Asia"),
             rnd.choice([None, 0, 100, 1000]), maybe(rnd.randint(0, 1100)), maybe(amount(600, 1)))
            for k in keys(6)],
        "ref_products": [
            (k, f"PRD-{k}", text("Pump", "Valve"), text("Metal", "Glass"), maybe(amount(90_000, 2)),
             text("Low", "Medium", "High"), maybe(amount(9_000_000, 2))) for k in keys(10)],
        "fact_shipments": [fact(i) for i in range(shipments)],
    }


def star(spark, rows: dict[str, list[tuple]]) -> Star:
    return from_tables({
        name: spark.createDataFrame(rows[name], layout).coalesce(2)
        for name, layout in schema.TABLES.items()
    })


def store_for_sql(raw: Star, root: str) -> dict[str, str]:
    """Write the tables and give the SQL that reads each of them."""
    out = {}
    for name in schema.TABLES:
        raw.table(name).write.parquet(f"{root}/{name}")
        out[name] = f"select * from read_parquet('{root}/{name}/*.parquet')"
    return out
