"""One SQL text per analysis.

Rates and averages are computed from whole numbers (``//``), because decimal
division is a double in DuckDB and would round a true half either way.
Counts are BIGINT, money and rates DOUBLE.
"""

from __future__ import annotations

from parity.star_sql import RAW, blank, join, with_star

VALID = "f.status <> 'Data Error'"
DATED = f"f.order_date is not null and {VALID}"
COSTED = "f.shipment_cost is not null"

N = "count(f.shipment_key)"
LATE = "count(case when f.delay_days > 0 then 1 end)"
ON_TIME = "count(case when coalesce(f.delay_days, 0) <= 0 then 1 end)"
CENTS = "sum(f.cost_c)"
LATE_CENTS = "sum(case when f.delay_days > 0 then f.cost_c else 0 end)"
LATE_DAYS = "sum(case when f.delay_days > 0 then f.delay_days end)"

YEAR = "cast(extract(year from f.order_date) as integer)"
MONTH = "cast(date_trunc('month', f.order_date) as date)"
YEAR_START = "cast(date_trunc('year', f.order_date) as date)"


def half_up(num: str, den: str) -> str:
    """num / den to the nearest whole number, halves up; for num >= 0."""
    return f"(2 * ({num}) + ({den})) // nullif(2 * ({den}), 0)"


def ratio(num: str, den: str, digits: int, times: int = 1) -> str:
    scale = 10 ** digits
    return f"cast({half_up(f'{times * scale} * cast({num} as hugeint)', den)} as double) / {scale}"


def pct(part: str, whole: str) -> str:
    return ratio(part, whole, 2, 100)


def money(cents: str) -> str:
    return f"cast({cents} as double) / 100"


def avg_money(cents: str, count: str) -> str:
    return f"cast({half_up(cents, count)} as double) / 100"


def unk(c: str) -> str:
    return f"coalesce({c}, 'Unknown')"


COST = money(CENTS)
ACOST = avg_money(CENTS, "count(f.cost_c)")
DR = pct(LATE, N)
OTR = pct(ON_TIME, N)
ADL = ratio(LATE_DAYS, LATE, 1)
DCOST = money(LATE_CENTS)

FACT = "from fact_shipments f"


def months(a: str, b: str) -> str:
    return (f"cast((extract(year from {b}) - extract(year from {a})) * 12"
            f" + extract(month from {b}) - extract(month from {a}) as integer)")


def grouped(keys: dict[str, str], figures: dict[str, str], joins: str = "", where: str = "") -> str:
    picks = ", ".join(f"{e} as {n}" for n, e in {**keys, **figures}.items())
    dims = " ".join(join(a) for a in joins)
    cond = f"where {where}" if where else ""
    by = f"group by {', '.join(keys.values())}" if keys else ""
    return f"select {picks} {FACT} {dims} {cond} {by}"


def delay_case(labels: list[str], column: str = "f.delay_days") -> str:
    a, b, c, d, e = labels
    return (f"case when {column} <= 0 then '{a}' when {column} between 1 and 3 then '{b}'"
            f" when {column} between 4 and 7 then '{c}' when {column} between 8 and 14 then '{d}'"
            f" else '{e}' end")


BUCKETS = ["On Time", "1 - 3 Days Late", "4 - 7 Days Late", "8 - 14 Days Late", "Over 14 Days Late"]
TIERS = ["On Time", "Minor     (1 - 3 days)", "Moderate  (4 - 7 days)", "Severe    (8 - 14 days)",
         "Critical  (15+ days)"]


def cost_case(c: str) -> str:
    return f"""case when {c} < 500 then 'Low       (Below $500)'
        when {c} between 500 and 1500 then 'Mid       ($500 - $1,500)'
        when {c} between 1501 and 5000 then 'High      ($1,500 - $5,000)'
        when {c} between 5001 and 10000 then 'Premium   ($5,000 - $10,000)'
        else 'Elite     (Above $10,000)' end"""


def util_tenths(load: str, capacity: str) -> str:
    return half_up(f"{load} * 1000", capacity)


def _explore() -> dict[str, str]:
    def distinct(table: str, *columns: str) -> str:
        return f"select distinct {', '.join(columns)} from {table}"

    out = {
        "ex_row_counts": " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count from {t}" for t in RAW),
        "ex_supplier_countries": distinct("ref_suppliers", "country"),
        "ex_supplier_categories": distinct("ref_suppliers", "category"),
        "ex_supplier_tiers": distinct("ref_suppliers", "contract_tier"),
        "ex_supplier_breakdown": distinct("ref_suppliers", "country", "category", "contract_tier"),
        "ex_supplier_statuses": distinct("ref_suppliers", "status"),
        "ex_carrier_modes": distinct("ref_carriers", "transport_mode"),
        "ex_carrier_regions": distinct("ref_carriers", "coverage_region"),
        "ex_carrier_breakdown": distinct("ref_carriers", "transport_mode", "coverage_region"),
        "ex_route_regions": distinct("ref_routes", "region"),
        "ex_route_origins": distinct("ref_routes", "origin"),
        "ex_route_destinations": distinct("ref_routes", "destination"),
        "ex_warehouse_regions": distinct("ref_warehouses", "region"),
        "ex_warehouse_countries": distinct("ref_warehouses", "country"),
        "ex_product_categories": distinct("ref_products", "category"),
        "ex_product_fragilities": distinct("ref_products", "fragility"),
        "ex_product_breakdown": distinct("ref_products", "category", "fragility"),
        "ex_shipment_statuses": distinct("fact_shipments", "status"),
        "ex_suppliers_missing_name":
            distinct("ref_suppliers", "supplier_key", "supplier_id", "supplier_name")
            + f" where {blank('supplier_name')}",
        "ex_shipments_missing_status":
            distinct("fact_shipments", "shipment_key", "shipment_id", "status")
            + f" where {blank('status')}",
        "ex_missing_actual_date":
            f"select count(*) as shipments_missing_actual_date {FACT}"
            " where trim(coalesce(cast(actual_date as varchar), '')) = ''",
        "ex_delay_not_calculated":
            f"select count(*) as delay_days_not_calculated {FACT}"
            " where delay_days is null and actual_date is not null",
    }
    columns = []
    for table, fields in PROFILE.items():
        for position, (name, kind, width) in enumerate(fields, 1):
            columns.append(
                f"select '{table}' as table_name, {position} as ordinal_position,"
                f" '{name}' as column_name, '{kind}' as data_type, 'YES' as is_nullable,"
                f" cast({width or 'null'} as integer) as character_maximum_length,"
                f" count(*) - count({name}) as n_null,"
                f" count(*) filter (where trim(cast({name} as varchar)) = '') as n_blank,"
                f" count(distinct {name}) as n_distinct from {table}")
    out["ex_profile"] = " union all ".join(columns)
    return out


PROFILE = {
    "ref_suppliers": [
        ("supplier_key", "bigint", 0), ("supplier_id", "string", 50), ("supplier_name", "string", 100),
        ("country", "string", 50), ("category", "string", 50), ("contract_tier", "string", 20),
        ("rating", "decimal(3,1)", 0), ("onboarded_date", "date", 0), ("status", "string", 20)],
    "ref_carriers": [
        ("carrier_key", "bigint", 0), ("carrier_id", "string", 50), ("carrier_name", "string", 100),
        ("transport_mode", "string", 20), ("on_time_rate", "decimal(5,2)", 0),
        ("avg_cost_per_km", "decimal(8,4)", 0), ("coverage_region", "string", 50),
        ("status", "string", 20)],
    "ref_routes": [
        ("route_key", "bigint", 0), ("route_id", "string", 50), ("origin", "string", 100),
        ("destination", "string", 100), ("region", "string", 50), ("distance_km", "int", 0),
        ("avg_transit_days", "smallint", 0)],
    "ref_warehouses": [
        ("warehouse_key", "bigint", 0), ("warehouse_id", "string", 50), ("location", "string", 100),
        ("country", "string", 50), ("region", "string", 50), ("capacity", "int", 0),
        ("current_load", "int", 0), ("processing_time_avg", "decimal(4,1)", 0)],
    "ref_products": [
        ("product_key", "bigint", 0), ("product_id", "string", 50), ("product_name", "string", 100),
        ("category", "string", 50), ("weight_kg", "decimal(10,2)", 0), ("fragility", "string", 20),
        ("value_usd", "decimal(12,2)", 0)],
    "fact_shipments": [
        ("shipment_key", "bigint", 0), ("shipment_id", "string", 50), ("supplier_key", "bigint", 0),
        ("carrier_key", "bigint", 0), ("route_key", "bigint", 0), ("warehouse_key", "bigint", 0),
        ("product_key", "bigint", 0), ("order_date", "date", 0), ("promised_date", "date", 0),
        ("actual_date", "date", 0), ("status", "string", 20), ("delay_days", "int", 0),
        ("shipment_cost", "decimal(12,2)", 0), ("weight_kg", "decimal(10,2)", 0),
        ("quantity", "int", 0)],
}


def _dates() -> dict[str, str]:
    def span(table: str, column: str, first: str, last: str, length: str, expr) -> str:
        a, b = f"min({column})", f"max({column})"
        return (f"select {a} as {first}, {b} as {last}, {expr(a, b)} as {length} from {table}"
                f" where {column} is not null")

    def window(end: str, suffix: str) -> str:
        days = f"cast({end} - order_date as integer)"
        return (f"select min({days}) as shortest_{suffix}, max({days}) as longest_{suffix},"
                f" cast(sum({days}) // count({days}) as bigint) as avg_{suffix} {FACT}"
                f" where order_date is not null and {end} is not null")

    return {
        "dt_order_span": span("fact_shipments", "order_date", "first_order_date",
                              "last_order_date", "data_range_months", months),
        "dt_delivery_span": span("fact_shipments", "actual_date", "first_delivery_date",
                                 "last_delivery_date", "delivery_range_months", months),
        "dt_promised_window": window("promised_date", "promised_window_days"),
        "dt_actual_transit": window("actual_date", "actual_transit_days"),
        "dt_supplier_span": span(
            "ref_suppliers", "onboarded_date", "first_supplier_onboarded",
            "last_supplier_onboarded", "supplier_network_span_years",
            lambda a, b: f"cast(extract(year from {b}) - extract(year from {a}) as integer)"),
        "dt_yearly_volume": grouped({"shipment_year": YEAR}, {"total_shipments": N},
                                    where="f.order_date is not null"),
        "dt_impossible_dates":
            f"select count(*) as impossible_date_records {FACT} where actual_date < order_date",
        "dt_promised_before_ordered":
            f"select count(*) as promised_before_ordered {FACT} where promised_date < order_date",
        "dt_missing_actual":
            f"select count(*) as shipments_missing_actual_date {FACT} where actual_date is null",
    }


def _distribution() -> dict[str, str]:
    n = {"total_shipments": N}
    cost = {"total_cost": COST}
    avg = {"avg_cost_per_shipment": ACOST}
    return {
        "vc_supplier_country": grouped({"country": unk("s.country")}, n, "s"),
        "vc_supplier_category": grouped({"supplier_category": unk("s.category")}, n, "s"),
        "vc_supplier_tier": grouped({"contract_tier": unk("s.contract_tier")}, n, "s"),
        "vc_mode_cost": grouped({"transport_mode": unk("c.transport_mode")}, {**n, **cost, **avg}, "c"),
        "vc_coverage_region": grouped({"coverage_region": unk("c.coverage_region")}, {**n, **avg}, "c"),
        "vc_route_region": grouped(
            {"route_region": unk("r.region")},
            {**n, **avg,
             "avg_distance_km": "cast(sum(r.distance_km) // count(r.distance_km) as bigint)"}, "r"),
        "vc_warehouse": grouped(
            {"warehouse_location": unk("w.location"), "warehouse_region": unk("w.region")},
            {**n, **cost}, "w"),
        "vc_product_category": grouped(
            {"product_category": unk("p.category")},
            {**n, **cost, "avg_weight_kg": avg_money("sum(f.weight_c)", "count(f.weight_c)")}, "p"),
        "vc_fragility": grouped({"fragility_level": unk("p.fragility")}, {**n, **cost, **avg}, "p"),
        "vc_status": grouped({"shipment_status": "coalesce(trim(f.status), 'Unknown')"}, {**n, **cost}),
        "vc_delay_bucket": grouped({"delay_bucket": delay_case(BUCKETS)},
                                   {**n, "avg_cost_in_bucket": ACOST},
                                   where="f.delay_days is not null"),
        "vc_tier_cost": grouped({"contract_tier": unk("s.contract_tier")}, {**n, **cost, **avg}, "s"),
        "vc_mode_cost_range": grouped(
            {"transport_mode": unk("c.transport_mode")},
            {"avg_cost": ACOST, "min_cost": money("min(f.cost_c)"), "max_cost": money("max(f.cost_c)"),
             "total_weight_kg": money("sum(f.weight_c)")}, "c", COSTED),
    }


def _checks(parts: list[tuple[str, str, str]], value: str) -> str:
    return " union all ".join(
        f"select '{name}' as check_name, count(*) as {value} from {table} where {test}"
        for name, table, test in parts)


def _audit_before() -> str:
    s, f = "ref_suppliers", "fact_shipments"
    return _checks([
        ("suppliers_missing_name", s, blank("supplier_name")),
        ("suppliers_missing_country", s, blank("country")),
        ("suppliers_missing_tier", s, blank("contract_tier")),
        ("suppliers_missing_rating", s, blank("cast(rating as varchar)")),
        ("suppliers_missing_status", s, blank("status")),
        ("carriers_missing_mode", "ref_carriers", blank("transport_mode")),
        ("carriers_missing_otd_rate", "ref_carriers", "on_time_rate is null"),
        ("routes_missing_origin_or_destination", "ref_routes",
         f"{blank('origin')} or {blank('destination')}"),
        ("shipments_missing_actual_date", f, "actual_date is null"),
        ("shipments_delay_not_calculated", f, "delay_days is null and actual_date is not null"),
        ("impossible_date_records", f, "actual_date < order_date"),
        ("shipments_missing_cost", f, "shipment_cost is null"),
        ("shipments_missing_status", f, blank("status")),
    ], "issues")


def _audits() -> dict[str, str]:
    f = "fact_shipments"
    return {
        "audit_after": _checks([
            ("ref_suppliers — dirty names", "ref_suppliers", blank("supplier_name")),
            ("ref_suppliers — dirty countries", "ref_suppliers", blank("country")),
            ("ref_carriers — dirty modes", "ref_carriers", blank("transport_mode")),
            ("ref_carriers — null on_time_rate", "ref_carriers", "on_time_rate is null"),
            ("ref_routes — dirty origins", "ref_routes", blank("origin")),
            ("ref_routes — dirty destinations", "ref_routes", blank("destination")),
            ("ref_products — dirty names", "ref_products", blank("product_name")),
            ("fact_shipments — blank status", f, blank("status")),
            ("fact_shipments — null cost", f, "shipment_cost is null"),
            ("fact_shipments — null delay_days", f, "delay_days is null and actual_date is not null"),
            ("fact_shipments — impossible dates", f, "status = 'Data Error'"),
        ], "remaining_issues"),
        "confirm_suppliers":
            "select count(*) as remaining_dirty_supplier_records from ref_suppliers where "
            + " or ".join(blank(c) for c in ("supplier_name", "country", "contract_tier", "status")),
        "confirm_carriers":
            "select count(*) as remaining_dirty_carrier_records from ref_carriers where "
            f"{blank('carrier_name')} or {blank('transport_mode')} or on_time_rate is null"
            " or avg_cost_per_km is null",
        "confirm_routes":
            "select count(*) as remaining_dirty_route_records from ref_routes where "
            + " or ".join(blank(c) for c in ("origin", "destination", "region")),
        "confirm_products":
            "select count(*) as remaining_dirty_product_records from ref_products where "
            + " or ".join(blank(c) for c in ("product_name", "category", "fragility")),
        "confirm_shipments":
            "select count(*) filter (where delay_days is null and actual_date is not null)"
            " as delay_days_still_null_with_actual_date,"
            f" count(*) filter (where {blank('status')}) as remaining_blank_statuses,"
            f" count(*) filter (where shipment_cost is null) as remaining_null_costs {FACT}",
    }


TABLE_COLUMNS = {
    table: ", ".join(
        f"cast({name} as double) as {name}" if kind.startswith("decimal") else name
        for name, kind, _ in fields)
    for table, fields in PROFILE.items()
}


def _cleaned() -> dict[str, str]:
    return {
        f"clean_{table.split('_', 1)[1]}": f"select {TABLE_COLUMNS[table]} from {table}"
        for table in RAW if table != "ref_warehouses"
    }


def _loads() -> dict[str, str]:
    """A loaded table equals its source, with empty text as NULL."""
    out = {}
    for table, fields in PROFILE.items():
        picks = ", ".join(
            f"cast({n} as double) as {n}" if k.startswith("decimal")
            else f"nullif({n}, '') as {n}" if k == "string" else n
            for n, k, _ in fields)
        out[f"load_{table.split('_', 1)[1]}"] = f"select {picks} from {table}"
    return out


def _rejects() -> str:
    def line(table: str, faults: dict[str, str], extra: str) -> str:
        fields = [
            f"coalesce({faults.get(n, 'null')}, cast({n} as varchar), '')"
            for n, _, _ in PROFILE[table]]
        return " || ',' || ".join(fields) + f" || {extra}"

    suppliers = line("ref_suppliers", {
        "rating": "case when supplier_key % 10 = 3 then 'n/a' end",
        "onboarded_date": "case when supplier_key % 10 = 6 then 'soon' end"}, "''")
    shipments = line("fact_shipments", {
        "shipment_cost": "case when shipment_key % 97 = 5 then '12.x' end",
        "quantity": "case when shipment_key % 89 = 7 then ' ' end"},
        "case when shipment_key % 101 = 3 then ',surplus' else '' end")
    return (
        f"select 'ref_suppliers' as table_name, {suppliers} as line,"
        " case when supplier_key % 10 = 3 then 'bad value in rating'"
        " else 'bad value in onboarded_date' end as reason"
        " from ref_suppliers where supplier_key % 10 = 3 or supplier_key % 10 = 6"
        f" union all select 'fact_shipments', {shipments},"
        " case when shipment_key % 101 = 3 then 'wrong number of fields'"
        " else 'bad value in shipment_cost' end"
        " from fact_shipments where shipment_key % 101 = 3 or shipment_key % 97 = 5")


def _kpis() -> dict[str, str]:
    def one(expr: str, name: str, where: str = VALID) -> str:
        return f"select {expr} as {name} {FACT} where {where}"

    def whole(cents: str) -> str:
        return f"cast({half_up(cents, '100')} as double)"

    rows = [
        ("Total Shipments", N), ("On-Time Shipments", ON_TIME), ("Delayed Shipments", LATE),
        ("Total Network Cost (USD)", whole(CENTS)),
        ("Avg Shipment Cost (USD)", half_up(CENTS, "count(f.cost_c) * 100")),
        ("Avg Delay Days (Late Only)", half_up(LATE_DAYS, LATE)),
        ("Total Weight Shipped (kg)", whole("sum(f.weight_c)")),
        ("Active Suppliers", "count(distinct f.supplier_key)"),
        ("Active Carriers", "count(distinct f.carrier_key)"),
        ("Active Routes", "count(distinct f.route_key)"),
        ("Active Warehouses", "count(distinct f.warehouse_key)"),
    ]
    report = [
        f"select '{name}' as measure_name, cast({expr} as double) as measure_value {FACT} where {VALID}"
        for name, expr in rows
    ] + [
        "select 'Registered Suppliers', cast(count(supplier_key) as double) from ref_suppliers",
        "select 'Total Product Categories', cast(count(distinct category) as double) from ref_products",
    ]
    return {
        "kpi_total_shipments": one(N, "total_shipments"),
        "kpi_on_time": one(N, "on_time_shipments", f"coalesce(f.delay_days, 0) <= 0 and {VALID}"),
        "kpi_delayed": one(N, "delayed_shipments", f"f.delay_days > 0 and {VALID}"),
        "kpi_otd_rate": one(OTR, "on_time_delivery_rate_pct"),
        "kpi_avg_delay": one(ratio("sum(f.delay_days)", "count(f.delay_days)", 1),
                             "avg_delay_days_when_late", f"f.delay_days > 0 and {VALID}"),
        "kpi_total_cost": one(COST, "total_network_cost", f"{COSTED} and {VALID}"),
        "kpi_avg_cost": one(ACOST, "avg_shipment_cost", f"{COSTED} and {VALID}"),
        "kpi_total_weight": one(money("sum(f.weight_c)"), "total_weight_shipped_kg",
                                f"f.weight_kg is not null and {VALID}"),
        "kpi_active_suppliers": one("count(distinct f.supplier_key)", "total_active_suppliers"),
        "kpi_registered_suppliers":
            "select count(supplier_key) as total_registered_suppliers from ref_suppliers",
        "kpi_carriers_used": one("count(distinct f.carrier_key)", "total_carriers_used"),
        "kpi_routes_used": one("count(distinct f.route_key)", "total_routes_used"),
        "kpi_warehouses_used": one("count(distinct f.warehouse_key)", "total_warehouses_used"),
        "kpi_product_categories":
            "select count(distinct category) as total_product_categories from ref_products",
        "kpi_report": " union all ".join(report),
    }


def _rankings() -> dict[str, str]:
    supplier = {"supplier_name": "s.supplier_name", "country": "s.country",
                "contract_tier": "s.contract_tier"}
    tie = "supplier_name nulls first, country nulls first, contract_tier nulls first"
    n, late = {"total_shipments": N}, {"delayed_shipments": LATE}
    rate = {"delay_rate_pct": DR}

    def rank(part: str, name: str) -> dict[str, str]:
        order = f"cast({part} as double) * 100 / nullif({N}, 0)"
        return {name: f"cast(rank() over (order by {order} desc nulls last) as integer)"}

    def upto(query: str, name: str, limit: int) -> str:
        return f"select * from ({query}) ranked where {name} <= {limit}"

    quartiles = grouped(supplier, {**n, **rate}, "s")
    gap = f"(cast(c.on_time_rate * 100 as bigint) * {N} - 10000 * {ON_TIME})"
    return {
        "rk_worst_suppliers_top5":
            grouped(supplier, {**n, **late, **rate}, "s")
            + f" order by delay_rate_pct desc nulls last, {tie} limit 5",
        "rk_best_suppliers_top5":
            grouped(supplier, {**n, "on_time_rate_pct": OTR}, "s")
            + f" order by on_time_rate_pct desc nulls last, {tie} limit 5",
        "rk_suppliers_rank10": upto(
            "select supplier_name, country, contract_tier, cast(rating as double) as supplier_rating,"
            " total_shipments, delayed_shipments, delay_rate_pct, total_cost, delay_rank from ("
            + grouped({**supplier, "rating": "s.rating"},
                      {**n, **late, **rate, "total_cost": COST, **rank(LATE, "delay_rank")}, "s")
            + ") g", "delay_rank", 10),
        "rk_carriers":
            "select carrier_name, transport_mode, cast(on_time_rate as double) as contracted_otd_rate,"
            " total_shipments, actual_otd_rate_pct, otd_gap_vs_contract, avg_shipment_cost,"
            " cast(reliability_rank as bigint) as reliability_rank from ("
            + grouped(
                {"carrier_name": "c.carrier_name", "transport_mode": "c.transport_mode",
                 "on_time_rate": "c.on_time_rate"},
                {**n, "actual_otd_rate_pct": OTR,
                 "otd_gap_vs_contract":
                     f"cast(sign({gap}) * ({half_up(f'abs({gap})', N)}) as double) / 100",
                 "avg_shipment_cost": ACOST, **rank(ON_TIME, "reliability_rank")}, "c") + ") g",
        "rk_routes_rank10": upto(grouped(
            {"origin": "r.origin", "destination": "r.destination", "region": "r.region",
             "distance_km": "r.distance_km", "expected_transit_days": "r.avg_transit_days"},
            {**n, **late, **rate, "avg_delay_days_when_late": ADL, **rank(LATE, "route_delay_rank")},
            "r"), "route_delay_rank", 10),
        "rk_warehouses_rank5":
            "select location, region, capacity, current_load,"
            f" cast({util_tenths('current_load', 'capacity')} as double) / 10 as utilisation_pct,"
            " cast(processing_time_avg as double) as processing_time_avg, total_shipments,"
            " delayed_shipments, delay_rate_pct, bottleneck_rank from ("
            + grouped({c: f"w.{c}" for c in
                       ("location", "region", "capacity", "current_load", "processing_time_avg")},
                      {**n, **late, **rate, **rank(LATE, "bottleneck_rank")}, "w")
            + ") g where bottleneck_rank <= 5",
        "rk_supplier_quartiles":
            "select *, case performance_quartile when 1 then 'Critical — Immediate Action'"
            " when 2 then 'At Risk — Close Monitoring' when 3 then 'Acceptable — Standard Review'"
            " else 'Healthy — Best Practice' end as quartile_label from ("
            f"select *, cast(ntile(4) over (order by delay_rate_pct desc nulls last, {tie}) as integer)"
            f" as performance_quartile from ({quartiles}) g) q",
        "rk_product_exposure": grouped(
            {"product_category": unk("p.category")},
            {**n, **late, "cost_of_delayed_shipments": DCOST, **rate,
             "cost_exposure_rank":
                 f"rank() over (order by {LATE_CENTS} desc nulls last)"}, "p"),
    }


def _trends() -> dict[str, str]:
    n, late, rate = {"total_shipments": N}, {"delayed_shipments": LATE}, {"delay_rate_pct": DR}
    cost, avg = {"total_cost": COST}, {"avg_cost_per_shipment": ACOST}
    year, month = {"shipment_year": YEAR}, {"shipment_month": MONTH}
    exact = f"cast({LATE} as double) * 100 / nullif({N}, 0)"
    hundredths = half_up(f"10000 * {LATE}", N)
    return {
        "ts_month_parts": grouped(
            {**year, "shipment_month": "cast(extract(month from f.order_date) as integer)"},
            {**n, **late, **rate, **cost, **avg, "avg_delay_days_when_late": ADL}, where=DATED),
        "ts_month_trunc": grouped(month, {**n, **late, **rate, **cost, **avg}, where=DATED),
        "ts_month_label": grouped({"shipment_month": "strftime(f.order_date, '%Y-%b')"},
                                  {**n, **late, **rate, **cost}, where=DATED),
        "ts_quarter": grouped(
            {**year, "shipment_quarter": "cast(extract(quarter from f.order_date) as integer)"},
            {**n, **late, **rate, **cost,
             "quarter_risk_flag": f"case when {exact} >= 35 then 'High Risk Quarter'"
                                  f" when {exact} >= 25 then 'Elevated Risk Quarter'"
                                  " else 'Normal Quarter' end"}, where=DATED),
        "ts_year": grouped(year, {**n, **late, **rate, **cost, **avg}, where=DATED),
        "ts_mom_delay":
            "select shipment_month, cast(r as double) / 100 as delay_rate_pct, monthly_cost,"
            " cast(p as double) / 100 as prev_month_delay_rate,"
            " cast(r - p as double) / 100 as mom_delay_change,"
            " case when r > p then 'Worsening' when r < p then 'Improving'"
            " when p is null then 'Baseline' else 'No Change' end as trend_direction"
            " from (select *, lag(r) over (order by shipment_month) as p from ("
            + grouped(month, {"r": hundredths, "monthly_cost": COST}, where=DATED) + ") g) l",
        "ts_year_mode": grouped({**year, "transport_mode": unk("c.transport_mode")},
                                {**n, **rate, **cost}, "c", DATED),
        "ts_year_region": grouped({**year, "route_region": unk("r.region")},
                                  {**n, **rate, **cost}, "r", DATED),
    }


def _cumulative() -> dict[str, str]:
    month, year = {"shipment_month": MONTH}, {"shipment_year": YEAR_START}
    both = f"{COSTED} and {DATED}"

    def so_far(expr: str, by: str) -> str:
        return f"{expr} over (order by {by})"

    def total(c: str, by: str) -> str:
        return so_far(f"sum({c})", by)

    m, y = "shipment_month", "shipment_year"
    six = half_up(f"10000 * {total('r', m)}", so_far("count(r)", m))
    on_time, late = total("monthly_on_time", m), total("monthly_delayed", m)
    return {
        "cu_month_cost":
            f"select {m}, monthly_shipments, {money('c')} as monthly_cost, delayed_shipments,"
            f" {money(total('c', m))} as running_total_cost,"
            f" cast({six} as double) / 1000000 as moving_avg_delay_rate from ("
            + grouped(month, {"monthly_shipments": N, "delayed_shipments": LATE, "c": CENTS,
                              "r": half_up(f"10000 * {LATE}", N)}, where=both) + ") t",
        "cu_month_delayed":
            f"select {m}, monthly_delayed,"
            f" cast({total('monthly_delayed', m)} as bigint) as running_total_delayed,"
            f" avg(cast(monthly_delayed as double)) over (order by {m} rows between 2 preceding"
            " and current row) as rolling_3m_avg_delayed from ("
            + grouped(month, {"monthly_delayed": LATE}, where=DATED) + ") t",
        "cu_year_cost":
            f"select {y}, yearly_shipments, {money('c')} as yearly_cost, yearly_delayed,"
            f" {money(total('c', y))} as running_total_cost,"
            f" {money(total('c', y))} / {so_far('count(c)', y)} as moving_avg_yearly_cost,"
            f" {money(total('d', y))} / {so_far('count(d)', y)} as moving_avg_delay_days from ("
            + grouped(year, {"yearly_shipments": N, "yearly_delayed": LATE, "c": CENTS,
                             "d": half_up(f"100 * {LATE_DAYS}", LATE)}, where=both) + ") t",
        "cu_month_on_time":
            f"select {m}, monthly_on_time, monthly_delayed,"
            f" cast({on_time} as bigint) as running_total_on_time,"
            f" cast({late} as bigint) as running_total_delayed,"
            f" {pct(on_time, f'{on_time} + {late}')} as cumulative_otd_rate_pct from ("
            + grouped(month, {"monthly_on_time": ON_TIME, "monthly_delayed": LATE}, where=DATED)
            + ") t",
        "cu_year_delay_cost":
            f"select {y}, {money('d')} as cost_of_delays, {money('c')} as total_cost,"
            f" {money(total('d', y))} as running_cost_of_delays,"
            f" {money(total('c', y))} as running_total_cost,"
            f" {pct(total('d', y), total('c', y))} as cumulative_delay_cost_pct from ("
            + grouped(year, {"d": LATE_CENTS, "c": CENTS}, where=both) + ") t",
    }


def _history(inner: str, keep: str, entity: str, names: tuple[str, str, str],
             labels: tuple[str, str], ties: str) -> str:
    """v holds the measure in hundredths; its average is rounded to six decimals."""
    value, average, previous = names
    up, down = labels
    order = ", ".join(["shipment_year", *[f"{t} nulls first" for t in ties.split()]])
    six = half_up("10000 * s", "k")
    off = f"(10000 * cast(v as hugeint) - {six})"
    return (
        f"select shipment_year, {keep}, cast(v as double) / 100 as {value},"
        f" cast({six} as double) / 1000000 as {average},"
        f" cast(sign({off}) * ((abs({off}) + 5000) // 10000) as double) / 100 as diff_from_avg,"
        f" case when {off} > 0 then 'Above Avg' when {off} < 0 then 'Below Avg' else 'Avg' end"
        " as avg_change,"
        f" cast(p as double) / 100 as {previous}, cast(v - p as double) / 100 as diff_py,"
        f" case when v > p then '{up}' when v < p then '{down}' when p is null then 'Baseline'"
        " else 'No Change' end as py_change"
        f" from (select *, sum(v) over (partition by {entity}) as s,"
        f" count(v) over (partition by {entity}) as k,"
        f" lag(v) over (partition by {entity} order by {order}) as p from ({inner}) g) h")


def _benchmarks() -> dict[str, str]:
    year = {"shipment_year": YEAR}
    late, on_time = half_up(f"10000 * {LATE}", N), half_up(f"10000 * {ON_TIME}", N)
    delay = ("current_delay_rate", "avg_delay_rate", "py_delay_rate")
    return {
        "yoy_supplier_delay": _history(
            grouped({**year, **{c: f"s.{c}" for c in ("supplier_name", "country", "contract_tier")}},
                    {"v": late}, "s", DATED),
            "supplier_name, country, contract_tier", "supplier_name", delay,
            ("Worsening", "Improving"), "country contract_tier"),
        "yoy_carrier_otd": _history(
            grouped({**year, **{c: f"c.{c}" for c in ("carrier_name", "transport_mode")}},
                    {"v": on_time}, "c", DATED),
            "carrier_name, transport_mode", "carrier_name",
            ("current_otd_rate", "avg_otd_rate", "py_otd_rate"),
            ("Improving", "Declining"), "transport_mode"),
        "yoy_region_cost": _history(
            grouped({**year, "route_region": unk("r.region")},
                    {"v": CENTS, "current_delay_rate": DR}, "r", f"{COSTED} and {DATED}"),
            "route_region, current_delay_rate", "route_region",
            ("current_cost", "avg_cost", "py_cost"), ("Increase", "Decrease"), ""),
        "yoy_warehouse_delay": _history(
            grouped({**year, "warehouse_location": unk("w.location"),
                     "warehouse_region": unk("w.region"), "current_load": "w.current_load",
                     "capacity": "w.capacity"}, {"v": late}, "w", DATED),
            "warehouse_location, warehouse_region,"
            f" cast({util_tenths('current_load', 'capacity')} as double) / 10 as utilisation_pct",
            "warehouse_location", delay, ("Worsening", "Improving"),
            "warehouse_region current_load capacity"),
    }


def _segments() -> dict[str, str]:
    supplier = {c: f"s.{c}" for c in ("supplier_key", "supplier_name", "contract_tier")}
    hundredths = half_up(f"10000 * {LATE}", N)

    def counted(inner: str, case: str, name: str, key: str, total: str) -> str:
        return f"select {case} as {name}, count({key}) as {total} from ({inner}) g group by {case}"

    tier = ("case when r >= 4000 then 'Critical  (40%+ delay rate)'"
            " when r >= 2500 then 'At Risk   (25% - 39%)'"
            " when r >= 1000 then 'Monitor   (10% - 24%)' else 'Healthy   (Below 10%)' end")
    relation = ("case when m >= 18 and n > 100 then 'Strategic Partner'"
                " when m >= 12 and n > 50 then 'Key Supplier'"
                " when m >= 6 and n > 20 then 'Developing Supplier' else 'New / Low Volume' end")
    load = ("case when u >= 900 then 'Critical  (90%+ capacity)'"
            " when u >= 750 then 'High Load (75% - 89%)'"
            " when u >= 500 then 'Moderate  (50% - 74%)' else 'Low Load  (Below 50%)' end")
    distance = ("case when distance_km < 1000 then 'Short Haul   (Below 1,000 km)'"
                " when distance_km between 1000 and 3000 then 'Medium Haul  (1,000 - 3,000 km)'"
                " when distance_km between 3001 and 7000 then 'Long Haul    (3,000 - 7,000 km)'"
                " else 'Ultra Haul   (Above 7,000 km)' end")
    routes = grouped(
        {c: f"r.{c}" for c in ("route_key", "origin", "destination", "region", "distance_km")},
        {"v": hundredths}, "r", VALID)
    mean = half_up("10000 * sum(v)", "count(v)")
    return {
        "sg_supplier_tiers": counted(grouped(supplier, {"r": hundredths}, "s", VALID), tier,
                                     "performance_tier", "supplier_key", "total_suppliers"),
        "sg_cost_bands": grouped({"cost_band": cost_case("f.shipment_cost")},
                                 {"total_shipments": N, "delayed_shipments": LATE,
                                  "delay_rate_pct": DR}, where=f"{COSTED} and {VALID}"),
        "sg_delay_tiers": grouped({"delay_tier": delay_case(TIERS)},
                                  {"total_shipments": N, "total_cost_in_tier": COST,
                                   "avg_cost_in_tier": ACOST},
                                  where=f"f.delay_days is not null and {VALID}"),
        "sg_supplier_relationship": counted(
            grouped(supplier, {"n": N, "m": "datediff('month', min(f.order_date), max(f.order_date))"},
                    "s", VALID),
            relation, "supplier_segment", "supplier_key", "total_suppliers"),
        "sg_warehouse_load": counted(
            f"select warehouse_key, {util_tenths('current_load', 'capacity')} as u from ref_warehouses",
            load, "load_segment", "warehouse_key", "total_warehouses"),
        "sg_route_distance":
            f"select {distance} as distance_band, count(route_key) as total_routes,"
            f" cast(({mean} + 5000) // 10000 as double) / 100 as avg_delay_rate_pct,"
            f" cast({half_up('sum(distance_km)', 'count(distance_km)')} as double) as avg_distance_km"
            f" from ({routes}) g group by {distance}",
    }


def _shares() -> dict[str, str]:
    def share(inner: str, picks: str) -> str:
        return f"select {picks} from ({inner}) g"

    def of_all(c: str) -> str:
        return pct(c, f"sum({c}) over ()")

    both = f"{COSTED} and {VALID}"
    all_n, all_c = "cast(sum(total_shipments) over () as bigint)", money("sum(c) over ()")
    return {
        "pw_country_volume": share(
            grouped({"supplier_country": unk("s.country")}, {"total_shipments": N}, "s", VALID),
            f"supplier_country, total_shipments, {all_n} as overall_shipments,"
            f" {of_all('total_shipments')} as percentage_of_total"),
        "pw_mode_cost": share(
            grouped({"transport_mode": unk("c.transport_mode")}, {"c": CENTS}, "c", both),
            f"transport_mode, {money('c')} as total_cost, {all_c} as overall_cost,"
            f" {of_all('c')} as percentage_of_total"),
        "pw_region_delays": share(
            grouped({"route_region": unk("r.region")}, {"total_delayed": LATE, "total_shipments": N},
                    "r", VALID),
            "route_region, total_delayed, total_shipments,"
            " cast(sum(total_delayed) over () as bigint) as overall_delayed,"
            f" {of_all('total_delayed')} as percentage_of_total_delays"),
        "pw_product_cost": share(
            grouped({"product_category": unk("p.category")}, {"total_shipments": N, "c": CENTS},
                    "p", both),
            f"product_category, total_shipments, {money('c')} as total_cost, {all_c} as overall_cost,"
            f" {of_all('c')} as percentage_of_total"),
        "pw_warehouse_volume": share(
            grouped({"warehouse_location": unk("w.location"), "warehouse_region": unk("w.region")},
                    {"total_shipments": N, "c": CENTS}, "w", VALID),
            f"warehouse_location, warehouse_region, total_shipments, {money('c')} as total_cost,"
            f" {all_n} as overall_shipments, {of_all('total_shipments')} as percentage_of_total"),
        "pw_tier_cost": share(
            grouped({"contract_tier": unk("s.contract_tier")},
                    {"total_shipments": N, "c": CENTS, "total_delayed": LATE}, "s", both),
            f"contract_tier, total_shipments, {money('c')} as total_cost, total_delayed,"
            f" {all_c} as overall_cost, {of_all('c')} as pct_of_total_cost,"
            f" {pct('total_delayed', 'total_shipments')} as delay_rate_within_tier"),
    }


AS_OF = "date '2001-11-05'"


def _report_suppliers() -> str:
    keys = {
        **{c: f"s.{c}" for c in ("supplier_key", "supplier_id", "supplier_name", "country",
                                 "category", "contract_tier")},
        "supplier_rating": "s.rating", "onboarded_date": "s.onboarded_date"}
    figures = {
        "n": N, "late": LATE, "ont": ON_TIME, "c": CENTS, "k": "count(f.cost_c)", "days": LATE_DAYS,
        "last": "max(f.order_date)", "first": "min(f.order_date)"}
    hundredths = half_up("10000 * late", "n")
    return f"""
select supplier_key, supplier_id, supplier_name, country, category, contract_tier,
       cast(supplier_rating as double) as supplier_rating, onboarded_date, last as last_shipment_date,
       {months('last', AS_OF)} as recency_months, n as total_shipments, late as total_delayed,
       ont as total_on_time, {money('c')} as total_cost, {avg_money('c', 'k')} as avg_cost_per_shipment,
       {ratio('days', 'late', 1)} as avg_delay_days_when_late, lifespan,
       {pct('ont', 'n')} as on_time_rate_pct, {pct('late', 'n')} as delay_rate_pct,
       cast(case when lifespan = 0 then n else n // nullif(lifespan, 0) end as bigint)
         as avg_monthly_shipments,
       {avg_money('c', 'ont')} as cost_per_on_time_delivery,
       case when {hundredths} >= 4000 then 'Critical' when {hundredths} >= 2500 then 'At Risk'
            when {hundredths} >= 1000 then 'Monitor' else 'Healthy' end as performance_tier,
       case when lifespan >= 18 and n > 100 then 'Strategic Partner'
            when lifespan >= 12 and n > 50 then 'Key Supplier'
            when lifespan >= 6 and n > 20 then 'Developing Supplier'
            else 'New / Low Volume' end as relationship_segment,
       case contract_tier when 'Platinum' then 'Strategic' when 'Gold' then 'Key Account'
            when 'Silver' then 'Standard' when 'Bronze' then 'Basic'
            else 'Unclassified' end as account_type
from (select *, {months('first', 'last')} as lifespan
      from ({grouped(keys, figures, 's', DATED)}) a) b"""


def _flat_shipments() -> str:
    return f"""
select *,
       cast(actual_date - order_date as integer) as actual_transit_days,
       cast(actual_date - promised_date as integer) as days_vs_promise,
       case when delay_days > 0 then shipment_cost else 0 end as delayed_shipment_cost,
       case when delay_days > 0 then product_value_usd else 0 end as product_value_at_risk,
       case when delay_days <= 0 then 'On Time' else 'Delayed' end as delivery_flag,
       {delay_case(TIERS, 'delay_days')} as delay_severity,
       {cost_case('shipment_cost')} as cost_band,
       case when u >= 900 then 'Critical Capacity' when u >= 750 then 'High Load'
            when u >= 500 then 'Moderate Load' else 'Normal Operations' end as warehouse_status,
       case when distance_km < 1000 then 'Short Haul'
            when distance_km between 1000 and 3000 then 'Medium Haul'
            when distance_km between 3001 and 7000 then 'Long Haul'
            else 'Ultra Haul' end as route_distance_band,
       case when delay_days > 0 and product_fragility = 'High' then 'High Risk — Fragile & Late'
            when delay_days > 0 and product_fragility = 'Medium' then 'Medium Risk — Delayed'
            when delay_days > 0 then 'Low Risk — Delayed' else 'No Risk — On Time' end
         as fragility_risk_flag
from (select f.shipment_key, f.shipment_id, f.order_date, f.promised_date, f.actual_date,
       coalesce(f.delay_days, 0) as delay_days, coalesce(trim(f.status), 'Unknown') as shipment_status,
       coalesce(f.shipment_cost, 0) as shipment_cost, coalesce(f.weight_kg, 0) as weight_kg,
       coalesce(f.quantity, 0) as quantity,
       s.supplier_key, coalesce(s.supplier_name, 'Unknown Supplier') as supplier_name,
       {unk('s.country')} as supplier_country, {unk('s.contract_tier')} as contract_tier,
       {unk('s.category')} as supplier_category,
       coalesce(cast(s.rating as varchar), 'Unrated') as supplier_rating,
       c.carrier_key, coalesce(c.carrier_name, 'Unknown Carrier') as carrier_name,
       {unk('c.transport_mode')} as transport_mode, coalesce(c.avg_cost_per_km, 0) as avg_cost_per_km,
       r.route_key, {unk('r.origin')} as route_origin, {unk('r.destination')} as route_destination,
       {unk('r.region')} as route_region, coalesce(r.distance_km, 0) as distance_km,
       cast(coalesce(r.avg_transit_days, 0) as smallint) as expected_transit_days,
       w.warehouse_key, {unk('w.location')} as warehouse_location, {unk('w.region')} as warehouse_region,
       coalesce(w.capacity, 0) as warehouse_capacity, coalesce(w.current_load, 0) as warehouse_load,
       {util_tenths('coalesce(w.current_load, 0)', 'w.capacity')} as u,
       p.product_key, coalesce(p.product_name, 'Unknown Product') as product_name,
       {unk('p.category')} as product_category, {unk('p.fragility')} as product_fragility,
       coalesce(p.value_usd, 0) as product_value_usd
      {FACT} {' '.join(join(a) for a in 'scrwp')} where {DATED}) base"""


REPORT_COLUMNS = """shipment_key shipment_id order_date promised_date actual_date delay_days
shipment_status shipment_cost weight_kg quantity supplier_key supplier_name supplier_country
contract_tier supplier_category supplier_rating carrier_key carrier_name transport_mode
avg_cost_per_km route_key route_origin route_destination route_region distance_km
expected_transit_days warehouse_key warehouse_location warehouse_region warehouse_capacity
warehouse_load warehouse_utilisation_pct product_key product_name product_category
product_fragility product_value_usd actual_transit_days days_vs_promise delayed_shipment_cost
product_value_at_risk delivery_flag delay_severity cost_band warehouse_status route_distance_band
fragility_risk_flag""".split()
REPORT_DOUBLES = {"shipment_cost", "weight_kg", "avg_cost_per_km", "product_value_usd",
                  "delayed_shipment_cost", "product_value_at_risk"}


def _reports() -> dict[str, str]:
    flat = _flat_shipments()
    picks = ", ".join(
        "cast(u as double) / 10 as warehouse_utilisation_pct" if c == "warehouse_utilisation_pct"
        else f"cast({c} as double) as {c}" if c in REPORT_DOUBLES else c
        for c in REPORT_COLUMNS)
    suppliers = _report_suppliers()
    by = "route_region, transport_mode, delay_severity"
    cents = "cast(shipment_cost * 100 as bigint)"
    late = "count(case when delay_days > 0 then 1 end)"
    return {
        "report_suppliers": suppliers,
        "report_shipments": f"select {picks} from ({flat}) flat",
        "publish_reports":
            "select 'report_suppliers' as report_name, count(*) as report_rows,"
            f" cast(sum(total_delayed) as bigint) as delayed from ({suppliers}) a"
            " union all select 'report_shipments', count(*),"
            f" count(*) filter (where delivery_flag = 'Delayed') from ({flat}) b",
        "drill_report":
            f"select {by}, count(shipment_key) as total_shipments, {late} as delayed_shipments,"
            f" {pct(late, 'count(shipment_key)')} as delay_rate_pct,"
            f" {money(f'sum({cents})')} as total_cost,"
            f" {money(f'sum(case when delay_days > 0 then {cents} else 0 end)')}"
            f" as cost_of_delayed_shipments from ({flat}) flat"
            f" where warehouse_status in ('Critical Capacity', 'High Load') group by {by}",
    }


def twins(tables: dict[str, str] = RAW) -> dict[str, str]:
    """SQL per id; ``tables`` gives the query behind each raw table."""
    raw = {**_loads(), "load_rejects": _rejects(), **_explore(), **_dates(), **_distribution(),
           "audit_before": _audit_before()}
    clean = {**_audits(), **_cleaned(), **_kpis(), **_rankings(), **_trends(), **_cumulative(),
             **_benchmarks(), **_segments(), **_shares(), **_reports()}
    return {
        **{name: with_star(text, False, tables) for name, text in raw.items()},
        **{name: with_star(text, True, tables) for name, text in clean.items()},
    }
