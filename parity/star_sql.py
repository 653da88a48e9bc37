"""The derived star and its clean layer as common table expressions."""

from __future__ import annotations


def blank(c: str) -> str:
    return f"trim(coalesce({c}, '')) = ''"


def filled(c: str, default: str) -> str:
    return f"case when {blank(c)} then '{default}' else {c} end"


def title(c: str) -> str:
    text = f"({filled(c, 'Unknown')})"
    return f"upper(left(trim({text}), 1)) || lower(substring(trim({text}), 2))"


def scaled(n: str, factor: str, kind: str) -> str:
    places = len(factor.split(".")[1])
    return (f"cast(cast({n} as decimal(12,0)) * cast({factor} as decimal({places + 1},{places}))"
            f" as {kind})")


RAW = {
    "ref_suppliers": f"""
select s_suppkey as supplier_key,
       concat('SUP-', cast(s_suppkey as varchar)) as supplier_id,
       case when s_suppkey % 31 = 7 then null when s_suppkey % 37 = 9 then ' ' else s_name end
         as supplier_name,
       case when s_suppkey % 23 = 5 then null when s_suppkey % 29 = 6 then ' '
            when s_suppkey % 7 = 3 then lower(n_name) else n_name end as country,
       case when s_suppkey % 19 = 8 then null
            else concat('CAT-', cast(s_suppkey % 10 as varchar)) end as category,
       case s_suppkey % 5 when 0 then 'Bronze' when 1 then 'Silver' when 2 then 'Gold'
            when 3 then 'Platinum' else '' end as contract_tier,
       case when s_suppkey % 13 = 4 then null
            else {scaled("s_suppkey * 7 % 36 + 15", "0.1", "decimal(3,1)")} end as rating,
       case when s_suppkey % 41 = 9 then null
            else cast(date '2012-01-01' + cast(s_suppkey * 37 % 4000 as integer) as date) end
         as onboarded_date,
       case when s_suppkey % 17 = 2 then ' ' when s_suppkey % 9 = 0 then 'Inactive'
            when s_suppkey % 10 = 1 then 'Suspended' else 'Active' end as status
from supplier left join nation on s_nationkey = n_nationkey""",
    "ref_carriers": f"""
select c_custkey as carrier_key,
       concat('CAR-', cast(c_custkey as varchar)) as carrier_id,
       case when c_custkey % 15 = 4 then null else c_name end as carrier_name,
       case when c_custkey % 17 = 2 then ' ' when c_custkey % 5 = 1 then lower(c_mktsegment)
            else c_mktsegment end as transport_mode,
       case when c_custkey % 11 = 3 then null
            else {scaled("5000 + c_custkey * 79 % 4800", "0.01", "decimal(5,2)")} end as on_time_rate,
       case when c_custkey % 12 = 5 then null
            else {scaled("4000 + c_custkey * 1531 % 86000", "0.0001", "decimal(8,4)")} end
         as avg_cost_per_km,
       case when c_custkey % 30 = 7 then ' ' else r_name end as coverage_region,
       case when c_custkey % 13 = 1 then null when c_custkey % 6 = 0 then 'Inactive'
            else 'Active' end as status
from customer left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey""",
    "ref_routes": """
select k as route_key, concat('RTE-', cast(k as varchar)) as route_id,
       case when k % 29 = 4 then null else from_name end as origin,
       case when k % 31 = 5 then ' ' else to_name end as destination,
       case when k % 37 = 6 then null else r_name end as region,
       case when k % 19 = 3 then null else cast(300 + k * 97 % 13500 as integer) end as distance_km,
       case when k % 23 = 2 then null else cast(1 + k % 22 as smallint) end as avg_transit_days
from (select distinct cast(s_nationkey as bigint) * 4294967296 + c_nationkey as k,
             s_nationkey, c_nationkey
      from lineitem join orders on l_orderkey = o_orderkey
      join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey) used
join (select n_nationkey as from_key, n_name as from_name, n_regionkey from nation) a
  on from_key = s_nationkey
join (select n_nationkey as to_key, n_name as to_name from nation) b on to_key = c_nationkey
left join region on n_regionkey = r_regionkey""",
    "ref_warehouses": f"""
select cast(n_nationkey as bigint) as warehouse_key,
       concat('WH-', cast(n_nationkey as varchar)) as warehouse_id,
       case when n_nationkey % 20 = 17 then null else concat(n_name, ' DEPOT') end as location,
       n_name as country,
       case when n_nationkey = 3 then ' ' else r_name end as region,
       case when n_nationkey % 13 = 9 then null else 10000 + n_nationkey * 2791 end as capacity,
       case when n_nationkey = 20 then null
            else cast((10000 + n_nationkey * 2791) * (40 + n_nationkey * 7 % 66) // 100 as integer)
       end as current_load,
       {scaled("3 + n_nationkey * 11 % 52", "0.1", "decimal(4,1)")} as processing_time_avg
from nation left join region on n_regionkey = r_regionkey""",
    "ref_products": f"""
select p_partkey as product_key,
       concat('PRD-', cast(p_partkey as varchar)) as product_id,
       case when p_partkey % 27 = 1 then null when p_partkey % 28 = 2 then ' ' else p_name end
         as product_name,
       case when p_partkey % 25 = 3 then ' ' else p_type end as category,
       case when p_partkey % 23 = 4 then null
            else {scaled("100 + p_partkey * 7919 % 350000", "0.01", "decimal(10,2)")} end as weight_kg,
       case when p_partkey % 18 = 5 then null when p_size <= 15 then 'Low'
            when p_size <= 35 then 'Medium' else 'High' end as fragility,
       case when p_partkey % 11 = 6 then null else cast(p_retailprice as decimal(12,2)) end
         as value_usd
from part""",
    "fact_shipments": f"""
select l_orderkey * 10 + l_linenumber as shipment_key,
       concat('SHP-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as shipment_id,
       l_suppkey as supplier_key,
       case when h % 3 = 0 then 7 when u % 31 = 0 then -1 - u % customers
            else 1 + u % customers end as carrier_key,
       cast(s_nationkey as bigint) * 4294967296 + c_nationkey as route_key,
       cast(c_nationkey as bigint) as warehouse_key,
       l_partkey as product_key,
       case when h = 499 then null else d0 end as order_date,
       cast(d0 + win as date) as promised_date,
       case when h % 25 = 24 then null when h % 200 = 7 then cast(d0 - 2 as date)
            else cast(d0 + (win + dl) as date) end as actual_date,
       case when h % 50 = 11 then null when h % 40 = 13 then ' ' when h < 290 then 'Delayed'
            else 'Delivered' end as status,
       case when h % 25 = 24 or h % 30 = 17 then null else dl end as delay_days,
       case when h % 33 = 20 then null
            else {scaled("cast(round(l_extendedprice * 100) as bigint) % 1500000", "0.01", "decimal(12,2)")}
       end as shipment_cost,
       case when h % 45 = 21 then null
            else {scaled("100 + l_partkey * 7919 % 350000", "0.01", "decimal(10,2)")} end as weight_kg,
       case when h % 60 = 31 then null else cast(l_quantity as integer) end as quantity
from (select *, cast(3 + h % 18 as integer) as win,
             cast(case when h < 290 then 1 + h % 25 else -(h % 4) end as integer) as dl
      from (select *,
                   (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 3) % 1000 as h,
                   l_orderkey * 7 + l_partkey * 13 + l_linenumber as u,
                   (select max(c_custkey) from customer) as customers,
                   cast(l_shipdate as date) as d0
            from lineitem left join orders on l_orderkey = o_orderkey
            left join customer on o_custkey = c_custkey
            left join supplier on l_suppkey = s_suppkey) numbered) drawn""",
}

CLEAN = {
    "ref_suppliers": f"""
select supplier_key, supplier_id, {filled('supplier_name', 'Unknown Supplier')} as supplier_name,
       {title('country')} as country, {filled('category', 'Unknown')} as category,
       {filled('contract_tier', 'Unknown')} as contract_tier,
       coalesce(rating, cast(0 as decimal(3,1))) as rating, onboarded_date,
       {filled('status', 'Unknown')} as status
from raw_ref_suppliers""",
    "ref_carriers": f"""
select carrier_key, carrier_id, {filled('carrier_name', 'Unknown Carrier')} as carrier_name,
       {title('transport_mode')} as transport_mode,
       coalesce(on_time_rate, cast(0 as decimal(5,2))) as on_time_rate,
       coalesce(avg_cost_per_km, cast(0 as decimal(8,4))) as avg_cost_per_km,
       {filled('coverage_region', 'Unknown')} as coverage_region,
       {filled('status', 'Unknown')} as status
from raw_ref_carriers""",
    "ref_routes": f"""
select route_key, route_id, {filled('origin', 'Unknown')} as origin,
       {filled('destination', 'Unknown')} as destination, {filled('region', 'Unknown')} as region,
       coalesce(distance_km, 0) as distance_km,
       cast(coalesce(avg_transit_days, 0) as smallint) as avg_transit_days
from raw_ref_routes""",
    "ref_warehouses": "select * from raw_ref_warehouses",
    "ref_products": f"""
select product_key, product_id, {filled('product_name', 'Unknown Product')} as product_name,
       {filled('category', 'Unknown')} as category,
       coalesce(weight_kg, cast(0 as decimal(10,2))) as weight_kg,
       {filled('fragility', 'Unknown')} as fragility,
       coalesce(value_usd, cast(0 as decimal(12,2))) as value_usd
from raw_ref_products""",
    "fact_shipments": f"""
select shipment_key, shipment_id, supplier_key, carrier_key, route_key, warehouse_key, product_key,
       order_date, promised_date, actual_date,
       case when actual_date < order_date then 'Data Error' when {blank('status')} then 'Unknown'
            else status end as status,
       coalesce(delay_days, cast(actual_date - promised_date as integer)) as delay_days,
       coalesce(shipment_cost, cast(0 as decimal(12,2))) as shipment_cost,
       coalesce(weight_kg, cast(0 as decimal(10,2))) as weight_kg,
       coalesce(quantity, 0) as quantity
from raw_fact_shipments""",
}

_DIMENSIONS = {
    "s": ("ref_suppliers", "supplier_key"),
    "c": ("ref_carriers", "carrier_key"),
    "r": ("ref_routes", "route_key"),
    "w": ("ref_warehouses", "warehouse_key"),
    "p": ("ref_products", "product_key"),
}


def join(alias: str) -> str:
    table, key = _DIMENSIONS[alias]
    return f"left join {table} {alias} on {alias}.{key} = f.{key}"


def with_star(query: str, clean: bool, raw: dict[str, str] = RAW) -> str:
    """The query over the raw or the clean tables; the facts carry cents too."""
    parts = [f"raw_{name} as ({body})" for name, body in raw.items()]
    for name in RAW:
        body = CLEAN[name] if clean else f"select * from raw_{name}"
        if name == "fact_shipments":
            body = ("select *, cast(shipment_cost * 100 as bigint) as cost_c,"
                    f" cast(weight_kg * 100 as bigint) as weight_c from ({body}) rows_")
        parts.append(f"{name} as ({body})")
    return "with " + ",\n".join(parts) + "\n" + query
