"""All analyses by id, each a function of a star.

``RAW`` run on the tables as loaded, ``CLEAN`` on the cleaned tables;
``CLEANING`` gives the cleaned tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from lanewise.operators import (
    audit, benchmark, cumulative, dates, distribution, explore, kpi, ranking, reports, segment,
    share, trend,
)
from lanewise.sources.star import Star

Analysis = Callable[[Star], DataFrame]

RAW: dict[str, Analysis] = {
    "ex_row_counts": explore.row_counts,
    "ex_profile": explore.profile,
    **{name: partial(explore.listing, name=name) for name in explore.LISTINGS},
    "ex_suppliers_missing_name": explore.suppliers_missing_name,
    "ex_shipments_missing_status": explore.shipments_missing_status,
    "ex_missing_actual_date": explore.missing_actual_date,
    "ex_delay_not_calculated": explore.delay_not_calculated,
    "dt_order_span": dates.order_span,
    "dt_delivery_span": dates.delivery_span,
    "dt_promised_window": dates.promised_window,
    "dt_actual_transit": dates.actual_transit,
    "dt_supplier_span": dates.supplier_span,
    "dt_yearly_volume": dates.yearly_volume,
    "dt_impossible_dates": dates.impossible_dates,
    "dt_promised_before_ordered": dates.promised_before_ordered,
    "dt_missing_actual": dates.missing_actual,
    "vc_supplier_country": distribution.by_supplier_country,
    "vc_supplier_category": distribution.by_supplier_category,
    "vc_supplier_tier": distribution.by_supplier_tier,
    "vc_mode_cost": distribution.by_mode,
    "vc_coverage_region": distribution.by_coverage_region,
    "vc_route_region": distribution.by_route_region,
    "vc_warehouse": distribution.by_warehouse,
    "vc_product_category": distribution.by_product_category,
    "vc_fragility": distribution.by_fragility,
    "vc_status": distribution.by_status,
    "vc_delay_bucket": distribution.by_delay_bucket,
    "vc_tier_cost": distribution.tier_cost,
    "vc_mode_cost_range": distribution.mode_cost_range,
    "audit_before": audit.before,
}

CLEANING: dict[str, Analysis] = {
    "clean_suppliers": lambda star: star.table("ref_suppliers"),
    "clean_carriers": lambda star: star.table("ref_carriers"),
    "clean_routes": lambda star: star.table("ref_routes"),
    "clean_products": lambda star: star.table("ref_products"),
    "clean_shipments": lambda star: star.table("fact_shipments"),
}

CLEAN: dict[str, Analysis] = {
    "confirm_suppliers": audit.confirm_suppliers,
    "confirm_carriers": audit.confirm_carriers,
    "confirm_routes": audit.confirm_routes,
    "confirm_products": audit.confirm_products,
    "confirm_shipments": audit.confirm_shipments,
    "audit_after": audit.after,
    "kpi_total_shipments": kpi.total_shipments,
    "kpi_on_time": kpi.on_time,
    "kpi_delayed": kpi.delayed,
    "kpi_otd_rate": kpi.on_time_rate,
    "kpi_avg_delay": kpi.average_delay,
    "kpi_total_cost": kpi.total_cost,
    "kpi_avg_cost": kpi.average_cost,
    "kpi_total_weight": kpi.total_weight,
    "kpi_active_suppliers": kpi.active_suppliers,
    "kpi_registered_suppliers": kpi.registered_suppliers,
    "kpi_carriers_used": kpi.carriers_used,
    "kpi_routes_used": kpi.routes_used,
    "kpi_warehouses_used": kpi.warehouses_used,
    "kpi_product_categories": kpi.product_categories,
    "kpi_report": kpi.report,
    "rk_worst_suppliers_top5": ranking.worst_suppliers,
    "rk_suppliers_rank10": ranking.suppliers,
    "rk_best_suppliers_top5": ranking.best_suppliers,
    "rk_carriers": ranking.carriers,
    "rk_routes_rank10": ranking.routes,
    "rk_warehouses_rank5": ranking.warehouses,
    "rk_supplier_quartiles": ranking.supplier_quartiles,
    "rk_product_exposure": ranking.product_exposure,
    "ts_month_parts": trend.by_year_and_month,
    "ts_month_trunc": trend.by_month,
    "ts_month_label": trend.by_month_label,
    "ts_quarter": trend.by_quarter,
    "ts_year": trend.by_year,
    "ts_mom_delay": trend.month_over_month,
    "ts_year_mode": trend.by_year_and_mode,
    "ts_year_region": trend.by_year_and_region,
    "cu_month_cost": cumulative.monthly_cost,
    "cu_month_delayed": cumulative.monthly_delayed,
    "cu_year_cost": cumulative.yearly_cost,
    "cu_month_on_time": cumulative.monthly_on_time,
    "cu_year_delay_cost": cumulative.yearly_delay_cost,
    "yoy_supplier_delay": benchmark.supplier_delay,
    "yoy_carrier_otd": benchmark.carrier_on_time,
    "yoy_region_cost": benchmark.region_cost,
    "yoy_warehouse_delay": benchmark.warehouse_delay,
    "sg_supplier_tiers": segment.supplier_tiers,
    "sg_cost_bands": segment.cost_bands,
    "sg_delay_tiers": segment.delay_tiers,
    "sg_supplier_relationship": segment.supplier_relationship,
    "sg_warehouse_load": segment.warehouse_load,
    "sg_route_distance": segment.route_distance,
    "pw_country_volume": share.country_volume,
    "pw_mode_cost": share.mode_cost,
    "pw_region_delays": share.region_delays,
    "pw_product_cost": share.product_cost,
    "pw_warehouse_volume": share.warehouse_volume,
    "pw_tier_cost": share.tier_cost,
    "report_suppliers": reports.suppliers,
    "report_shipments": reports.shipments,
}
