"""Labels, thresholds and text constants of the result contract.

The inner spacing of the bracketed labels is part of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lanewise.functions.exprs import _col

# --- fixed values -----------------------------------------------------------

DATA_ERROR = "Data Error"

SUPPLIER_TIERS = (
    (40, "Critical  (40%+ delay rate)"),
    (25, "At Risk   (25% - 39%)"),
    (10, "Monitor   (10% - 24%)"),
    (None, "Healthy   (Below 10%)"),
)

REPORT_SUPPLIER_TIERS = (
    (40, "Critical"),
    (25, "At Risk"),
    (10, "Monitor"),
    (None, "Healthy"),
)

QUARTER_RISK = (
    (35, "High Risk Quarter"),
    (25, "Elevated Risk Quarter"),
    (None, "Normal Quarter"),
)

WAREHOUSE_LOAD = (
    (90, "Critical  (90%+ capacity)"),
    (75, "High Load (75% - 89%)"),
    (50, "Moderate  (50% - 74%)"),
    (None, "Low Load  (Below 50%)"),
)

REPORT_WAREHOUSE_STATUS = (
    (90, "Critical Capacity"),
    (75, "High Load"),
    (50, "Moderate Load"),
    (None, "Normal Operations"),
)

# (at least months, more than shipments, label)
RELATIONSHIPS = (
    (18, 100, "Strategic Partner"),
    (12, 50, "Key Supplier"),
    (6, 20, "Developing Supplier"),
    (None, None, "New / Low Volume"),
)

# (lowest, highest, label); an amount between two bands falls to the last label
COST_BANDS = (
    (None, 500, "Low       (Below $500)"),
    (500, 1500, "Mid       ($500 - $1,500)"),
    (1501, 5000, "High      ($1,500 - $5,000)"),
    (5001, 10000, "Premium   ($5,000 - $10,000)"),
    (None, None, "Elite     (Above $10,000)"),
)

DISTANCE_BANDS = (
    (None, 1000, "Short Haul   (Below 1,000 km)"),
    (1000, 3000, "Medium Haul  (1,000 - 3,000 km)"),
    (3001, 7000, "Long Haul    (3,000 - 7,000 km)"),
    (None, None, "Ultra Haul   (Above 7,000 km)"),
)

REPORT_DISTANCE_BANDS = (
    (None, 1000, "Short Haul"),
    (1000, 3000, "Medium Haul"),
    (3001, 7000, "Long Haul"),
    (None, None, "Ultra Haul"),
)

# (most days late, label)
DELAY_TIERS = (
    (0, "On Time"),
    (3, "Minor     (1 - 3 days)"),
    (7, "Moderate  (4 - 7 days)"),
    (14, "Severe    (8 - 14 days)"),
    (None, "Critical  (15+ days)"),
)

DELAY_BUCKETS = (
    (0, "On Time"),
    (3, "1 - 3 Days Late"),
    (7, "4 - 7 Days Late"),
    (14, "8 - 14 Days Late"),
    (None, "Over 14 Days Late"),
)

QUARTILES = {
    1: "Critical — Immediate Action",
    2: "At Risk — Close Monitoring",
    3: "Acceptable — Standard Review",
    4: "Healthy — Best Practice",
}

ACCOUNT_TYPES = {
    "Platinum": "Strategic",
    "Gold": "Key Account",
    "Silver": "Standard",
    "Bronze": "Basic",
}
ACCOUNT_TYPE_OTHER = "Unclassified"

FRAGILITY_RISK = {
    "High": "High Risk — Fragile & Late",
    "Medium": "Medium Risk — Delayed",
}
FRAGILITY_RISK_OTHER = "Low Risk — Delayed"
FRAGILITY_NO_RISK = "No Risk — On Time"

# --- expressions over the tables above ---------------------------------------


def at_least(value: Column | str, steps) -> Column:
    """Label of the first step whose threshold the value reaches; NULL gets the last."""
    value = _col(value)
    return _chain([(value >= low, label) for low, label in steps[:-1]], steps[-1][1])


def at_most(value: Column | str, steps) -> Column:
    """Label of the first step whose upper bound covers the value."""
    value = _col(value)
    return _chain([(value <= high, label) for high, label in steps[:-1]], steps[-1][1])


def band(value: Column | str, bands, strict: bool = False) -> Column:
    """Label of the band holding the value.

    By default each band keeps its stated bounds, so 1500.50 lies between two
    bands and gets the last label.  ``strict`` closes those gaps upwards.
    """
    value = _col(value)
    first, *middle, last = bands
    tests = [(value < first[1], first[2])]
    for low, high, label in middle:
        tests.append((value <= high if strict else value.between(low, high), label))
    return _chain(tests, last[2])


def relationship(months: Column | str, shipments: Column | str) -> Column:
    months, shipments = _col(months), _col(shipments)
    return _chain(
        [((months >= m) & (shipments > n), label) for m, n, label in RELATIONSHIPS[:-1]],
        RELATIONSHIPS[-1][2],
    )


def lookup(value: Column | str, table: dict, other: str) -> Column:
    value = _col(value)
    return _chain([(value == key, label) for key, label in table.items()], other)


def _chain(tests, other: str) -> Column:
    head, *rest = tests
    out = F.when(head[0], F.lit(head[1]))
    for test, label in rest:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(other))
