"""Traps of the scalar rules, one small fixture each."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanewise.functions import exprs as x, labels


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_month_and_year_boundaries(spark):
    rows = [(date(2024, 1, 31), date(2024, 2, 1)), (date(2023, 12, 31), date(2024, 1, 1)),
            (date(2024, 1, 1), date(2024, 1, 31))]
    got = values(spark, rows, "a date, b date", x.month_span("a", "b"), x.year_span("a", "b"))
    assert got == [(1, 0), (1, 1), (0, 0)]


def test_title_case_keeps_later_words_lower(spark):
    rows = [("saudi ARABIA",), ("UAE",), (" turkey ",), ("x",)]
    assert values(spark, rows, "c string", x.title_case("c")) == [
        ("Saudi arabia",), ("Uae",), ("Turkey",), ("X",)]


def test_blank_means_spaces_only(spark):
    rows = [(None,), ("",), ("  ",), ("\t",), ("a",)]
    assert values(spark, rows, "c string", x.blank("c")) == [
        (True,), (True,), (True,), (False,), (False,)]


@pytest.mark.parametrize("strict, expected", [
    (False, ["Low", "Mid", "Elite", "High", "Elite", "Elite", "Elite"]),
    (True, ["Low", "Mid", "High", "High", "Premium", "Premium", "Elite"]),
])
def test_cost_between_two_bands(spark, strict, expected):
    amounts = ["499.99", "1500.00", "1500.50", "1501.00", "5000.50", "5000.99", "10000.01"]
    rows = [(Decimal(a),) for a in amounts]
    got = values(spark, rows, "c decimal(12,2)", labels.band("c", labels.COST_BANDS, strict))
    assert [g[0].split()[0] for g in got] == expected


def test_unknown_utilisation_is_low_load(spark):
    rows = [(10, None), (10, 0), (None, 10), (95, 100)]
    used = x.utilisation("load", "capacity")
    got = values(spark, rows, "load int, capacity int", used,
                 labels.at_least(used, labels.WAREHOUSE_LOAD))
    assert [g[0] for g in got] == [None, None, None, Decimal("95.0")]
    assert [g[1].split()[0] for g in got] == ["Low", "Low", "Low", "Critical"]


def test_whole_division(spark):
    rows = [(7, 2), (-7, 2), (7, 0)]
    got = values(spark, rows, "a bigint, b bigint", x.whole_division(F.col("a"), F.col("b")))
    assert got == [(3,), (-3,), (None,)]


def test_true_halves_round_away_from_zero(spark):
    rows = [(1, 800), (1, 3), (5, 0), (3, 800)]
    got = values(spark, rows, "a bigint, b bigint", x.percentage(F.col("a"), F.col("b")))
    assert got == [(Decimal("0.13"),), (Decimal("33.33"),), (None,), (Decimal("0.38"),)]


def test_average_of_money(spark):
    rows = [(201, 2), (199, 2), (None, 0)]  # 1.005 and 0.995
    got = values(spark, rows, "c bigint, n bigint", x.average_from_cents(F.col("c"), F.col("n")))
    assert got == [(Decimal("1.01"),), (Decimal("1.00"),), (None,)]


def test_large_sums_stay_exact(spark):
    rows = [(9_000_000_000_000_000_003, 2)]
    got = values(spark, rows, "c bigint, n bigint", x.from_cents(F.col("c")),
                 x.average_from_cents(F.col("c"), F.col("n")))
    assert got == [(Decimal("90000000000000000.03"), Decimal("45000000000000000.02"))]
    rows = [(4_500_000_000_000_000_000, 9_000_000_000_000_000_000)]
    got = values(spark, rows, "a bigint, b bigint", x.percentage(F.col("a"), F.col("b")))
    assert got == [(Decimal("50.00"),)]
