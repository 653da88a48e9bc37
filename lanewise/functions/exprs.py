"""Scalar column expressions shared by the operators.  All are built-ins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def blank(text: Column | str) -> Column:
    """True for NULL, empty and all-space text."""
    return F.trim(F.coalesce(_col(text), F.lit(""))) == ""


def fill_blank(text: Column | str, default: str) -> Column:
    return F.when(blank(text), F.lit(default)).otherwise(_col(text))


def title_case(text: Column | str) -> Column:
    """First letter upper, everything after it lower (not word by word)."""
    trimmed = F.trim(_col(text))
    return F.concat(F.upper(F.left(trimmed, F.lit(1))),
                    F.lower(F.substr(trimmed, F.lit(2))))


def unknown(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit("Unknown"))


def month_span(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed between two dates (31 Jan to 1 Feb is 1)."""
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def year_span(start: Column | str, end: Column | str) -> Column:
    """Year boundaries crossed between two dates."""
    return F.year(_col(end)) - F.year(_col(start))


def whole_division(num: Column, den: Column) -> Column:
    """Integer division, cut towards zero; NULL where the divisor is 0."""
    return F.call_function("div", num, F.nullif(den, F.lit(0)))


def quotient(num: Column, den: Column, times: int = 1) -> Column:
    """num * times / den as an exact decimal; NULL where the divisor is 0.

    Numerator and divisor may be any BIGINT.  The result keeps 14 decimals, so
    rounding to two places is exact for every divisor below 1e12.
    """
    top = num.cast("decimal(20,0)") * F.lit(times).cast("decimal(3,0)")
    return top / F.nullif(den, F.lit(0)).cast("decimal(20,0)")


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent, rounded half away from zero to two decimals."""
    return F.round(quotient(part, whole, 100), 2).cast("decimal(20,2)")


def cents(amount: Column | str) -> Column:
    """A two-decimal amount as BIGINT hundredths: sums stay in 8-byte buffers."""
    return (_col(amount) * 100).cast("bigint")


def from_cents(value: Column) -> Column:
    return (value.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(22,2)")


def average_from_cents(total: Column, count: Column) -> Column:
    """Average of a two-decimal amount, rounded half away to two decimals."""
    return from_cents(F.round(quotient(total, count), 0))


def utilisation(load: Column | str, capacity: Column | str) -> Column:
    """Load in percent of capacity, one decimal; NULL for no or zero capacity."""
    return F.round(quotient(_col(load), _col(capacity), 100), 1).cast("decimal(20,1)")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
