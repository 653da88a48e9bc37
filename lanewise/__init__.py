"""Shipment delivery-performance analytics on Spark DataFrames."""

from lanewise.sources.star import Star
from lanewise.operators.clean import clean_star

__all__ = ["Star", "clean_star"]
