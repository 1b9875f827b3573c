"""Filters and row-wise blends over streams: the same columns that batch tables take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.blend import Blend, uber_blend
from ..functions.compare import all_of


def filtered(stream: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that pass a stack of filters, as they come."""
    return stream.where(all_of(*conditions))


def blended(stream: DataFrame, blends: list[Blend]) -> DataFrame:
    return uber_blend(stream, blends)
