"""Radius joins over a grid (an equi-join on cells and a residual distance test) and nearest joins by blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.maths import cell, square_distance
from . import blocks


def within_radius(left: DataFrame, right: DataFrame, radius: float, names=("x", "y", "z"), by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows no farther apart than radius, with their squared distance d2. Columns of `right` get the prefix r_.

    Cells are as wide as the radius; the right side is dealt to its cell and those around it, so each pair meets once.
    """
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    for a in names:
        left = left.withColumn(f"__c{a}", cell(a, radius))
        r = r.withColumn(f"__c{a}", F.explode(F.array(*[cell(f"r_{a}", radius) + k for k in (-1, 0, 1)])))
    on = [f"__c{a}" for a in names]
    for b in by:
        r = r.withColumnRenamed(f"r_{b}", b)
    both = left.join(r, [*on, *by]).drop(*on)
    d2 = square_distance([F.col(a) for a in names], [F.col(f"r_{a}") for a in names])
    return both.withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, k: int = 1, key: str = "id", names=("x", "y", "z"), skip_self: bool = False, most: float | None = None) -> DataFrame:
    """The k nearest rows of `right` to every row of `left`, with d2 and rank (1-based); ties by the smaller r_ key.

    Each block of rows keeps the k nearest (within `most`) of each block of `right`; no other pairs are made.
    """
    r, r_key = blocks.right(right), f"r_{key}"
    own, carry = tuple(c for c in left.columns if c != key), tuple(c for c in r.columns if c != r_key)
    form = StructType([StructField(f.name, f.dataType) for f in (*left.schema, *r.schema)]).add("d2", "double")
    found = blocks.meet(left, r, blocks.closest(k, math.inf if most is None else most, key, r_key, skip_self, names, own, carry), form, key, r_key, names)
    order = Window.partitionBy(key).orderBy("d2", r_key)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
