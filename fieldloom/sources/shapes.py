"""Generated sources: shapes from seed points, constants, tuples and iterations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compare import col


def tuples(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)


def iterations(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "iteration")


def grid(seeds: DataFrame, nx: int, ny: int, nz: int = 1, step: float = 1.0) -> DataFrame:
    """An nx x ny x nz lattice centred on every seed (dataset_id, x, y, z)."""
    out = seeds
    for a, n in zip("xyz", (nx, ny, nz)):
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for a, n in zip("xyz", (nx, ny, nz)):
        out = out.withColumn(a, F.col(a) + (F.col(f"i{a}") - (n - 1) / 2) * step)
    return out


def circle(seeds: DataFrame, n, radius=1.0, start: float = 0.0, end: float = 360.0, closed: bool = True) -> DataFrame:
    """Points on an arc in degrees about every seed; a closed one doesn't repeat its first point."""
    n, radius = col(n).cast("int"), col(radius)
    span = F.lit(end - start) / F.when(F.lit(closed), n).otherwise(F.greatest(n - 1, F.lit(1)))
    out = seeds.withColumn("step", F.explode(F.sequence(F.lit(0), n - 1)))
    angle = F.radians(F.lit(start) + span * F.col("step"))
    return out.withColumn("x", F.col("x") + radius * F.cos(angle)).withColumn("y", F.col("y") + radius * F.sin(angle))


def polygon(seeds: DataFrame, sides: int, radius: float = 1.0, per_side: int = 1) -> DataFrame:
    """A regular polygon with per_side points on each side, from its first corner on."""
    out = seeds.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(sides * per_side - 1))))
    side, part = F.floor(F.col("step") / per_side), (F.col("step") % per_side) / per_side
    angle = 2 * math.pi / sides
    at = lambda f: f(side * angle) + (f((side + 1) * angle) - f(side * angle)) * part
    return out.withColumn("x", F.col("x") + at(F.cos) * radius).withColumn("y", F.col("y") + at(F.sin) * radius)


def phi_sphere(seeds: DataFrame, n: int, radius: float = 1.0) -> DataFrame:
    """A Fibonacci lattice of n points on a sphere about every seed."""
    golden = math.pi * (3 - math.sqrt(5))
    out = seeds.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    up = 1 - (F.col("step") * 2 + 1) / n
    flat = F.sqrt(1 - up * up)
    return (
        out.withColumn("x", F.col("x") + flat * F.cos(F.col("step") * golden) * radius)
        .withColumn("y", F.col("y") + flat * F.sin(F.col("step") * golden) * radius)
        .withColumn("z", F.col("z") + up * radius)
    )
