"""Tensor fields: directions from effectors, sampled at points and followed for a number of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

XYZ = ("x", "y", "z")


def sample(points: DataFrame, effectors: DataFrame, radius: float, kind: str = "flow", key: str = "id") -> DataFrame:
    """(key, vx, vy, vz, pings): the sum of the effectors' directions within a radius, weighed by 1 - d2 / radius2.

    flow: the effector's own direction (dx, dy, dz); pole: toward the effector; spin: about its direction. Points
    without effectors are absent.
    """
    if kind not in ("flow", "pole", "spin"):
        raise ValueError(f"no tensor {kind!r}")
    e = effectors.select(*XYZ, *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in XYZ])
    form = f"{key} {points.schema[key].dataType.simpleString()}, pings long, vx double, vy double, vz double"
    got = blocks.meet(points.select(key, *XYZ), blocks.right(e), blocks.directions(radius, key, kind), form, key, "r_x")
    return got.groupBy(key).agg(*[F.sum(f"v{a}").alias(f"v{a}") for a in XYZ], F.sum("pings").alias("pings"))


def constant(df: DataFrame, way: tuple[float, float, float]) -> DataFrame:
    return df.withColumns({f"v{a}": F.lit(float(w)) for a, w in zip(XYZ, way)})


def dot(way: tuple[float, float, float]) -> Column:
    return F.col("vx") * way[0] + F.col("vy") * way[1] + F.col("vz") * way[2]


def transform(points: DataFrame, effectors: DataFrame, radius: float, step: float, rounds: int, kind: str = "flow", key: str = "id") -> DataFrame:
    """Points carried along a field: x, y, z, traveled, updates and whether they stopped for want of effectors."""
    from .graph import settle

    state = points.select(key, *XYZ).withColumn("traveled", F.lit(0.0)).withColumn("updates", F.lit(0).cast("long")).withColumn("stopped", F.lit(False))
    for _ in range(rounds):
        got = sample(state.where("not stopped"), effectors, radius, kind, key)
        x = state.join(got, key, "left")
        move = F.col("pings").isNotNull()
        length = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")) * step
        x = x.withColumns({a: F.when(move, F.col(a) + F.col(f"v{a}") * step).otherwise(F.col(a)) for a in XYZ} | {"traveled": F.when(move, F.col("traveled") + length).otherwise(F.col("traveled")), "updates": F.col("updates") + move.cast("long"), "stopped": ~move})
        state = settle(x.select(state.columns))
    return state


def relax(edges: DataFrame, vertices: DataFrame, rounds: int, influence: float = 1.0, key: str = "id") -> DataFrame:
    """Vertices moved toward the mean of their neighbours, a number of times."""
    from .graph import both_ways, settle

    links, at = settle(both_ways(edges.select("src", "dst"))), vertices.select(key, *XYZ)
    for _ in range(rounds):
        other = at.select(F.col(key).alias("other"), *[F.col(a).alias(f"o{a}") for a in XYZ])
        mean = links.join(other, "other").groupBy(F.col("node").alias(key)).agg(*[F.avg(f"o{a}").alias(f"o{a}") for a in XYZ])
        x = at.join(mean, key, "left")
        at = settle(x.select(key, *[(F.col(a) + F.coalesce(F.col(f"o{a}") - F.col(a), F.lit(0.0)) * influence).alias(a) for a in XYZ]))
    return at
