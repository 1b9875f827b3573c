"""Probes: edges between points by neighbourhood rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import meet
from .graph import canonical, settle
from .rangejoin import nearest, within_radius

XYZ = ("x", "y", "z")


def _edges(pairs: DataFrame, key: str) -> DataFrame:
    return canonical(pairs.select(F.col(key).alias("src"), F.col(f"r_{key}").alias("dst")))


def knn(points: DataFrame, k: int, mutual: bool = False, key: str = "id", names=XYZ) -> DataFrame:
    """Edges from every point to its k nearest, of either end's choice or of both; ties by the smaller key."""
    x = nearest(points.select(key, *names), points.select(key, *names), k, key, names, skip_self=True).select(F.col(key).alias("src"), F.col(f"r_{key}").alias("dst"))
    if not mutual:
        return canonical(x)
    n = x.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.where("n = 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def closest(points: DataFrame, k: int, radius: float, key: str = "id") -> DataFrame:
    """Edges from every point to at most k others within a radius."""
    p = points.select(key, *XYZ)
    near = meet(p, blocks.right(p), blocks.closest(k, radius, key, f"r_{key}", True), f"{blocks.keys(p, p, key)}, d2 double", key, f"r_{key}")
    w = Window.partitionBy(key).orderBy("d2", f"r_{key}")
    return _edges(near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k), key)


def dbscan(points: DataFrame, radius: float, least: int, border: str = "nearest", key: str = "id") -> DataFrame:
    """Edges between core points (at least `least` others within the radius), and from border points to their nearest core
    or to all."""
    p = points.select(key, *XYZ)
    core = settle(blocks.neighbours(p, radius, key).where(F.col("n") >= least).select(key))
    inside, outside = settle(p.join(core, key, "left_semi")), p.join(core, key, "left_anti")
    k = 1 if border == "nearest" else None
    outer = meet(outside, blocks.right(inside), blocks.closest(k, radius, key, f"r_{key}", False), f"{blocks.keys(p, p, key)}, d2 double", key, f"r_{key}")
    if border == "nearest":
        outer = outer.groupBy(key).agg(F.min_by(f"r_{key}", F.struct("d2", f"r_{key}")).alias(f"r_{key}"))
    return blocks.pairs(inside, radius, key).union(outer.select(F.least(key, f"r_{key}").alias("src"), F.greatest(key, f"r_{key}").alias("dst")))


def theta(points: DataFrame, cones: int, radius: float, yao: bool = False, key: str = "id") -> DataFrame:
    """Per point and cone in the plane, an edge to the point that is nearest along the cone's axis (or, Yao, at all)."""
    p = points.select(key, *XYZ)
    near = meet(p, blocks.right(p), blocks.coned(cones, radius, yao, key, f"r_{key}"), f"{blocks.keys(p, p, key)}, cone int, score double", key, f"r_{key}")
    return _edges(near.groupBy(key, "cone").agg(F.min_by(f"r_{key}", F.struct("score", f"r_{key}")).alias(f"r_{key}")), key)


def direction(points: DataFrame, way: tuple[float, ...], least_dot: float, radius: float, key: str = "id") -> DataFrame:
    """An edge to the nearest point whose direction agrees with a given one."""
    p = points.select(key, *XYZ)
    near = meet(p, blocks.right(p), blocks.directed(way, least_dot, radius, key, f"r_{key}"), f"{blocks.keys(p, p, key)}, d2 double", key, f"r_{key}")
    return _edges(near.groupBy(key).agg(F.min_by(f"r_{key}", F.struct("d2", f"r_{key}")).alias(f"r_{key}")), key)


def anisotropic(points: DataFrame, scale: tuple[float, ...], k: int, key: str = "id") -> DataFrame:
    """k nearest after stretching the axes."""
    return knn(points.select(key, *[(F.col(a) * s).alias(a) for a, s in zip(XYZ, scale)]), k, False, key)


def gradient_flow(points: DataFrame, v: str, radius: float, key: str = "id", uphill: bool = True) -> DataFrame:
    """A directed edge to the neighbour within a radius whose value rises (or falls) most."""
    p = points.select(key, *XYZ, F.col(v).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    up = meet(p, blocks.right(p), blocks.steepest(radius, 1 if uphill else -1, key, f"r_{key}"), f"{blocks.keys(p, p, key)}, rise double", key, f"r_{key}")
    return up.groupBy(F.col(key).alias("src")).agg(F.min_by(f"r_{key}", F.struct(-F.col("rise"), F.col(f"r_{key}"))).alias("dst"))


def level_set(points: DataFrame, v: str, most: float, radius: float, key: str = "id") -> DataFrame:
    """Edges within a radius between points of like value."""
    return blocks.pairs(points, radius, key, F.col(v), most)


def numeric_compare(points: DataFrame, compare, radius: float, key: str = "id") -> DataFrame:
    """Edges within a radius where compare(row, other) holds; `other` columns have the prefix r_."""
    near = within_radius(points, points, radius)
    return _edges(near.where((F.col(key) != F.col(f"r_{key}")) & compare), key)


def chain(points: DataFrame, order: str, by: str = "dataset_id", key: str = "id", closed: bool = False) -> DataFrame:
    """Edges between successors in an order."""
    w = Window.partitionBy(by).orderBy(order, key)
    x = points.withColumn("dst", F.lead(key).over(w))
    if closed:
        x = x.withColumn("dst", F.coalesce("dst", F.first(key).over(w)))
    return x.where(F.col("dst").isNotNull() & (F.col("dst") != F.col(key))).select(F.col(key).alias("src"), "dst")


def by_index(points: DataFrame, index, by: str = "dataset_id", key: str = "id") -> DataFrame:
    """Edges to the point of the same dataset at an index."""
    t = points.select(by, F.col("idx").alias("__i"), F.col(key).alias("dst"))
    return points.withColumn("__i", index).join(t, [by, "__i"]).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst")


def hub_and_spoke(points: DataFrame, hubs: DataFrame, key: str = "id") -> DataFrame:
    """An edge from every point that is no hub to its nearest hub."""
    spokes = points.join(hubs.select(key), key, "left_anti")
    return nearest(spokes.select(key, *XYZ), hubs.select(key, *XYZ), 1, key).select(F.col(key).alias("src"), F.col(f"r_{key}").alias("dst"))
