"""Paths against points, boxes and other paths: projections on segments, insertion, bevels, stitching, splines, fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import numeric
from .blocks import forest, meet, nearest_segments, right
from .graph import components
from .paths import XYZ, neighbour, properties, size


def _long_segments(path: DataFrame, closed: bool) -> DataFrame:
    """Segments with their start's distance along the path and the path's length."""
    x = properties(path, closed).withColumns({f"to_{a}": neighbour(a, 1, closed) for a in XYZ})
    x = x.withColumn("path_length", F.col("distance_to_start") + F.col("distance_to_end"))
    return x.where("to_x is not null").select("path_id", "idx", *XYZ, "to_x", "to_y", "to_z", "distance_to_start", "distance_to_next", "path_length")


def nearest_segment(points: DataFrame, path: DataFrame, radius: float, key: str = "id", closed: bool = False) -> DataFrame:
    """(key, path_id, idx, t, distance, time): of the segments within a radius of each point, the nearest (ties to the
    smaller path and index), where on it, and the share of the path's length there.

    No rows are made for pairs: each block of points keeps the nearest segment of each block of segments.
    """
    s = _long_segments(path, closed)
    s = s.select([F.col(c).alias(f"r_{c}") for c in s.columns])
    kind = s.schema["r_path_id"].dataType.simpleString()
    middle = [(F.col(f"r_{a}") + F.col(f"r_to_{a}")) / 2 for a in XYZ]
    form = f"{key} {points.schema[key].dataType.simpleString()}, r_path_id {kind}, r_idx long, r_distance_to_start double, r_distance_to_next double, r_path_length double, t double, distance double"
    x = meet(points.select(key, *XYZ), s.withColumn("r_idx", F.col("r_idx").cast("long")), nearest_segments(radius, key), form, key, "r_idx", at=middle)
    time = F.coalesce((F.col("r_distance_to_start") + F.col("t") * F.col("r_distance_to_next")) / F.nullif("r_path_length", F.lit(0.0)), F.lit(0.0))
    best = F.min_by(F.struct(F.col("r_path_id").alias("path_id"), F.col("r_idx").alias("idx"), "t", "distance", time.alias("time")), F.struct("distance", "r_path_id", "r_idx"))
    return x.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def time_filter(points: DataFrame, path: DataFrame, radius: float, op: str, share: float, key: str = "id") -> DataFrame:
    """Points whose place along the nearest path passes; points without one don't."""
    return points.join(nearest_segment(points, path, radius, key).where(numeric("time", op, share)).select(key), key, "left_semi")


def insert(path: DataFrame, points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """(path_id, place, x, y, z): the path's points at whole places, and each point within the radius between the ends of
    its nearest segment."""
    found = nearest_segment(points, path, radius, key)
    put = points.select(key, *XYZ).join(found, key).select("path_id", (F.col("idx") + F.col("t")).alias("place"), *XYZ)
    return path.select("path_id", F.col("idx").cast("double").alias("place"), *XYZ).unionByName(put)


def bevel(df: DataFrame, width: float, closed: bool = False) -> DataFrame:
    """Inner points replaced by two, at most `width` (and half a segment) away along the segments before and after."""
    before, after = ({a: neighbour(a, k, closed) for a in XYZ} for k in (-1, 1))
    x = df.withColumns({f"b{a}": before[a] for a in XYZ} | {f"n{a}": after[a] for a in XYZ})

    def toward(p):
        way = [F.col(f"{p}{a}") - F.col(a) for a in XYZ]
        far = size(way)
        share = F.coalesce(F.least(F.lit(width) / F.nullif(far, F.lit(0.0)), F.lit(0.5)), F.lit(0.0))
        return F.struct(*[(F.col(a) + v * share).alias(a) for a, v in zip(XYZ, way)])

    inner = F.col("bx").isNotNull() & F.col("nx").isNotNull()
    own = F.struct(*[F.col(a) for a in XYZ])
    x = x.withColumn("__p", F.when(inner, F.array(toward("b"), toward("n"))).otherwise(F.array(own)))
    rest = [c for c in df.columns if c not in XYZ]
    return x.select(*rest, F.posexplode("__p").alias("part", "__q")).select(*rest, F.col("part").cast("long").alias("part"), "__q.*")


def stitch(df: DataFrame, tolerance: float) -> DataFrame:
    """(path_id, stitched_id): paths whose ends lie within a tolerance of each other share the least path's id. Each pair of
    blocks of ends gives as few links as join its paths."""
    ends = df.groupBy("path_id").agg(*[f(F.struct("idx", *XYZ)).alias(n) for n, f in (("a", F.min), ("b", F.max))])
    p = ends.select("path_id", F.explode(F.array("a", "b")).alias("e")).select("path_id", *[F.col(f"e.{a}").alias(a) for a in XYZ])
    kind = p.schema["path_id"].dataType.simpleString()
    near = meet(p, right(p), forest(tolerance, "path_id", "r_path_id"), f"src {kind}, dst {kind}", "path_id", "r_path_id")
    return ends.select("path_id").join(components(near).withColumnRenamed("node", "path_id"), "path_id", "left").select("path_id", F.coalesce("component", "path_id").alias("stitched_id"))


def spline(df: DataFrame, steps: int) -> DataFrame:
    """Points on cubic curves through a path's points, with half the vector from the last to the next point as tangents:
    `steps` for each segment, from its start on."""
    tangent = {a: (F.coalesce(neighbour(a, 1), F.col(a)) - F.coalesce(neighbour(a, -1), F.col(a))) / 2 for a in XYZ}
    x = df.withColumns({f"t{a}": tangent[a] for a in XYZ})
    x = x.withColumns({f"n{a}": neighbour(a, 1) for a in XYZ} | {f"u{a}": neighbour(f"t{a}", 1) for a in XYZ}).where("nx is not null")
    x = x.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    t = F.col("step") / steps
    h = (2 * t * t * t - 3 * t * t + 1, t * t * t - 2 * t * t + t, 3 * t * t - 2 * t * t * t, t * t * t - t * t)
    return x.select("path_id", "idx", "step", *[(F.col(a) * h[0] + F.col(f"t{a}") * h[1] + F.col(f"n{a}") * h[2] + F.col(f"u{a}") * h[3]).alias(a) for a in XYZ])


def box_crossings(df: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """(path_id, idx, enter, leave): where segments are inside a box, as shares of the segment."""
    x = df.withColumns({f"n{a}": neighbour(a, 1) for a in XYZ}).where("nx is not null")
    enter, leave, there = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, lo, hi in zip(XYZ, low, high):
        d = F.col(f"n{a}") - F.col(a)
        p, q = (F.lit(lo) - F.col(a)) / F.nullif(d, F.lit(0.0)), (F.lit(hi) - F.col(a)) / F.nullif(d, F.lit(0.0))
        enter, leave = F.greatest(enter, F.coalesce(F.least(p, q), F.lit(0.0))), F.least(leave, F.coalesce(F.greatest(p, q), F.lit(1.0)))
        there = there & ((d != 0) | F.col(a).between(lo, hi))
    return x.withColumn("enter", enter).withColumn("leave", leave).where(there & (F.col("enter") <= F.col("leave"))).select("path_id", "idx", "enter", "leave")


def fit(boxes: DataFrame, target: tuple[float, float, float], uniform: bool = True) -> DataFrame:
    """boxes (lx .. hz) with the scale that fits each into a target size, along each axis or the least for all."""
    scale = {a: F.lit(float(t)) / F.nullif(F.col(f"h{a}") - F.col(f"l{a}"), F.lit(0.0)) for a, t in zip(XYZ, target)}
    least = F.least(*scale.values())
    return boxes.withColumns({f"scale_{a}": F.coalesce(least if uniform else s, F.lit(1.0)) for a, s in scale.items()})


def flatten(df: DataFrame) -> DataFrame:
    """Points on the plane, with z kept as flat_z; restore() undoes it."""
    return df.withColumn("flat_z", F.col("z")).withColumn("z", F.lit(0.0))


def restore(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.col("flat_z")).drop("flat_z")


def test_neighbours(edges: DataFrame, values: DataFrame, test: Column) -> DataFrame:
    """(node, passing, share) of the neighbours whose `value` passes a test."""
    from .graph import both_ways

    x = both_ways(edges.select("src", "dst")).join(values.withColumnRenamed("node", "other"), "other")
    ok = F.count(F.when(test, 1))
    return x.groupBy("node").agg(ok.alias("passing"), (ok / F.count(F.lit(1))).alias("share"))
