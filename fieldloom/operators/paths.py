"""Paths: ordered points (path_id, idx, x, y, z), as window functions over each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import col
from ..functions.maths import safe_index
from . import blocks

XYZ = ("x", "y", "z")


def line(by: str = "path_id"):
    return Window.partitionBy(by).orderBy("idx")


def neighbour(name: str, offset: int, closed: bool = False, by: str = "path_id") -> Column:
    """A column of the point `offset` ahead; a closed path wraps about by one."""
    w = line(by)
    there = F.lead(name, offset).over(w) if offset > 0 else F.lag(name, -offset).over(w)
    if not closed:
        return there
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(there, (F.first if offset > 0 else F.last)(name).over(whole))


def size(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def step(offset: int, closed: bool = False) -> list[Column]:
    """The vector to the neighbour `offset` ahead."""
    return [neighbour(a, offset, closed) - F.col(a) for a in XYZ]


def properties(df: DataFrame, closed: bool = False) -> DataFrame:
    """df with distances to the next and last point, to start and end, and the time (0 to 1) along the path."""
    w = line()
    to_next = F.coalesce(size(step(1, closed)), F.lit(0.0))
    to_last = F.coalesce(size(step(-1, closed)), F.lit(0.0))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("distance_to_next", to_next).withColumn("distance_to_prev", to_last)
    x = x.withColumn("distance_to_start", F.coalesce(F.sum("distance_to_next").over(before), F.lit(0.0)))
    x = x.withColumn("__all", F.sum("distance_to_next").over(Window.partitionBy("path_id")))
    x = x.withColumn("distance_to_end", F.col("__all") - F.col("distance_to_start"))
    return x.withColumn("point_time", F.when(F.col("__all") > 0, F.col("distance_to_start") / F.col("__all")).otherwise(F.lit(0.0))).drop("__all")


def summary(df: DataFrame, closed: bool = False) -> DataFrame:
    """One row per path: length, perimeter (closed), shoelace area, clockwise, compactness, centroid and number of points."""
    cross = F.col("x") * neighbour("y", 1, True) - neighbour("x", 1, True) * F.col("y")
    x = df.withColumn("__d", F.coalesce(size(step(1, closed)), F.lit(0.0))).withColumn("__p", size(step(1, True))).withColumn("__c", cross)
    out = x.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("__d").alias("length"), F.coalesce(F.sum("__p"), F.lit(0.0)).alias("perimeter"), (F.sum("__c") / 2).alias("__a"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.avg("z").alias("centroid_z"),
    )
    out = out.withColumn("area", F.abs("__a")).withColumn("is_clockwise", F.col("__a") < 0)
    round_ = F.when(F.col("perimeter") > 0, F.lit(12.566370614359172) * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(F.lit(0.0))
    return out.withColumn("compactness", round_).drop("__a")


def smooth(df: DataFrame, width: int, influence: float = 1.0, names=XYZ) -> DataFrame:
    """df with `smooth_` columns: a moving average with triangular weights 1 - |i| / width over the rows that are there."""
    w = line()
    weights = [(i, (1 - abs(i) / width) * (influence if i else 1.0)) for i in range(-width + 1, width)]
    out = df
    for a in names:
        terms = [(F.lead(a, i).over(w) if i > 0 else F.lag(a, -i).over(w) if i < 0 else F.col(a), k) for i, k in weights]
        total = sum((F.coalesce(t * k, F.lit(0.0)) for t, k in terms), F.lit(0.0))
        there = sum((F.when(t.isNotNull(), F.lit(k)).otherwise(F.lit(0.0)) for t, k in terms), F.lit(0.0))
        out = out.withColumn(f"smooth_{a}", total / there)
    return out


def shift(df: DataFrame, pivot: int, safety: str = "tile") -> DataFrame:
    """Paths that start at another point: indices are counted from the pivot, made safe, and go about."""
    n = df.groupBy("path_id").agg(F.count(F.lit(1)).alias("__n"))
    x = df.join(n, "path_id")
    return x.withColumn("idx", F.pmod(F.col("idx") - safe_index(F.lit(pivot), F.col("__n"), safety), F.col("__n")).cast("long")).drop("__n")


def reverse(df: DataFrame) -> DataFrame:
    n = df.groupBy("path_id").agg(F.max("idx").alias("__m"))
    return df.join(n, "path_id").withColumn("idx", F.col("__m") - F.col("idx")).drop("__m")


def split(df: DataFrame, condition: Column, mode: str = "split") -> DataFrame:
    """Paths cut where a condition holds, renumbered: sub_id counts the parts of a path.

    split: the point begins a part; remove: it goes; disconnect: it ends one; partition and switch: a part begins where
    the condition's value changes.
    """
    w = line()
    c = F.coalesce(condition, F.lit(False)).cast("int")
    x = df.withColumn("__c", c)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if mode in ("split", "remove"):
        x = x.withColumn("sub_id", F.sum("__c").over(running))
    elif mode == "disconnect":
        x = x.withColumn("sub_id", F.sum("__c").over(running) - F.col("__c"))
    else:
        change = F.when(F.col("__c") != F.lag("__c").over(w), 1).otherwise(0)
        x = x.withColumn("__k", change).withColumn("sub_id", F.sum("__k").over(running)).drop("__k")
    x = x.where("__c = 0") if mode == "remove" else x
    inner = Window.partitionBy("path_id", "sub_id").orderBy("idx")
    return x.withColumn("sub_idx", (F.row_number().over(inner) - 1).cast("long")).withColumn("sub_id", F.col("sub_id").cast("long")).drop("__c")


def subdivide(df: DataFrame, amount: float, mode: str = "count", closed: bool = False) -> DataFrame:
    """The points of every segment: its start (sub 0) and those put between, by count or by distance.

    By count, floor(amount) points divide a segment evenly; by distance, one stands at each multiple of the amount
    before the end. The last point of an open path has no segment.
    """
    to = [neighbour(a, 1, closed) for a in XYZ]
    x = df.withColumns({f"__{a}": t for a, t in zip(XYZ, to)})
    length = size([F.col(f"__{a}") - F.col(a) for a in XYZ])
    if mode == "count":
        n, part = F.lit(int(amount)), F.lit(1.0 / (int(amount) + 1))
    else:
        n, part = F.floor(length / amount).cast("int"), F.when(length > 0, F.lit(amount) / F.nullif(length, F.lit(0.0))).otherwise(F.lit(0.0))
    n = F.when(F.col("__x").isNull(), F.lit(0)).otherwise(n)
    x = x.withColumn("__part", part).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))))
    t = F.col("sub") * F.coalesce("__part", F.lit(0.0))
    x = x.withColumns({a: F.when(F.col("sub") == 0, F.col(a)).otherwise(F.col(a) + (F.col(f"__{a}") - F.col(a)) * t) for a in XYZ})
    return x.drop("__x", "__y", "__z", "__part")


def resample(df: DataFrame, n: int) -> DataFrame:
    """n points at even distances along every path of at least two points: sample, x, y, z.

    Samples are made per path and meet the segment that holds their distance; each segment makes its own, so no sample
    is joined to more than its segment.
    """
    if n < 2:
        raise ValueError("at least two points")
    x = properties(df)
    x = x.withColumns({f"__{a}": neighbour(a, 1) for a in XYZ}).withColumn("__all", F.col("distance_to_start") + F.col("distance_to_end"))
    x = x.withColumn("__step", F.col("__all") / (n - 1)).where("__all > 0")
    end = F.col("distance_to_start") + F.col("distance_to_next")
    is_last = F.col("__x").isNull()
    first = F.ceil(F.col("distance_to_start") / F.col("__step"))
    last = F.least(F.ceil(end / F.col("__step")) - 1, F.lit(n - 1).cast("long"))
    x = x.withColumn("__i", first).withColumn("__j", last)
    segments = x.where(~is_last & (F.col("__j") >= F.col("__i"))).withColumn("sample", F.explode(F.sequence("__i", "__j"))).where(F.col("sample") < n - 1)
    t = (F.col("sample") * F.col("__step") - F.col("distance_to_start")) / F.col("distance_to_next")
    made = segments.select("path_id", F.col("sample").cast("long").alias("sample"), *[(F.col(a) + (F.col(f"__{a}") - F.col(a)) * t).alias(a) for a in XYZ])
    return made.unionByName(x.where(is_last).select("path_id", F.lit(n - 1).cast("long").alias("sample"), *XYZ))


def fuse_collinear(df: DataFrame, angle_dot: float = 0.999) -> DataFrame:
    """Inner points whose direction hardly turns go; ends stay."""
    before, after = [F.col(a) - neighbour(a, -1) for a in XYZ], step(1)
    both = sum((p * q for p, q in zip(before, after)), F.lit(0.0)) / F.nullif(size(before) * size(after), F.lit(0.0))
    return df.withColumn("__dot", both).where(F.coalesce(F.col("__dot"), F.lit(-1.0)) < angle_dot).drop("__dot")


def offset(df: DataFrame, amount: float, closed: bool = False) -> DataFrame:
    """Points moved along the normal in the plane: that of the sum of the directions before and after."""
    unit = lambda v: [F.coalesce(p / F.nullif(size(v), F.lit(0.0)), F.lit(0.0)) for p in v]
    before, after = unit([F.col(a) - neighbour(a, -1, closed) for a in XYZ]), unit(step(1, closed))
    dx, dy = before[0] + after[0], before[1] + after[1]
    norm = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return df.withColumns({"x": F.col("x") + F.coalesce(-dy / norm, F.lit(0.0)) * amount, "y": F.col("y") + F.coalesce(dx / norm, F.lit(0.0)) * amount})


def slide(df: DataFrame, amount: float, forward: bool = True) -> DataFrame:
    """Points moved toward the next or the last one."""
    there = {a: neighbour(a, 1 if forward else -1) for a in XYZ}
    return df.withColumns({a: F.col(a) + (F.coalesce(t, F.col(a)) - F.col(a)) * amount for a, t in there.items()})


def shrink(df: DataFrame, start: float, end: float) -> DataFrame:
    """Points farther than the given distances from both ends of their path."""
    return properties(df).where((F.col("distance_to_start") >= start) & (F.col("distance_to_end") >= end)).select(df.columns)


def tangents(df: DataFrame, mode: str = "catmull") -> DataFrame:
    """df with tx, ty, tz: half the vector from the last to the next point (catmull), or zero."""
    if mode == "zero":
        return df.withColumns({f"t{a}": F.lit(0.0) for a in XYZ})
    return df.withColumns({f"t{a}": (F.coalesce(neighbour(a, 1), F.col(a)) - F.coalesce(neighbour(a, -1), F.col(a))) / 2 for a in XYZ})


def orient(df: DataFrame) -> DataFrame:
    """df with the mean unit direction dx, dy, dz of the neighbours' directions."""
    unit = lambda v: [F.coalesce(p / F.nullif(size(v), F.lit(0.0)), F.lit(0.0)) for p in v]
    both = [p + q for p, q in zip(unit([F.col(a) - neighbour(a, -1) for a in XYZ]), unit(step(1)))]
    x = df.withColumns({f"d{a}": v for a, v in zip(XYZ, both)})
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return x.withColumn("__n", F.nullif(norm, F.lit(0.0))).withColumns({f"d{a}": F.coalesce(F.col(f"d{a}") / F.col("__n"), F.lit(0.0)) for a in XYZ}).drop("__n")


def look_at(df: DataFrame, offset: int = 1) -> DataFrame:
    """df with the unit direction dx, dy, dz to the point `offset` ahead; zero where there is none or it is at one place."""
    to = {a: neighbour(a, offset) - F.col(a) for a in XYZ}
    x = df.withColumns({f"d{a}": v for a, v in to.items()})
    norm = F.nullif(size([F.col(f"d{a}") for a in XYZ]), F.lit(0.0))
    return x.withColumn("__n", norm).withColumns({f"d{a}": F.coalesce(F.col(f"d{a}") / F.col("__n"), F.lit(0.0)) for a in XYZ}).drop("__n")


def inherit(df: DataFrame, v: str, mode: str = "first") -> DataFrame:
    """df with `blended`: v of the path's first or last point, or (none) the point's own."""
    whole = line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("blended", {"first": F.first(v).over(whole), "last": F.last(v).over(whole), "none": F.col(v)}[mode])


def blend_ends(df: DataFrame, v: str) -> DataFrame:
    """df with `blended`: v of the first point to v of the last, by the time along the path."""
    w = line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = properties(df).withColumn("__a", F.first(v).over(w)).withColumn("__b", F.last(v).over(w))
    return x.withColumn("blended", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("point_time")).select(*df.columns, "blended")


def rolling(df: DataFrame, start: Column, stop: Column) -> DataFrame:
    """df with is_inside_range, range_index and index_inside_range of ranges that open and close by conditions.

    A stop wins over a start; a start inside a range opens none. The state before a row is that of the last row with
    either condition; rows outside have range_index -1.
    """
    w = line()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.coalesce(stop, F.lit(False)), 0).when(F.coalesce(start, F.lit(False)), 1)
    x = df.withColumn("__e", event).withColumn("__s", F.coalesce(F.last("__e", True).over(upto), F.lit(0)))
    x = x.withColumn("__b", F.coalesce(F.lag("__s").over(w), F.lit(0)))
    x = x.withColumn("range_start", (F.col("__s") == 1) & (F.col("__b") == 0))
    x = x.withColumn("is_inside_range", F.col("__s") == 1).withColumn("__k", F.sum(F.col("range_start").cast("int")).over(upto) - 1)
    x = x.withColumn("range_index", F.when(F.col("is_inside_range"), F.col("__k")).otherwise(F.lit(-1)).cast("long"))
    inner = Window.partitionBy("path_id", "__k", "is_inside_range").orderBy("idx")
    x = x.withColumn("index_inside_range", F.when(F.col("is_inside_range"), F.row_number().over(inner) - 1).otherwise(F.lit(-1)).cast("long"))
    return x.drop("__e", "__s", "__b", "__k", "range_start")


def to_edges(df: DataFrame, closed: bool = False) -> DataFrame:
    """The segments of paths as edges: path_id, src, dst (indices), length."""
    x = df.withColumn("dst", neighbour("idx", 1, closed)).withColumn("length", size(step(1, closed)))
    return x.where("dst is not null").select("path_id", F.col("idx").alias("src"), "dst", "length")


def segments(df: DataFrame, closed: bool = False) -> DataFrame:
    """Segments with both ends: path_id, idx, x, y, z, to_x, to_y, to_z."""
    x = df.withColumns({f"to_{a}": neighbour(a, 1, closed) for a in XYZ})
    return x.where("to_x is not null").select("path_id", "idx", *XYZ, "to_x", "to_y", "to_z")


def crossings(df: DataFrame, cell: float | None = None, by_pairs: bool = True) -> DataFrame:
    """Crossings in the plane of segments of different paths: path_id, idx, r_path_id, r_idx, alpha, x, y.

    Blocks of segments meet, and only what crosses becomes a row; none is shuffled. No cells are needed any more.
    """
    s = segments(df).select("path_id", "idx", "x", "y", "to_x", "to_y")
    f = s.schema
    form = f"path_id {f['path_id'].dataType.simpleString()}, idx {f['idx'].dataType.simpleString()}, r_path_id {f['path_id'].dataType.simpleString()}, r_idx {f['idx'].dataType.simpleString()}, alpha double, x double, y double"

    def emit(one, two, i, j, alpha):
        import pyarrow as pa

        x, y = (blocks.column(one, a)[i] + (blocks.column(one, f"to_{a}")[i] - blocks.column(one, a)[i]) * alpha for a in "xy")
        i, j = pa.array(i), pa.array(j)
        yield {"path_id": one["path_id"].take(i), "idx": one["idx"].take(i), "r_path_id": two["r_path_id"].take(j), "r_idx": two["r_idx"].take(j), "alpha": alpha, "x": x, "y": y}

    return meet_segments(s, emit, form)


def meet_segments(s: DataFrame, emit, form: str) -> DataFrame:
    """What emit returns of the crossings of segments (path_id, idx, x, y, to_x, to_y and columns) of different paths."""
    s = s.where("to_x = to_x and to_y = to_y and abs(to_x) < double('inf') and abs(to_y) < double('inf')")
    return blocks.meet(s, blocks.right(s), blocks.crossed(emit), form, "idx", "r_idx", ("x", "y"))


def inside_path(points: DataFrame, path: DataFrame, key: str = "id") -> DataFrame:
    """(key, path_id) of points inside closed paths in the plane, by the number of edges that a ray to the right crosses.

    Edges meet points in bands of y, so each point is joined to edges at its height only.
    """
    e = segments(path, closed=True)
    height = points.agg((F.max("y") - F.min("y")).alias("h")).first()["h"] or 1.0
    band = float(height) / 64 or 1.0
    e = e.withColumn("__b", F.explode(F.sequence(F.floor(F.least("y", "to_y") / band), F.floor(F.greatest("y", "to_y") / band)))).select([F.col(c).alias(f"e_{c}") if c != "__b" else F.col(c) for c in [*e.columns, "__b"]])
    p = points.select(F.col(key), F.col("x").alias("px"), F.col("y").alias("py")).withColumn("__b", F.floor(F.col("py") / band))
    at = F.col("e_x") + (F.col("py") - F.col("e_y")) * (F.col("e_to_x") - F.col("e_x")) / F.nullif(F.col("e_to_y") - F.col("e_y"), F.lit(0.0))
    cross = ((F.col("e_y") > F.col("py")) != (F.col("e_to_y") > F.col("py"))) & (F.col("px") < at)
    return p.join(e, "__b").where(cross).groupBy(key, F.col("e_path_id").alias("path_id")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "path_id")


def order_by(df: DataFrame, key) -> DataFrame:
    """Paths with indices by another key."""
    w = Window.partitionBy("path_id").orderBy(col(key), "idx")
    return df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
