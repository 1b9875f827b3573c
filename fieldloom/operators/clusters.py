"""More on graphs with placed vertices: connecting, cutting, simplifying, merging, per-vertex and per-edge measures, and
heuristic scores of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import numeric
from ..functions.maths import curve
from . import blocks
from .graph import both_ways, canonical, components, degree, edge_properties, settle
from .rangejoin import nearest

XYZ = ("x", "y", "z")


def edge_length_filter(edges: DataFrame, vertices: DataFrame, op: str, length: float) -> DataFrame:
    return edge_properties(edges, vertices).where(numeric("length", op, length)).select(edges.columns)


def edge_direction_filter(edges: DataFrame, vertices: DataFrame, way: tuple[float, float, float], least_dot: float) -> DataFrame:
    """Edges whose unit direction agrees with a unit vector."""
    x = edge_properties(edges, vertices)
    dot = sum((F.col(f"dir_{a}") * w for a, w in zip(XYZ, way)), F.lit(0.0))
    return x.where(dot >= least_dot).select(edges.columns)


def edge_degree_filter(edges: DataFrame, op: str, n: int, mode: str = "any") -> DataFrame:
    """Edges by the degrees of both ends: any or both compare, or their sum does."""
    d = degree(edges)
    x = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("__a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("__b")), "dst")
    a, b = numeric("__a", op, n), numeric("__b", op, n)
    return x.where({"any": a | b, "both": a & b, "sum": numeric(F.col("__a") + F.col("__b"), op, n)}[mode]).select(edges.columns)


def vertex_degree_filter(edges: DataFrame, op: str, n: int) -> DataFrame:
    return degree(edges).where(numeric("degree", op, n)).select("node")


def _spokes(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """node, other, length, and the unit direction from node to other."""
    x = edge_properties(edges.select("src", "dst"), vertices)
    one = x.select(F.col("src").alias("node"), F.col("dst").alias("other"), "length", *[F.col(f"dir_{a}") for a in XYZ])
    return one.union(x.select(F.col("dst"), F.col("src"), "length", *[-F.col(f"dir_{a}") for a in XYZ]))


def amplitude(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each node's range of direction x length along each axis, and its size."""
    s = _spokes(edges, vertices)
    out = s.groupBy("node").agg(*[(F.max(F.col(f"dir_{a}") * F.col("length")) - F.min(F.col(f"dir_{a}") * F.col("length"))).alias(f"range_{a}") for a in XYZ])
    return out.withColumn("amplitude", F.sqrt(sum((F.col(f"range_{a}") * F.col(f"range_{a}") for a in XYZ), F.lit(0.0))))


def edge_match(edges: DataFrame, vertices: DataFrame, way: tuple[float, float, float]) -> DataFrame:
    """Each node's neighbour whose direction agrees most with a vector; ties to the smaller."""
    dot = sum((F.col(f"dir_{a}") * w for a, w in zip(XYZ, way)), F.lit(0.0))
    return _spokes(edges, vertices).groupBy("node").agg(F.min_by("other", F.struct(-dot, F.col("other"))).alias("matched"), F.max(dot).alias("dot"))


def orbitals(edges: DataFrame, vertices: DataFrame, ways: list[tuple[float, float, float]], least_dot: float = 0.7) -> DataFrame:
    """Each node's mask of the directions that some edge takes: bit i for ways[i]."""
    bits = [F.bit_or(F.when(sum((F.col(f"dir_{a}") * w for a, w in zip(XYZ, way)), F.lit(0.0)) >= least_dot, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))) for i, way in enumerate(ways)]
    return _spokes(edges, vertices).groupBy("node").agg(reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))


def patterns(edges: DataFrame, masks: DataFrame, first: int, second: int) -> DataFrame:
    """Edges (a, b) from a node with the first mask to one with the second."""
    x = both_ways(edges.select("src", "dst"))
    a = masks.where(F.col("mask") == first).select("node")
    b = masks.where(F.col("mask") == second).select(F.col("node").alias("other"))
    return x.join(a, "node", "left_semi").join(b, "other", "left_semi").select(F.col("node").alias("a"), F.col("other").alias("b"))


def connect(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """The edges and, for every component, the shortest edge from it to another: that of each vertex and its nearest one
    of another component, found by blocks."""
    comp = vertices.select(F.col(key).alias("node")).join(components(edges), "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("component"))
    p = settle(vertices.select(key, *XYZ).join(comp, key))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    found = blocks.meet(p, blocks.right(p), blocks.closest_apart(key, f"r_{key}", "component"), f"{key} {kinds[key]}, component {kinds['component']}, r_{key} {kinds[key]}, d2 double", key, f"r_{key}")
    best = found.groupBy("component").agg(F.min(F.struct("d2", F.least(key, f"r_{key}").alias("src"), F.greatest(key, f"r_{key}").alias("dst"))).alias("e"))
    return canonical(edges.select("src", "dst").union(best.select("e.src", "e.dst")))


def cut(edges: DataFrame, vertices: DataFrame, segments: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """Edges that no segment (x, y, to_x, to_y) crosses in the plane; both meet in the grid cells of their boxes."""
    a = vertices.select(F.col(key).alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = vertices.select(F.col(key).alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = edges.join(a, "src").join(b, "dst")

    def dealt(df, x0, y0, x1, y1):
        lo, hi = (lambda p, q: F.floor(F.least(p, q) / cell)), (lambda p, q: F.floor(F.greatest(p, q) / cell))
        return df.withColumn("__i", F.explode(F.sequence(lo(x0, x1), hi(x0, x1)))).withColumn("__j", F.explode(F.sequence(lo(y0, y1), hi(y0, y1))))

    s = dealt(segments.select(*[F.col(c).alias(f"s_{c}") for c in ("x", "y", "to_x", "to_y")]), "s_x", "s_y", "s_to_x", "s_to_y")
    both = dealt(e, "ax", "ay", "bx", "by").join(s, ["__i", "__j"])
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    hit = (side("ax", "ay", "bx", "by", "s_x", "s_y") * side("ax", "ay", "bx", "by", "s_to_x", "s_to_y") < 0) & (side("s_x", "s_y", "s_to_x", "s_to_y", "ax", "ay") * side("s_x", "s_y", "s_to_x", "s_to_y", "bx", "by") < 0)
    return edges.join(both.where(hit).select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def fuse(edges: DataFrame, vertices: DataFrame, tolerance: float, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Vertices that share a rounded grid key become the one with the least id, at their mean place; edges follow."""
    from ..functions.maths import cell as grid

    keyed = vertices.select(key, *XYZ, *[grid(a, tolerance, True).alias(f"k{a}") for a in XYZ])
    fused = keyed.groupBy("kx", "ky", "kz").agg(F.min(key).alias("new"), *[F.avg(a).alias(a) for a in XYZ])
    name = keyed.join(fused.select("kx", "ky", "kz", "new"), ["kx", "ky", "kz"]).select(key, "new")
    x = edges.join(name.withColumnRenamed(key, "src").withColumnRenamed("new", "__s"), "src").join(name.withColumnRenamed(key, "dst").withColumnRenamed("new", "__d"), "dst")
    return canonical(x.select(F.col("__s").alias("src"), F.col("__d").alias("dst"))), fused.select(F.col("new").alias(key), *XYZ)


def simplify(edges: DataFrame) -> DataFrame:
    """Edges with chains of nodes of degree 2 replaced by one edge between their ends; rings are dropped.

    Chains are the components of the links between nodes of degree 2; each has two ways out.
    """
    edges = settle(edges.select("src", "dst"))  # they are read five times
    two = degree(edges).where("degree = 2").select("node")
    x = both_ways(canonical(edges))
    inner = x.join(two, "node", "left_semi").join(two.withColumnRenamed("node", "other"), "other", "left_semi")
    chain = two.join(components(inner.select(F.col("node").alias("src"), F.col("other").alias("dst"))), "node", "left").select("node", F.coalesce("component", "node").alias("chain"))
    out = x.join(chain, "node").join(two.withColumnRenamed("node", "other"), "other", "left_anti").groupBy("chain").agg(F.min("other").alias("src"), F.max("other").alias("dst"), F.count(F.lit(1)).alias("n"))
    plain = canonical(edges).join(two.withColumnRenamed("node", "src"), "src", "left_anti").join(two.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return canonical(plain.union(out.where("n = 2 and src <> dst").select("src", "dst")))


def pick_closest(vertices: DataFrame, targets: DataFrame, cluster: str = "cluster_id", key: str = "id") -> DataFrame:
    """(target, cluster) of the vertex nearest to each target."""
    found = nearest(targets.select(key, *XYZ), vertices.select(key, cluster, *XYZ), 1, key)
    return found.select(F.col(key).alias("target"), F.col(f"r_{cluster}").alias("cluster"))


def merge_vertices(tables: list[DataFrame], key: str = "id") -> DataFrame:
    """Vertices of several clusters under dense new ids, in the order of the tables and old ids."""
    from pyspark.sql import Window

    rows = reduce(lambda a, b: a.unionByName(b), [t.withColumn("cluster", F.lit(i)) for i, t in enumerate(tables)])
    counts = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))
    start = counts.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("cluster").orderBy(key)) - 1
    return rows.withColumn("__i", inner).join(start, "cluster").withColumn("new_id", (F.col("__start") + F.col("__i")).cast("long")).drop("__start", "__i")


def overlap_removal(edges: DataFrame, vertices: DataFrame, cell: float, keep_longest: bool = True, key: str = "id") -> DataFrame:
    """Edges less, of each two that cross in the plane without a shared end, the shorter (or the longer); ties lose both
    ends' larger pair."""
    from .paths import meet_segments

    a = vertices.select(F.col(key).alias("src"), "x", "y")
    b = vertices.select(F.col(key).alias("dst"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    x = edge_properties(edges, vertices, key).select("src", "dst", "length").join(a, "src").join(b, "dst")
    s = x.select(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("path_id"), F.xxhash64("src", "dst").alias("idx"), "x", "y", "to_x", "to_y", "src", "dst", "length")

    def emit(one, two, i, j, alpha):
        import numpy as np
        import pyarrow as pa

        p, q, u, v = (blocks.column(t, c)[k] for t, c, k in ((one, "src", i), (one, "dst", i), (two, "r_src", j), (two, "r_dst", j)))
        apart = (p != u) & (q != v) & (p != v) & (q != u)
        long, other = blocks.column(one, "length")[i], blocks.column(two, "r_length")[j]
        first = long >= other if keep_longest else long <= other
        for t, k, side in ((one, i[apart & ~first], ""), (two, j[apart & first], "r_")):
            k = pa.array(np.unique(k))
            yield {"src": t[f"{side}src"].take(k), "dst": t[f"{side}dst"].take(k)}

    kind = {c: x.schema[c].dataType.simpleString() for c in ("src", "dst")}
    gone = meet_segments(s, emit, f"src {kind['src']}, dst {kind['dst']}").distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def heuristic(scores: list[tuple[Column, float]], how: str = "weighted", knots=None) -> Column:
    """One score of many (column, weight): each is max(0, curve(score)) times its weight; then the weighted average, the
    geometric or harmonic mean, the sum, the least or the greatest."""
    parts = [F.greatest(F.lit(0.0), curve(c, knots) if knots else c) * w for c, w in scores]
    total = sum(w for _, w in scores)
    match how:
        case "weighted":
            return sum(parts, F.lit(0.0)) / total
        case "sum":
            return sum(parts, F.lit(0.0))
        case "min":
            return F.least(*parts) if len(parts) > 1 else parts[0]
        case "max":
            return F.greatest(*parts) if len(parts) > 1 else parts[0]
        case "geometric":
            return F.exp(sum((F.log(F.greatest(p, F.lit(1e-12))) for p in parts), F.lit(0.0)) / len(parts))
        case "harmonic":
            return len(parts) / sum((1 / F.greatest(p, F.lit(1e-12)) for p in parts), F.lit(0.0))
    raise ValueError(f"no combination {how!r}")


def normalized(df: DataFrame, v: str, out: str) -> DataFrame:
    """A column over its greatest value, as distance heuristics use it."""
    top = df.agg(F.max(v).alias("__m"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.coalesce(F.col(v) / F.nullif("__m", F.lit(0.0)), F.lit(0.0))).drop("__m")  # one row
