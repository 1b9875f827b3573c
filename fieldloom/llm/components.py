"""Connected components of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or itself and smaller ones) are linked to the least of its neighbourhood."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


#: So many links, a few MB, are solved within one task; more by rounds of joins. The result is the same.
SMALL = 1 << 17


def _solve(batches):
    """Links (u, v) of one partition -> each node that isn't the least of its component, with that one."""
    import pyarrow as pa

    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    types = None
    for b in batches:
        types = types or [b.column(0).type, b.column(1).type]
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = sorted((find(u), find(v)))
            root[c] = a
    if types:
        found = [(x, find(x)) for x in list(root)]
        found = [f for f in found if f[0] != f[1]]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], types[k]) for k in (0, 1)], ["u", "v"])


def connected_components(edges: DataFrame, limit: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) of every node that edges (u, v) mention; component is the least node reachable.

    Each round keeps one row per link and is written to the shared folder; rounds end when nothing changes, after about log2 of the
    longest chain. A hub's links are joined to its least neighbour, which is formed before the shuffle, so no task holds
    the links of a hub at once. Links of a node to itself name a component of its own; null ends are dropped.
    """
    known = edges.where("u is not null and v is not null")
    work, path = store(known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(work)
    if 0 < state[0] <= small:
        work = work.coalesce(1).mapInArrow(_solve, work.schema)
        limit = 0
    for _ in range(limit):
        if not state[0]:
            break
        work, new = store(_star(_star(work, True), False))
        discard(edges.sparkSession, path)
        path = new
        before, state = state, _digest(work)
        if state == before:
            break
    else:
        if limit:
            raise RuntimeError("components did not settle")
    ends = known.select("u").union(known.select("v")).distinct().withColumnRenamed("u", "node")
    a, b = ends.alias("a"), work.groupBy("u").agg(F.min("v").alias("v")).alias("b")
    return a.join(b, F.col("a.node") == F.col("b.u"), "left").select("node", F.coalesce("v", "node").alias("component"))
