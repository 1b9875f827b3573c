"""Graphs: vertices (id and columns) and edges (src, dst and columns). Relational measures, refinements and walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import square_distance

XYZ = ("x", "y", "z")
#: Links, each from both ends, that one task relaxes (some 100 bytes each).
LINKS = 1 << 22


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops: src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both ends: node, other, and the other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    return one.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def degree(edges: DataFrame) -> DataFrame:
    """Number of edges of each node that has any. Edges are read once, and the ends counted before they are shuffled."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_properties(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """edges with length and unit direction."""
    a = vertices.select(F.col(key).alias("src"), *[F.col(c).alias(f"__a{c}") for c in XYZ])
    b = vertices.select(F.col(key).alias("dst"), *[F.col(c).alias(f"__b{c}") for c in XYZ])
    x = edges.join(a, "src").join(b, "dst")
    x = x.withColumn("length", F.sqrt(square_distance([F.col(f"__a{c}") for c in XYZ], [F.col(f"__b{c}") for c in XYZ])))
    for c in XYZ:
        x = x.withColumn(f"dir_{c}", F.coalesce((F.col(f"__b{c}") - F.col(f"__a{c}")) / F.nullif("length", F.lit(0.0)), F.lit(0.0)))
    return x.drop(*[f"__{s}{c}" for s in "ab" for c in XYZ])


def edge_order(edges: DataFrame, condition: Column) -> DataFrame:
    """Edges turned about where the condition fails."""
    return edges.withColumn("__s", F.when(condition, F.col("src")).otherwise(F.col("dst"))).withColumn("dst", F.when(condition, F.col("dst")).otherwise(F.col("src"))).withColumn("src", F.col("__s")).drop("__s")


def filter_vertices(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose both ends are among the vertices."""
    ids = vertices.select(F.col(key).alias("node")).distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def endpoints_check(edges: DataFrame, flags: DataFrame, mode: str = "both", expected: bool = True, invert: bool = False) -> DataFrame:
    """edges with `passes` by a flag of their ends (node, flag): none, both, any, start, end or seesaw (one only)."""
    a, b = (flags.select(F.col("node").alias(s), F.coalesce("flag", F.lit(False)).alias(f"__{s}")) for s in ("src", "dst"))
    x = edges.join(a, "src", "left").join(b, "dst", "left")
    s, d = (F.coalesce(F.col(f"__{n}"), F.lit(False)) == F.lit(expected) for n in ("src", "dst"))
    ok = {"none": ~s & ~d, "both": s & d, "any": s | d, "start": s, "end": d, "seesaw": s != d}[mode]
    return x.withColumn("passes", ~ok if invert else ok).drop("__src", "__dst")


def endpoints_compare(edges: DataFrame, values: DataFrame, compare) -> DataFrame:
    """edges with `passes`: compare(value of src, value of dst) of values (node, value)."""
    a, b = (values.select(F.col("node").alias(s), F.col("value").alias(f"__{s}")) for s in ("src", "dst"))
    x = edges.join(a, "src").join(b, "dst")
    return x.withColumn("passes", compare(F.col("__src"), F.col("__dst"))).drop("__src", "__dst")


def elect(edges: DataFrame, by: str, largest: bool = True, keep: bool = True) -> DataFrame:
    """Keep or remove the edges that either end elects: its largest or smallest by a column, ties to the smaller other."""
    x = both_ways(edges.select("src", "dst", by))
    key = F.struct(F.col(by) if not largest else -F.col(by), F.col("other"))
    chosen = x.groupBy("node").agg(F.min_by("other", key).alias("other")).select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()
    return edges.join(chosen, ["src", "dst"], "left_semi" if keep else "left_anti")


def remove_leaves(edges: DataFrame, rounds: int = 1) -> DataFrame:
    """Edges without those that end in a node of degree 1; repeated for a number of rounds or (0) until none is left."""
    done = 0
    while rounds == 0 or done < rounds:
        leaves = degree(edges).where("degree = 1").select("node")
        if rounds != 1 and not leaves.limit(1).count():
            break
        edges = edges.join(leaves.withColumnRenamed("node", "src"), "src", "left_anti").join(leaves.withColumnRenamed("node", "dst"), "dst", "left_anti").select(edges.columns)
        if rounds != 1:
            edges = settle(edges)
        done += 1
    return edges


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graph-"))
    return df.checkpoint()


def special_neighbours(edges: DataFrame) -> DataFrame:
    """Each node's neighbour of the largest and of the smallest degree, ties to the smaller."""
    d = degree(edges)
    x = both_ways(edges.select("src", "dst")).join(d.withColumnRenamed("node", "other"), "other")
    return x.groupBy("node").agg(F.min_by("other", F.struct(-F.col("degree"), F.col("other"))).alias("largest"), F.min_by("other", F.struct("degree", "other")).alias("smallest"))


def special_edges(edges: DataFrame, by: str = "length") -> DataFrame:
    """Each node's longest, shortest and mean edge."""
    x = both_ways(edges.select("src", "dst", by))
    return x.groupBy("node").agg(F.max(by).alias("longest"), F.min(by).alias("shortest"), F.avg(by).alias("average"))


def sample_neighbours(edges: DataFrame, values: DataFrame, how: dict) -> DataFrame:
    """Aggregates of the neighbours' values (node, value): {name: aggregate function of Spark}."""
    x = both_ways(edges.select("src", "dst")).join(values.withColumnRenamed("node", "other"), "other")
    return x.groupBy("node").agg(*[f("value").alias(n) for n, f in how.items()])


def adjacency_filter(edges: DataFrame, values: DataFrame, test: Column, mode: str = "all", least: int = 1) -> DataFrame:
    """node and passes: whether all neighbours' values pass a test on `value`, or at least a number of them."""
    x = both_ways(edges.select("src", "dst")).join(values.withColumnRenamed("node", "other"), "other")
    ok = F.bool_and(test) if mode == "all" else F.count(F.when(test, 1)) >= least
    return x.groupBy("node").agg(ok.alias("passes"))


def sanitize(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """Distinct undirected edges between vertices that exist."""
    return canonical(filter_vertices(edges, vertices, key))


def dual(edges: DataFrame) -> DataFrame:
    """Edges become nodes, linked where they share a vertex: pairs (a, b) of edge ids 'src-dst'."""
    x = edges.select(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge"), "src", "dst")
    ends = x.select("edge", F.col("src").alias("v")).union(x.select("edge", F.col("dst")))
    return ends.alias("a").join(ends.alias("b"), F.col("a.v") == F.col("b.v")).where("a.edge < b.edge").select(F.col("a.edge").alias("a"), F.col("b.edge").alias("b")).distinct()


def pack(edges: DataFrame, by: str = "cluster_id") -> DataFrame:
    """One row per cluster with its edges as a sorted list of structs."""
    return edges.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))


def unpack(packed: DataFrame, by: str = "cluster_id") -> DataFrame:
    return packed.select(by, F.explode("edges").alias("e")).select(by, "e.src", "e.dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Rounds of linking each node's larger neighbours, then its smaller
    ones, to the least of them, until none changes; a round's rows are as many as the links."""
    edges = settle(edges.select("src", "dst"))
    work = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        work = settle(small.where("u <> v").distinct())
        now = tuple(work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    ends = both_ways(edges.select("src", "dst")).select("node").distinct()
    return ends.join(work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Eigenvector centrality by power iteration from 1 / sqrt(n), L2 norm each round."""
    x = settle(both_ways(edges.select("src", "dst")))
    rank = x.select("node").distinct()
    n = rank.count()
    rank = rank.withColumn("score", F.lit(1.0 / max(n, 1) ** 0.5))
    for i in range(rounds):
        summed = x.join(rank.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("score").alias("score"))
        norm = summed.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        rank = summed.crossJoin(F.broadcast(norm)).select("node", (F.col("score") / F.col("norm")).alias("score"))  # one row
        if i % 4 == 3:
            rank = settle(rank)
    return rank


def katz(edges: DataFrame, alpha: float = 0.1, rounds: int = 20) -> DataFrame:
    """Katz centrality: x = alpha A x + 1, from 1."""
    x = settle(both_ways(edges.select("src", "dst")))
    rank = x.select("node").distinct().withColumn("score", F.lit(1.0))
    for i in range(rounds):
        rank = x.join(rank.withColumnRenamed("node", "other"), "other").groupBy("node").agg((F.sum("score") * alpha + 1.0).alias("score"))
        if i % 4 == 3:
            rank = settle(rank)
    return rank


def bellman_ford(edges: DataFrame, sources: DataFrame, weight: str = "weight") -> DataFrame:
    """(node, cost): the least cost from any source over undirected edges of non-negative weight; unreachable nodes are
    absent. Up to LINKS links (each from both ends) are relaxed in one task; more by rounds, which relax only the nodes that
    got cheaper, until there are none."""
    x = settle(both_ways(edges.select("src", "dst", F.col(weight).cast("double").alias("w"))).where("node is not null and other is not null"))
    links, least, odd = x.agg(F.count(F.lit(1)), F.min("w"), F.count(F.when(F.col("w").isNull() | F.isnan("w"), 1))).first()
    if least is not None and least < 0:
        raise ValueError("negative weight")
    start = sources.select("node").where("node is not null").distinct()
    if links <= LINKS and not odd:  # unknown weights are left to the rounds
        rows = x.withColumn("start", F.lit(False)).union(start.select("node", F.col("node").alias("other"), F.lit(0.0), F.lit(True)))
        return settle(rows.repartition(1).mapInArrow(_relax, f"node {rows.schema['node'].dataType.simpleString()}, cost double"))
    best = settle(start.withColumn("cost", F.lit(0.0)))
    front = best
    while not front.isEmpty():
        offer = front.join(x, "node").groupBy(F.col("other").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        both = settle(best.join(offer, "node", "full").withColumn("better", F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))))
        front = both.where("better").select("node", F.col("offer").alias("cost"))
        best = both.select("node", F.when(F.col("better"), F.col("offer")).otherwise(F.col("cost")).alias("cost"))
    return best


def _relax(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (node, other, w), and rows that mark where to start, to (node, cost) of all that is reached."""
    rows = pa.Table.from_batches(list(batches))
    if not rows.num_rows:
        return
    every = pa.chunked_array(rows["node"].chunks + rows["other"].chunks).combine_chunks().dictionary_encode()
    ends, keys = every.indices.to_numpy(), every.dictionary
    node, other, w, start = ends[: rows.num_rows], ends[rows.num_rows :], rows["w"].to_numpy(), rows["start"].to_numpy()
    front = np.unique(node[start])
    order = np.argsort(node[~start], kind="stable")
    node, other, w = (v[~start][order] for v in (node, other, w))
    first = np.searchsorted(node, np.arange(len(keys) + 1))
    cost, seen = np.full(len(keys), np.inf), np.zeros(len(keys), bool)
    cost[front], seen[front] = 0.0, True
    while len(front):
        n = first[front + 1] - first[front]
        k = np.repeat(first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to, offer = other[k], np.repeat(cost[front], n) + w[k]
        better = (offer < cost[to]) | ~seen[to]
        to, offer = to[better], offer[better]
        np.minimum.at(cost, to, offer)
        seen[to] = True
        front = np.unique(to)
    got = np.flatnonzero(seen)
    yield from pa.table({"node": keys.take(pa.array(got)), "cost": cost[got]}).to_batches(1 << 17)


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, depth): flood fill by breadth from all sources at once."""
    return bellman_ford(edges.withColumn("weight", F.lit(1.0)), sources).select("node", F.col("cost").cast("long").alias("depth"))


def spanning_forest(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Minimum spanning forest by rounds in which every component takes its cheapest edge (ties by the ends), until no
    edge joins two components."""
    x = settle(edges.select("src", "dst", F.col(weight).cast("double").alias("w")))
    taken = x.where(F.lit(False)).select("src", "dst", "w")
    comp = both_ways(x.select("src", "dst")).select("node").distinct().withColumn("component", F.col("node"))
    while True:
        c = comp.select(F.col("node").alias("src"), F.col("component").alias("cs"))
        d = comp.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
        out = settle(x.join(c, "src").join(d, "dst").where("cs <> cd"))
        if not out.limit(1).count():
            break
        way = F.struct("w", "src", "dst")
        best = out.select(F.col("cs").alias("k"), way.alias("e")).union(out.select(F.col("cd"), way)).groupBy("k").agg(F.min("e").alias("e"))
        taken = settle(taken.union(best.select("e.src", "e.dst", "e.w")).distinct())
        comp = settle(components(taken).join(comp.select("node"), "node", "right").withColumn("component", F.coalesce("component", "node")))
        x = out.select("src", "dst", "w")
    return taken.withColumnRenamed("w", weight)


def gabriel(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose diametral ball holds no vertex strictly inside. Balls meet vertices in grid cells as wide as the
    longest edge's radius."""
    from .rangejoin import within_radius

    x = edge_properties(edges, vertices, key).select("src", "dst", "length")
    a = vertices.select(F.col(key).alias("src"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = vertices.select(F.col(key).alias("dst"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    x = x.join(a, "src").join(b, "dst").select("src", "dst", "length", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in XYZ])
    longest = x.agg(F.max("length").alias("m")).first()["m"]
    if not longest:
        return edges
    near = within_radius(x, vertices.select(key, *XYZ), longest / 2)
    inside = near.where((F.col("d2") < F.col("length") * F.col("length") / 4 * (1 - 1e-12)) & (F.col(f"r_{key}") != F.col("src")) & (F.col(f"r_{key}") != F.col("dst")))
    return edges.join(inside.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
