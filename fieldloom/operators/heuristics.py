"""Scores of travel along edges, lower is better, and filters of nodes and edges by direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import remap
from .clusters import _spokes

XYZ = ("x", "y", "z")


def steps(edges: DataFrame, vertices: DataFrame, values: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """Every edge travelled both ways: node, other, length, direction, the node's position (at_*) and values of both ends
    (from_*, to_*). Edges without a vertex at both ends have no row."""
    a = vertices.select(F.col(key).alias("node"), *[F.col(c).alias(f"at_{c}") for c in XYZ], *[F.col(v).alias(f"from_{v}") for v in values])
    b = vertices.select(F.col(key).alias("other"), *[F.col(v).alias(f"to_{v}") for v in values])
    x = _spokes(edges, vertices).join(a, "node")
    return x.join(b, "other") if values else x


def steepness(up: tuple[float, float, float] = (0.0, 0.0, 1.0), absolute: bool = True) -> Column:
    """How much a step goes along the up vector (a unit vector): 0 to 1; unsigned, or from down (0) to up (1)."""
    dot = sum((F.col(f"dir_{a}") * u for a, u in zip(XYZ, up)), F.lit(0.0))
    return F.abs(dot) if absolute else remap(dot, -1.0, 1.0)


def azimuth(goal: tuple[float, float, float]) -> Column:
    """The step's direction against the direction to the goal: 1 where they agree, 0 where they oppose (as the node
    scores it: invert it to be drawn to the goal); one half at the goal itself."""
    to = [F.lit(float(g)) - F.col(f"at_{a}") for a, g in zip(XYZ, goal)]
    far = F.nullif(F.sqrt(sum((t * t for t in to), F.lit(0.0))), F.lit(0.0))
    dot = F.coalesce(sum((F.col(f"dir_{a}") * t for a, t in zip(XYZ, to)), F.lit(0.0)) / far, F.lit(0.0))
    return (dot + 1) / 2


def gradient(value: str, mode: str = "increasing", by_length: bool = False, low: float = 0.0, high: float = 1.0) -> Column:
    """The change of a value along a step. `increasing` and `decreasing` favour one sign (changes clamped to -1..1); `avoid`
    and `seek` score the size of the change between low and high."""
    change = F.col(f"to_{value}") - F.col(f"from_{value}")
    if by_length:
        change = F.when(F.col("length") > 1e-4, change / F.nullif("length", F.lit(0.0))).otherwise(change)
    held = F.least(F.greatest(change, F.lit(-1.0)), F.lit(1.0))
    size = F.least(F.greatest((F.abs(change) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return {"increasing": (1 - held) / 2, "decreasing": (1 + held) / 2, "avoid": size, "seek": 1 - size}[mode]


def least_nodes() -> Column:
    """The same for each step, so that fewer nodes are cheaper."""
    return F.lit(0.5)


def attribute(x: DataFrame, value: str, out: str = "score") -> DataFrame:
    """x with a value mapped from its own range to 0..1; 0 where all are equal."""
    ends = x.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    score = F.coalesce((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.0))
    return x.crossJoin(F.broadcast(ends)).withColumn(out, score).drop("__lo", "__hi")  # one row


def node_direction(edges: DataFrame, vertices: DataFrame, way: tuple[float, float, float], least_dot: float, mode: str = "any", least: int = 1) -> DataFrame:
    """node and passes: whether any, all, or at least a number of a node's edges go a way (unit vector), seen from the node."""
    ok = sum((F.col(f"dir_{a}") * w for a, w in zip(XYZ, way)), F.lit(0.0)) >= least_dot
    test = {"any": F.bool_or(ok), "all": F.bool_and(ok), "some": F.count(F.when(ok, 1)) >= least}[mode]
    return _spokes(edges, vertices).groupBy("node").agg(test.alias("passes"))


def node_angle(edges: DataFrame, vertices: DataFrame, most_dot: float, leaves: bool = False, others: bool = False) -> DataFrame:
    """node and passes: whether the two edges of a binary node, seen from it, have a dot product of at most a bound; leaves
    and nodes of more edges have a fixed answer.

    With two edges the dot product follows from the sum of both unit vectors, |a + b|^2 = |a|^2 + |b|^2 + 2 a.b, so a node's
    edges are added up and never paired.
    """
    s = _spokes(edges, vertices)
    x = s.groupBy("node").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"dir_{a}").alias(f"__{a}") for a in XYZ], F.sum(sum((F.col(f"dir_{a}") * F.col(f"dir_{a}") for a in XYZ), F.lit(0.0))).alias("__s"))
    dot = (sum((F.col(f"__{a}") * F.col(f"__{a}") for a in XYZ), F.lit(0.0)) - F.col("__s")) / 2
    return x.select("node", F.when(F.col("__n") == 1, F.lit(leaves)).when(F.col("__n") > 2, F.lit(others)).otherwise(dot <= most_dot).alias("passes"))
