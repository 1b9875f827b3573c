"""Filters: predicates over rows, datasets and neighbours, and the nodes that route rows by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import col, numeric, string
from ..functions.maths import fraction, remap, safe_index
from .rangejoin import nearest


def within_range(v, ranges: list[tuple[float, float]], inclusive: bool = True, invert: bool = False) -> Column:
    """In any of the ranges."""
    v = col(v)
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | (((v >= a) & (v <= b)) if inclusive else ((v > a) & (v < b)))
    return ~hit if invert else hit


def modulo(a, b, op: str, value, zero: bool = False, tolerance: float = 1e-3) -> Column:
    """(a mod b) compared with a value; `zero` where a or b is 0. The remainder has the sign of a."""
    a, b = col(a), col(b)
    return F.when((a == 0) | (b == 0), F.lit(zero)).otherwise(numeric(a % F.nullif(b, F.lit(0)), op, value, tolerance))


def mean_band(df: DataFrame, v: str, below: float, above: float, method: str = "average", by: str = "dataset_id", fixed: float = 0.0, relative: bool = False, tolerance: float = 1.0) -> DataFrame:
    """df with `passes`: whether v is in [reference - below, reference + above) of its dataset.

    The reference is the average, the median, the central value (min + max) / 2, a fixed value, or the smallest or
    largest most frequent value (mode_min, mode_max) of v rounded to the tolerance. Relative bounds are shares of the
    greatest value. Reference values are formed by dataset and joined back, so datasets of any size are combined early.
    """
    keys = df.select(by, col(v).alias("__v"))
    if method in ("mode_min", "mode_max"):
        counts = keys.withColumn("__r", F.floor(F.col("__v") / tolerance + 0.5) * tolerance).groupBy(by, "__r").agg(F.count(F.lit(1)).alias("__n"))
        sign = -1 if method == "mode_min" else 1
        stats = counts.groupBy(by).agg(F.max_by("__r", F.struct("__n", F.col("__r") * sign)).alias("__ref"))
        stats = stats.join(keys.groupBy(by).agg(F.max("__v").alias("__max")), by)
    else:
        ref = {"average": F.avg("__v"), "median": F.median("__v"), "central": (F.min("__v") + F.max("__v")) / 2, "fixed": F.max(F.lit(fixed))}[method]
        stats = keys.groupBy(by).agg(ref.alias("__ref"), F.max("__v").alias("__max"))
    scale = F.col("__max") if relative else F.lit(1.0)
    value = col(v) / F.col("__max") if relative else col(v)
    ref = F.col("__ref") / F.col("__max") if relative else F.col("__ref")
    del scale
    return df.join(stats, by).withColumn("passes", (value >= ref - below) & (value < ref + above)).drop("__ref", "__max")


def self_compare(df: DataFrame, v: str, op: str, offset: int = 1, by: str = "dataset_id", order: str = "idx", fallback: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """df with `passes`: v compared with v of the row `offset` ahead; `fallback` where there is none."""
    there = F.lead(col(v), offset) if offset >= 0 else F.lag(col(v), -offset)
    other = there.over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("passes", F.coalesce(numeric(v, op, other, tolerance), F.lit(fallback)))


def self_compare_string(df: DataFrame, v: str, op: str, offset: int = 1, by: str = "dataset_id", order: str = "idx", fallback: bool = False) -> DataFrame:
    """df with `passes`: a text compared with that of the row `offset` ahead; `fallback` where there is none."""
    there = F.lead(col(v), offset) if offset >= 0 else F.lag(col(v), -offset)
    return df.withColumn("__o", there.over(Window.partitionBy(by).orderBy(order))).withColumn("passes", F.coalesce(string(v, op, F.col("__o")), F.lit(fallback))).drop("__o")


def constant(value: bool, invert: bool = False) -> Column:
    """The same answer for every row."""
    return F.lit(value != invert)


def self_compare_index(df: DataFrame, v: str, op: str, index, by: str = "dataset_id", order: str = "idx", safety: str = "ignore", fallback: bool = False) -> DataFrame:
    """df with `passes`: v compared with v of the row at an index of its dataset, made safe."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    x = df.join(sizes, by).withColumn("__i", safe_index(index, F.col("__n"), safety))
    there = df.select(F.col(by), F.col(order).alias("__i"), col(v).alias("__w"))
    return x.join(there, [by, "__i"], "left").withColumn("passes", F.coalesce(numeric(v, op, F.col("__w")), F.lit(fallback))).drop("__n", "__i", "__w")


def random_filter(threshold: float, seed: int, *keys) -> Column:
    """A seeded draw per key: true below the threshold."""
    return fraction(seed, *keys) < threshold


def random_ratio(df: DataFrame, ratio: float, seed: int, key: str, by: str = "dataset_id") -> DataFrame:
    """The share `ratio` (rounded half up) of each dataset with the smallest draws."""
    sizes = df.groupBy(by).agg(F.floor(F.count(F.lit(1)) * ratio + 0.5).alias("__n"))
    drawn = df.withColumn("__d", fraction(seed, key))
    place = F.row_number().over(Window.partitionBy(by).orderBy("__d", key))
    return drawn.withColumn("__r", place).join(sizes, by).where("__r <= __n").drop("__d", "__r", "__n")


def contains(df: DataFrame, v: str, values: DataFrame, other: str, invert: bool = False) -> DataFrame:
    """Rows whose value is, or with invert is not, among the values of another table."""
    there = values.select(F.col(other).alias(v)).distinct()
    return df.join(there, v, "left_anti" if invert else "left_semi")


def compare_nearest(points: DataFrame, targets: DataFrame, a, op: str, b: str, key: str = "id", names=("x", "y", "z"), skip_self: bool = False) -> DataFrame:
    """points with `passes`: a compared with column b of the nearest target; false without any."""
    found = nearest(points, targets, 1, key, names, skip_self).select(key, F.col(f"r_{b}").alias("__b"))
    return points.join(found, key, "left").withColumn("passes", F.coalesce(numeric(a, op, F.col("__b")), F.lit(False))).drop("__b")


def distance_nearest(points: DataFrame, targets: DataFrame, op: str, threshold: float, key: str = "id", names=("x", "y", "z"), skip_self: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """points with `passes`: the distance to the nearest target compared; false without any."""
    found = nearest(points, targets, 1, key, names, skip_self).select(key, F.sqrt("d2").alias("__d"))
    return points.join(found, key, "left").withColumn("passes", F.coalesce(numeric("__d", op, threshold, tolerance), F.lit(False))).drop("__d")


def segment_length(df: DataFrame, op: str, threshold: float, offset: int = 1, by: str = "path_id", fallback: bool = False) -> DataFrame:
    """df with `passes`: the distance to the point `offset` ahead, compared."""
    w = Window.partitionBy(by).orderBy("idx")
    there = [F.lead(a, offset).over(w) for a in ("x", "y", "z")]
    d = F.sqrt(sum(((F.col(a) - t) * (F.col(a) - t) for a, t in zip(("x", "y", "z"), there)), F.lit(0.0)))
    return df.withColumn("passes", F.coalesce(numeric(d, op, threshold), F.lit(fallback)))


def angle(df: DataFrame, op: str, threshold: float, by: str = "path_id", fallback: bool = False) -> DataFrame:
    """df with `passes`: the dot product of the unit directions from the last and to the next point, compared."""
    w = Window.partitionBy(by).orderBy("idx")
    before = [F.col(a) - F.lag(a).over(w) for a in ("x", "y", "z")]
    after = [F.lead(a).over(w) - F.col(a) for a in ("x", "y", "z")]
    size = lambda v: F.sqrt(sum((p * p for p in v), F.lit(0.0)))
    both = sum((p * q for p, q in zip(before, after)), F.lit(0.0)) / F.nullif(size(before) * size(after), F.lit(0.0))
    return df.withColumn("__dot", both).withColumn("passes", F.coalesce(numeric("__dot", op, threshold), F.lit(fallback))).drop("__dot")


def dot_filter(df: DataFrame, a: tuple[str, ...], b: tuple[float, ...], op: str, threshold: float, unsigned: bool = False) -> Column:
    """The dot product of two normalised vectors, mapped to [0, 1] or unsigned, compared."""
    size = F.sqrt(sum((F.col(p) * F.col(p) for p in a), F.lit(0.0)))
    norm = sum(q * q for q in b) ** 0.5
    value = sum((F.col(p) * q for p, q in zip(a, b)), F.lit(0.0)) / F.nullif(size * norm, F.lit(0.0))
    return F.coalesce(numeric(F.abs(value) if unsigned else remap(value, -1.0, 1.0), op, threshold), F.lit(False))


def tag_check(tag: str, match: str = "equals", tags: str = "tags") -> Column:
    """Whether any tag of a dataset equals, contains, starts or ends with a text."""
    test = {"equals": lambda t: t == tag, "contains": lambda t: F.contains(t, F.lit(tag)), "starts": lambda t: F.startswith(t, F.lit(tag)), "ends": lambda t: F.endswith(t, F.lit(tag))}[match]
    return F.exists(tags, test)


def hierarchical_tag(tag: str, tags: str = "tags", separator: str = ".") -> Column:
    """Whether any tag is the tag or lies below it."""
    return F.exists(tags, lambda t: (t == tag) | F.startswith(t, F.lit(tag + separator)))


def tag_value(name: str, op: str, value: float, values: str = "tag_values") -> Column:
    """A tag's value as a number, compared; false where there is none."""
    return F.coalesce(numeric(F.try_element_at(values, F.lit(name)).try_cast("double"), op, value), F.lit(False))


def entry_count(df: DataFrame, op: str, n: int, by: str = "dataset_id") -> DataFrame:
    """Rows of the datasets whose number of rows passes: counts are formed early and joined back."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(numeric("__n", op, n)).select(by)
    return df.join(sizes, by, "left_semi")


def data_bounds(df: DataFrame, axis: str, op: str, size: float, by: str = "dataset_id") -> DataFrame:
    """Rows of the datasets whose extent along an axis passes."""
    sizes = df.groupBy(by).agg((F.max(axis) - F.min(axis)).alias("__s")).where(numeric("__s", op, size)).select(by)
    return df.join(sizes, by, "left_semi")


def attribute_check(df: DataFrame, name: str, kind: str | None = None) -> bool:
    """Whether a column is there, of a type if one is given: decided when the plan is made."""
    return name in df.columns and (kind is None or df.schema[name].dataType.simpleString() == kind)


def picker(df: DataFrame, picks: list, by: str = "dataset_id", safety: str = "ignore", invert: bool = False) -> DataFrame:
    """Rows at indices: integers count from the start (negative: from the end), fractions are relative, pairs are ranges."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    x = df.join(sizes, by)
    hit = F.lit(False)
    for p in picks:
        if isinstance(p, tuple):
            hit = hit | F.col("idx").between(*p)
        else:
            at = F.floor(F.lit(p) * F.col("__n")) if isinstance(p, float) else F.lit(p) + (F.col("__n") if p < 0 else F.lit(0))
            hit = hit | (F.col("idx") == safe_index(at, F.col("__n"), safety))
    return x.where(~hit if invert else hit).drop("__n")


def pick_set(df: DataFrame, picks: DataFrame, index: str) -> DataFrame:
    """Rows at the indices that a table lists; those outside a dataset pick nothing."""
    return df.join(picks.select(F.col(index).cast("long").alias("idx")).distinct(), "idx", "left_semi").select(df.columns)


def pick_ranges(df: DataFrame, ranges: DataFrame, low: str, high: str, block: int = 1024) -> DataFrame:
    """Rows whose index lies in any of a table's ranges, both ends included: an equi-join on blocks of indices that the
    ranges touch, with a residual test. Ranges beyond the last index are cut to it;
    a range with a null end picks nothing."""
    last = df.agg(F.max("idx").alias("__last"))
    r = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    r = r.select(F.greatest(F.col(low).cast("long"), F.lit(0)).alias("__lo"), F.col(high).cast("long").alias("__hi")).distinct()
    r = r.crossJoin(F.broadcast(last)).withColumn("__hi", F.least("__hi", "__last")).where("__lo <= __hi")  # one row
    r = r.select("__lo", "__hi", F.explode(F.sequence(F.floor(F.col("__lo") / block), F.floor(F.col("__hi") / block))).alias("__b"))
    x = df.withColumn("__b", F.floor(F.col("idx") / block))
    return x.join(r, (x["__b"] == r["__b"]) & F.col("idx").between(F.col("__lo"), F.col("__hi")), "left_semi").select(df.columns)


def inside_box(low: tuple[float, ...], high: tuple[float, ...], names=("x", "y", "z")) -> Column:
    out = F.lit(True)
    for a, lo, hi in zip(names, low, high):
        out = out & F.col(a).between(lo, hi)
    return out


def uber_filter(df: DataFrame, condition: Column, swap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inside and outside rows; null counts as outside."""
    ok = F.coalesce(condition, F.lit(False))
    inside, outside = df.where(ok), df.where(~ok)
    return (outside, inside) if swap else (inside, outside)


def cascade(conditions: list[Column]) -> Column:
    """The number of the first group that passes; the number of groups where none does."""
    out = F.lit(len(conditions)).cast("long")
    for i in reversed(range(len(conditions))):
        out = F.when(F.coalesce(conditions[i], F.lit(False)), F.lit(i).cast("long")).otherwise(out)
    return out


def uber_filter_data(df: DataFrame, condition: Column, mode: str = "all", share: float = 0.5, by: str = "dataset_id") -> DataFrame:
    """Rows of the datasets of which all, any, or at least a share of rows pass."""
    ok = F.coalesce(condition, F.lit(False))
    test = {"all": F.bool_and(ok), "any": F.bool_or(ok), "partial": F.avg(ok.cast("int")) >= share}[mode]
    return df.join(df.groupBy(by).agg(test.alias("__ok")).where("__ok").select(by), by, "left_semi")


def branch(df: DataFrame, v: str, values: list) -> dict:
    """A table for each value, and the rest under None."""
    out = {value: df.where(F.col(v) == F.lit(value)) for value in values}
    return out | {None: df.where(~F.coalesce(F.col(v).isin(values), F.lit(False)))}
