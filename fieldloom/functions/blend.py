"""Blend operators: of two columns with a weight, and as aggregates of weighted samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import col

MODES = (
    "none", "average", "weight", "multiply", "divide", "min", "max", "copy_target", "copy_source", "add", "subtract", "weighted_add", "weighted_subtract",
    "lerp", "unsigned_min", "unsigned_max", "absolute_min", "absolute_max", "hash", "sorted_hash", "modulo", "modulo_component", "weight_normalize",
)


def blend(a, b, mode: str, weight=1.0) -> Column:
    """The blend of A and B. Division and modulo by 0 give A; `copy_target` is A and `copy_source` is B."""
    a, b, w = col(a), col(b), col(weight)
    match mode:
        case "none" | "copy_target":
            return a
        case "copy_source":
            return b
        case "average":
            return (a + b) / 2
        case "weight" | "weight_normalize" | "weighted_add":
            return a + b * w
        case "weighted_subtract":
            return a - b * w
        case "multiply":
            return a * b
        case "divide":
            return F.when(b == 0, a).otherwise(a / F.nullif(b, F.lit(0)))
        case "min":
            return F.least(a, b)
        case "max":
            return F.greatest(a, b)
        case "add":
            return a + b
        case "subtract":
            return a - b
        case "lerp":
            return a + (b - a) * w
        case "unsigned_min":
            return F.when(F.abs(b) < F.abs(a), b).otherwise(a)
        case "unsigned_max":
            return F.when(F.abs(b) > F.abs(a), b).otherwise(a)
        case "absolute_min":
            return F.least(F.abs(a), F.abs(b))
        case "absolute_max":
            return F.greatest(F.abs(a), F.abs(b))
        case "hash":
            return F.xxhash64(a, b)
        case "sorted_hash":
            return F.xxhash64(F.least(a, b), F.greatest(a, b))
        case "modulo" | "modulo_component":
            return F.when(b == 0, a).otherwise(a % F.nullif(b, F.lit(0)))
    raise ValueError(f"no blend mode {mode!r}")


def aggregate(v, mode: str, weight=1.0, order=None) -> Column:
    """The blend of many samples as an aggregate. Weights are divided by their sum where it is above 1. Modes that depend
    on the order of samples need `order`."""
    v, w = col(v), col(weight)
    match mode:
        case "average":
            return F.avg(v)
        case "weight" | "weight_normalize":
            return F.sum(v * w) / F.greatest(F.sum(w), F.lit(1.0))
        case "add":
            return F.sum(v)
        case "weighted_add":
            return F.sum(v * w)
        case "min":
            return F.min(v)
        case "max":
            return F.max(v)
        case "multiply":
            return F.product(v)
        case "unsigned_min":
            return F.min_by(v, F.abs(v))
        case "unsigned_max":
            return F.max_by(v, F.abs(v))
        case "absolute_min":
            return F.min(F.abs(v))
        case "absolute_max":
            return F.max(F.abs(v))
        case "copy_target":
            return F.min_by(v, col(order))
        case "copy_source":
            return F.max_by(v, col(order))
        case "hash":
            return F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), v.alias("v")))), lambda s: s["v"]))
        case "sorted_hash":
            return F.xxhash64(F.array_sort(F.collect_list(v)))
        case "lerp":
            items = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), v.alias("v"), w.alias("w"))))
            first = F.element_at(items, 1)["v"].cast("double")
            return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), first, lambda acc, s: acc + (s["v"] - acc) * s["w"])
    raise ValueError(f"no aggregate blend {mode!r}")


@dataclass(frozen=True)
class Blend:
    """A blend of two columns of a table into one: compiled by uber_blend()."""

    a: str
    b: str
    mode: str
    weight: object = 1.0
    out: str | None = None

    def column(self) -> Column:
        return blend(self.a, self.b, self.mode, self.weight).alias(self.out or self.a)


def uber_blend(df: DataFrame, blends: list[Blend]) -> DataFrame:
    """Blends in order: each sees what the ones before wrote."""
    for b in blends:
        df = df.withColumn(b.out or b.a, b.column())
    return df


def blend_all(df: DataFrame, a: str, b: str, mode: str, weight=1.0) -> DataFrame:
    """Blend all pairs of columns a + name and b + name into name, in one projection."""
    names = [c[len(a) :] for c in df.columns if c.startswith(a) and b + c[len(a) :] in df.columns]
    return df.select("*", *[blend(a + n, b + n, mode, weight).alias(n) for n in names])
