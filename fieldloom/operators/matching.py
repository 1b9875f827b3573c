"""Matching datasets: rules that compile to join conditions over two catalogs, `c` (candidates) and `t` (targets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import numeric, string
from ..functions.maths import fraction, safe_index


def by_attributes(a: str, op: str, b: str, text: bool = False, swap: bool = False, invert: bool = False) -> Column:
    """A candidate's attribute compared with a target's."""
    x, y = F.col(f"c.{a}"), F.col(f"t.{b}")
    x, y = (y, x) if swap else (x, y)
    out = string(x, op, y) if text else numeric(x, op, y)
    return ~out if invert else out


def by_index(index: str, size: int, safety: str = "ignore", invert: bool = False, target: str = "dataset_index") -> Column:
    """A candidate's index, made safe, is the target's."""
    i = safe_index(F.col(f"c.{index}"), F.lit(size), safety)
    return F.when(i < 0, F.lit(invert)).otherwise((i == F.col(f"t.{target}")) != F.lit(invert))


def shared_tags(mode: str = "any", tag: str | None = None, invert: bool = False) -> Column:
    """Both have a given tag, share any, or have all of the candidate's."""
    a, b = F.col("c.tags"), F.col("t.tags")
    if tag is not None:
        out = F.array_contains(a, tag) & F.array_contains(b, tag)
    else:
        out = F.arrays_overlap(a, b) if mode == "any" else F.size(F.array_except(a, b)) == 0
    return ~out if invert else out


def tag_attribute(tag: str, op: str, attribute: str) -> Column:
    """A candidate's tag value, as a number, compared with a target's attribute."""
    return F.coalesce(numeric(F.try_element_at(F.col("c.tag_values"), F.lit(tag)).try_cast("double"), op, F.col(f"t.{attribute}")), F.lit(False))


def overlap(names=("x", "y"), ratio: float = 0.0) -> Column:
    """Boxes (min_, max_ columns) meet, with at least a share of the candidate's in common."""
    parts, shared, own = F.lit(True), F.lit(1.0), F.lit(1.0)
    for a in names:
        lo, hi = F.greatest(f"c.min_{a}", f"t.min_{a}"), F.least(f"c.max_{a}", f"t.max_{a}")
        parts, shared, own = parts & (lo <= hi), shared * (hi - lo), own * (F.col(f"c.max_{a}") - F.col(f"c.min_{a}"))
    return parts if not ratio else parts & (shared >= own * ratio)


def randomly(threshold: float, seed: int, c: str, t: str) -> Column:
    return fraction(seed, F.col(f"c.{c}"), F.col(f"t.{t}")) < threshold


def match(candidates: DataFrame, targets: DataFrame, required: list[Column], optional: list[Column] = (), limit: int | None = None, key: str = "dataset_id", target_key: str = "dataset_id") -> DataFrame:
    """Pairs (candidate, target) for which every required rule and any optional one hold; at most `limit` targets each,
    by the order of their keys. Equalities among the rules become the join's keys."""
    rules = list(required) + ([reduce(lambda a, b: a | b, optional)] if optional else [])
    if not rules:
        raise ValueError("at least one rule")
    on = reduce(lambda a, b: a & b, rules)
    pairs = candidates.alias("c").join(targets.alias("t"), on).select(F.col(f"c.{key}").alias("candidate"), F.col(f"t.{target_key}").alias("target"))
    if limit is None:
        return pairs
    w = Window.partitionBy("candidate").orderBy("target")
    return pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def match_values(candidates: DataFrame, targets: DataFrame, value: Column, op: str, attribute: str, key: str = "dataset_id", target_key: str = "dataset_id", deal: int = 32) -> DataFrame:
    """Pairs (candidate, target) for which a candidate's value, as a number, compares with a target's attribute.

    Only distinct values are compared with distinct attributes; rows meet by equality, each value's targets dealt out.
    """
    c = candidates.select(F.col(key).alias("candidate"), value.try_cast("double").alias("__v")).where("__v is not null")
    t = targets.select(F.col(target_key).alias("target"), F.col(attribute).alias("__a")).where("__a is not null")
    v, a = c.select("__v").distinct(), t.select("__a").distinct()
    pairs = v.join(a, numeric("__v", op, F.col("__a")))
    wanted = c.join(pairs, "__v").select("candidate", "__a", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("__d"))
    dealt = t.withColumn("__d", F.pmod(F.xxhash64("target"), F.lit(deal)).cast("int"))
    return wanted.join(dealt, ["__a", "__d"]).select("candidate", "target")


def data_match(candidates: DataFrame, targets: DataFrame, rule: Column, invert: bool = False) -> DataFrame:
    """Candidates that some, or with invert no, target matches."""
    return candidates.alias("c").join(targets.alias("t"), rule, "left_anti" if invert else "left_semi")


def copy_tags(candidates: DataFrame, pairs: DataFrame, targets: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Candidates with the tags of all their targets added, sorted."""
    theirs = pairs.join(targets.select(F.col(key).alias("target"), F.col("tags").alias("__t")), "target")
    theirs = theirs.groupBy("candidate").agg(F.array_distinct(F.flatten(F.collect_list("__t"))).alias("__t"))
    x = candidates.join(theirs.withColumnRenamed("candidate", key), key, "left")
    return x.withColumn("tags", F.array_sort(F.array_union("tags", F.coalesce("__t", F.array().cast("array<string>"))))).drop("__t")
