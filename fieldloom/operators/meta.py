"""Attributes and datasets: statistics, remapping, partitioning, hashing, sorting, indexing, reducing and merging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import bit_operation, col, flags, numeric
from ..functions.maths import fraction, snap, truncate


def histogram(df: DataFrame, v: str, by: str = "dataset_id") -> DataFrame:
    """Occurrences of each value of each dataset."""
    return df.groupBy(by, col(v).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))


def attribute_stats(df: DataFrame, v: str, default=0, by: str = "dataset_id") -> DataFrame:
    """Statistics of an attribute of each dataset; null counts as the default. One pass over the histogram.

    unique_values are those that occur once, different_values all distinct ones; `set` statistics leave the default out.
    """
    h = histogram(df.withColumn("__v", F.coalesce(col(v), F.lit(default))), "__v", by)
    own = F.col("value") != default
    once = F.col("occurrences") == 1
    total = F.sum("occurrences")
    return h.groupBy(by).agg(
        total.cast("long").alias("samples"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("occurrences")) / total).alias("average"),
        F.min(F.when(own, F.col("value"))).alias("set_min"), F.max(F.when(own, F.col("value"))).alias("set_max"),
        F.coalesce(F.sum(F.when(~own, F.col("occurrences"))), F.lit(0)).cast("long").alias("default_values"),
        F.count(F.when(once, 1)).alias("unique_values"), F.count(F.lit(1)).alias("different_values"),
        F.count(F.when(once & own, 1)).alias("unique_set_values"), F.count(F.when(own, 1)).alias("different_set_values"),
        F.bool_and(~own).alias("has_only_default"), F.bool_and(own).alias("has_only_set"), F.bool_and(once).alias("has_only_unique"),
    )


def text_mode(df: DataFrame, v: str, by: str = "dataset_id") -> DataFrame:
    """The most frequent value of each dataset, ties to the smallest."""
    h = histogram(df.where(col(v).isNotNull()), v, by)
    return h.groupBy(by).agg(F.min_by("value", F.struct(-F.col("occurrences"), F.col("value"))).alias("mode"))


def attribute_remap(
    df: DataFrame, v: str, out_min: float = 0.0, out_max: float = 1.0, by: str = "dataset_id", in_min: float | None = None, in_max: float | None = None,
    full_range: bool = False, clamp: bool = False, preserve_sign: bool = True, step: float = 0.0, mode: str = "none",
) -> DataFrame:
    """df with `remapped`. The input range is the dataset's unless fixed; full_range starts it at 0 or below. Without
    preserve_sign, absolute values are mapped. The dataset's range is aggregated and joined back."""
    value = col(v) if preserve_sign else F.abs(col(v))
    ends = df.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = df.join(ends, by)
    lo = F.lit(in_min) if in_min is not None else F.least(F.col("__lo"), F.lit(0.0)) if full_range else F.col("__lo")
    hi = F.lit(in_max) if in_max is not None else F.col("__hi")
    t = F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / F.nullif(hi - lo, F.lit(0.0)))
    if clamp:
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    out = F.lit(out_min) + t * (out_max - out_min)
    out = truncate(snap(out, step), mode) if step else truncate(out, mode)
    return x.withColumn("remapped", out).drop("__lo", "__hi")


@dataclass(frozen=True)
class PartitionRule:
    """A rule that turns a column into a whole key: floor (no key 0), ceil, round or modulo; then absolute, inverted, clamped."""

    column: str
    size: float = 1.0
    offset: float = 0.0
    upscale: float = 1.0
    mode: str = "floor"
    absolute: bool = False
    invert: bool = False
    low: int | None = None
    high: int | None = None

    def key(self) -> Column:
        v = F.col(self.column).cast("double") * self.upscale + self.offset
        match self.mode:
            case "floor":
                k = (v / self.size).cast("long") + F.when(v < 0, -1).otherwise(1)
            case "ceil":
                k = F.ceil(v / self.size).cast("long")
            case "round":
                k = F.floor(v / self.size + 0.5).cast("long")
            case "modulo":
                k = v.cast("long") % int(self.size)
            case _:
                raise ValueError(f"no partition mode {self.mode!r}")
        k = F.abs(k) if self.absolute else k
        k = -k if self.invert else k
        k = F.greatest(k, F.lit(self.low)) if self.low is not None else k
        return F.least(k, F.lit(self.high)) if self.high is not None else k


def partition_by_values(df: DataFrame, rules: list[PartitionRule]) -> DataFrame:
    """df with a key of each rule (key_0 ...), their sum, and the partition's index in the order of the keys.

    Keys are made distinct before they are numbered, so the numbering sees a row for each partition only.
    """
    names = [f"key_{i}" for i in range(len(rules))]
    x = df.withColumns({n: r.key() for n, r in zip(names, rules)})
    keys = x.select(*names).distinct().withColumn("partition_index", (F.row_number().over(Window.orderBy(*names)) - 1).cast("long"))
    return x.join(keys, names).withColumn("key_sum", reduce(lambda a, b: a + b, [F.col(n) for n in names]))


def attribute_hash(df: DataFrame, v: str, scope: str = "all", ordered: bool = True, by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """A fingerprint of each dataset's values: an MD5 of the text of all, the distinct, or the first and last values.

    Sorted values (the default) or those in the order of rows are joined; the list is of one dataset.
    """
    text = col(v).cast("string")
    if scope in ("first", "last", "first_last"):
        ends = {"first": [F.min_by(text, order)], "last": [F.max_by(text, order)], "first_last": [F.min_by(text, order), F.max_by(text, order)]}[scope]
        return df.groupBy(by).agg(F.md5(F.concat_ws(",", *ends)).alias("hash"))
    values = F.collect_set(text) if scope == "uniques" else F.collect_list(text)
    if ordered or scope == "uniques":
        values = F.array_sort(values)
    else:
        values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"])
    return df.groupBy(by).agg(F.md5(F.array_join(values, ",")).alias("hash"))


@dataclass(frozen=True)
class SortRule:
    """A key of a sort. A tolerance above 1e-9 makes ties of values in one bucket of that width."""

    column: str
    descending: bool = False
    tolerance: float = 0.0

    def key(self) -> Column:
        v = F.col(self.column)
        v = F.floor(v / self.tolerance + 0.5) if self.tolerance > 1e-9 else v
        return v.desc() if self.descending else v.asc()


def sort_points(df: DataFrame, rules: list[SortRule], by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """df with `sorted_idx`: places in each dataset by the rules, then by the old index."""
    w = Window.partitionBy(by).orderBy(*[r.key() for r in rules], order)
    return df.withColumn("sorted_idx", (F.row_number().over(w) - 1).cast("long"))


def sort_data(datasets: DataFrame, rules: list[SortRule], key: str = "dataset_id") -> DataFrame:
    """A catalog of datasets with its place by dataset-level rules."""
    w = Window.orderBy(*[r.key() for r in rules], key)
    return datasets.withColumn("dataset_index", (F.row_number().over(w) - 1).cast("long"))


def write_index(df: DataFrame, by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """df with `index`, `normalized` (0 to 1) and `entries` of the dataset."""
    w = Window.partitionBy(by)
    x = df.withColumn("index", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("entries", F.count(F.lit(1)).over(w))
    return x.withColumn("normalized", F.when(F.col("entries") > 1, F.col("index") / (F.col("entries") - 1)).otherwise(F.lit(0.0)))


def reduce_data(df: DataFrame, v: str, mode: str = "sum", by: str = "dataset_id", order: str = "idx", delimiter: str = ", ") -> DataFrame:
    """One value for each dataset: min, max, sum, average, join (in order), hash or sorted_hash (MD5 of the joined text)."""
    text = col(v).cast("string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), text.alias("t")))), lambda s: s["t"])
    how = {
        "min": F.min(col(v)), "max": F.max(col(v)), "sum": F.sum(col(v)), "average": F.avg(col(v)), "join": F.array_join(in_order, delimiter),
        "hash": F.md5(F.array_join(in_order, ",")), "sorted_hash": F.md5(F.array_join(F.array_sort(F.collect_list(text)), ",")),
    }[mode]
    return df.groupBy(by).agg(how.alias("reduced"))


def hoist(df: DataFrame, names: list[str], pick: str = "first", by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """Element values as dataset values: of the first or last element."""
    f = F.min_by if pick == "first" else F.max_by
    return df.groupBy(by).agg(*[f(c, order).alias(c) for c in names])


def cleanup(df: DataFrame, drop: list[str] = (), starts: str | None = None) -> DataFrame:
    """df without columns by name or prefix."""
    return df.drop(*[c for c in df.columns if c in drop or (starts and c.startswith(starts))])


def merge(tables: list[DataFrame], dataset_id: str = "merged", by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """One dataset of the rows of many, in the order of the tables; columns of the same name must have one type.

    `source_id` keeps the dataset that a row came from; the new index is numbered over (table, source, old index).
    """
    kinds: dict = {}
    for t in tables:
        for f in t.schema:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name!r} has several types")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)])
    rows = rows.withColumn("source_id", F.col(by))
    start = rows.groupBy("__table", "source_id").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__table", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    start = start.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("__table", "source_id").orderBy(order)) - 1
    out = rows.withColumn("__i", inner).join(start, ["__table", "source_id"])
    return out.withColumn(order, (F.col("__start") + F.col("__i")).cast("long")).withColumn(by, F.lit(dataset_id)).drop("__table", "__start", "__i")


def merge_by_tag(df: DataFrame, datasets: DataFrame, priority: list[str], by: str = "dataset_id") -> DataFrame:
    """df with `merged_id`: the first tag of the priority list that its dataset has, else the dataset's own id."""
    first = F.element_at(F.filter(F.array(*[F.lit(t) for t in priority]), lambda t: F.array_contains("tags", t)), 1)
    first = F.when(F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in priority]))) > 0, first)
    return df.join(datasets.select(by, F.coalesce(first, F.col(by)).alias("merged_id")), by)


def discard_by_count(df: DataFrame, low: int | None = None, high: int | None = None, by: str = "dataset_id") -> DataFrame:
    """Rows of the datasets with at least `low` and at most `high` rows."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    keep = n.where((F.col("__n") >= (low or 0)) & (F.lit(True) if high is None else F.col("__n") <= high)).select(by)
    return df.join(keep, by, "left_semi")


def discard_same(df: DataFrame, names: list[str], tolerance: float = 0.1, keep: str = "first", by: str = "dataset_id", order: str = "idx") -> DataFrame:
    """Rows of the datasets that aren't the same as another: number of rows and floored values at the tolerance, as an MD5
    of the dataset. keep: first, last, or all (`keep='none'` drops every repeated dataset)."""
    text = F.concat_ws(":", *[F.floor(F.col(c) / tolerance).cast("string") for c in names])
    prints = df.groupBy(by).agg(F.md5(F.array_join(F.array_sort(F.collect_list(text)), ",")).alias("print"), F.count(F.lit(1)).alias("n"))
    alike = prints.groupBy("print", "n").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count(F.lit(1)).alias("many"))
    kept = {"first": F.col("first"), "last": F.col("last"), "none": F.when(F.col("many") == 1, F.col("first"))}[keep]
    return df.join(alike.select(kept.alias(by)).where(F.col(by).isNotNull()), by, "left_semi")


def write_states(df: DataFrame, states: list[tuple[Column, int, int]], start: int = 0, out: str = "states") -> DataFrame:
    """df with a mask: each state (condition, bits if it passes, bits if it fails) adds its bits."""
    value = F.lit(start).cast("long")
    for condition, yes, no in states:
        value = value.bitwiseOR(F.when(F.coalesce(condition, F.lit(False)), F.lit(yes).cast("long")).otherwise(F.lit(no).cast("long")))
    return df.withColumn(out, value)


def bitmask_operation(df: DataFrame, v: str, op: str, mask: int) -> DataFrame:
    return df.withColumn(v, bit_operation(v, op, F.lit(mask).cast("long")))


def bitmask_merge(df: DataFrame, v: str, op: str = "or", by: str = "dataset_id") -> DataFrame:
    f = {"or": F.bit_or, "and": F.bit_and, "xor": F.bit_xor}[op]
    return df.groupBy(by).agg(f(v).alias(v))


def condition_flags(df: DataFrame, conditions: list[Column], out: str = "flags") -> DataFrame:
    return df.withColumn(out, flags(conditions))


def write_guid(df: DataFrame, seed: str, *keys: str) -> DataFrame:
    """df with a GUID of the keys: the MD5 of their text, in the usual groups of digits."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return df.withColumn("guid", F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])))


def refresh_seed(df: DataFrame, base: int, *keys: str) -> DataFrame:
    return df.withColumn("seed", F.floor(fraction(base, *keys) * (1 << 31)).cast("long"))


def write_attributes(df: DataFrame, condition: Column, success: dict, fail: dict) -> DataFrame:
    """df with values by a condition; an attribute of one side only is null on the other."""
    names = dict.fromkeys([*success, *fail])
    return df.withColumns({n: F.when(condition, F.lit(success.get(n))).otherwise(F.lit(fail.get(n))) for n in names})


def weighted_pick(df: DataFrame, entries: DataFrame, seed: int, key: str, entry: str = "entry_id", weight: str = "weight") -> DataFrame:
    """df with an entry for each row, drawn by weight with a seeded draw: cumulative weights, and the range it falls in.

    The catalog of entries is a lookup table; it is collected as ranges into one array, so the draw needs no join.
    """
    w = Window.orderBy(entry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upper = entries.where(F.col(weight) > 0).withColumn("__u", F.sum(weight).over(w))
    table = upper.agg(F.array_sort(F.collect_list(F.struct("__u", entry))).alias("__all"), F.max("__u").alias("__top"))
    drawn = df.crossJoin(F.broadcast(table)).withColumn("__d", fraction(seed, key) * F.col("__top"))  # one row
    hit = F.filter("__all", lambda e: e["__u"] > F.col("__d"))
    return drawn.withColumn(entry, F.element_at(hit, 1)[entry]).drop("__all", "__top", "__d")


def load_properties(df: DataFrame, properties: DataFrame, entry: str = "entry_id") -> DataFrame:
    return df.join(properties, entry, "left")


def type_filter(df: DataFrame, entries: DataFrame, kinds: list[str], entry: str = "entry_id", invert: bool = False) -> DataFrame:
    there = entries.where(F.col("kind").isin(kinds)).select(entry).distinct()
    return df.join(there, entry, "left_anti" if invert else "left_semi")


def index_filter(df: DataFrame, op: str, v) -> DataFrame:
    return df.where(numeric("idx", op, v))
