"""Quality classifier: a sparse ensemble of conjunctive rules from boosted trees, weighted by lasso logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, word_bounds, word_hashes

STATISTICS = (
    "log_words", "word_bytes", "distinct_words", "repeated_words", "short_words", "long_words", "upper", "digits", "stops",
    "bars", "bangs", "symbols", "beyond_ascii", "lines_per_word", "word_bytes_spread",
)
#: Rows that training takes at most: the bound of the driver's sample.
MAX_TRAINING_ROWS = 20_000
#: Bytes of text worked on at once.
SLICE = 1 << 18

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b".,;:?":
    _CLASS[_c] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{}~\"'()-":
    _CLASS[_c] = 6
_CLASS[128:] = 7
_CLASS[10] = 8


def statistics_batch(column) -> np.ndarray:
    """The statistics of each row of an Arrow string column; all are 0 for an empty text."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    out = np.zeros((rows, len(STATISTICS)))
    if not len(data):
        return out
    starts, ends, counts = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends, True)
    row = np.repeat(np.arange(rows), counts)
    length = (ends - starts).astype(np.float64)
    words = np.maximum(counts, 1).astype(np.float64)
    per = lambda x: np.bincount(row, weights=x, minlength=rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    mean = per(length) / words
    out[:, 0] = np.log1p(counts)
    out[:, 1] = mean
    out[:, 2] = np.bincount(r[fresh], minlength=rows) / np.sqrt(words)
    out[:, 3] = per(again) / words
    out[:, 4] = per(length <= 3) / words
    out[:, 5] = per(length > 12) / words
    kinds = _CLASS[data]
    running = np.zeros(len(data) + 1, np.int32)
    share = {}
    for k in range(1, 9):
        np.cumsum(kinds == k, out=running[1:])
        share[k] = (running[offsets[1:]] - running[offsets[:-1]]).astype(np.float64)
    for j, k in enumerate((1, 2, 3, 4, 5, 6, 7)):
        out[:, 6 + j] = share[k] / np.maximum(size, 1)
    out[:, 13] = share[8] / words
    out[:, 14] = np.sqrt(np.maximum(per(length**2) / words - mean**2, 0))
    return out


def statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and the statistics of every whole text; null counts as empty."""
    own = text_col if text_col in carry and docs.schema[text_col].dataType.simpleString() == "string" else "__text"
    x = docs.select(*carry, *([] if own == text_col else [F.col(text_col).cast("string").alias("__text")]))
    fields = ", ".join([f"`{c}` {x.schema[c].dataType.simpleString()}" for c in carry] + [f"__{s} double" for s in STATISTICS])
    names = [*carry, *[f"__{s}" for s in STATISTICS]]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j in slices(b.column(own), SLICE):
                part = b.slice(i, j - i)
                values = statistics_batch(part.column(own))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *[pa.array(v) for v in values.T]], names)

    return x.mapInArrow(run, fields)


@dataclass(frozen=True)
class RuleModel:
    """score = logistic(intercept + sum of weights of the rules that hold); a rule is ((statistic, above, threshold), ...)."""

    intercept: float
    rules: tuple
    weights: tuple

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((F.col(f"__{name}") > cut) if above else (F.col(f"__{name}") <= cut))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree_paths(x: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> list:
    """Paths (rows, conditions, leaf value) of a Newton regression tree on binned statistics, all nodes but the root."""
    out = []

    def grow(rows, path, left):
        gs, hs = g[rows], h[rows]
        value = -gs.sum() / (hs.sum() + 1.0)
        if path:
            out.append((rows, path, value if not left else None))
        if not left or len(rows) < 2 * least:
            if path and out[-1][2] is None:
                out[-1] = (rows, path, value)
            return
        base, best = gs.sum() ** 2 / (hs.sum() + 1.0), (1e-6, None, None)
        for j in range(x.shape[1]):
            if not len(cuts[j]):
                continue
            n = len(cuts[j]) + 1
            bins = x[rows, j]
            gl = np.cumsum(np.bincount(bins, weights=gs, minlength=n))[:-1]
            hl = np.cumsum(np.bincount(bins, weights=hs, minlength=n))[:-1]
            nl = np.cumsum(np.bincount(bins, minlength=n))[:-1]
            gain = gl**2 / (hl + 1.0) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1.0) - base
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            if path:
                out[-1] = (rows, path, value)
            return
        _, j, k = best
        low = x[rows, j] <= k
        grow(rows[low], (*path, (j, False, float(cuts[j][k]))), left - 1)
        grow(rows[~low], (*path, (j, True, float(cuts[j][k]))), left - 1)

    grow(np.arange(len(g)), (), depth)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, rounds: int = 400, least: int = 10) -> RuleModel:
    """Boosted trees on the statistics, their paths as rules, and lasso logistic weights by accelerated proximal steps.

    With fewer than two classes, the score is the constant share of label 1 (one half without rows).
    """
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y[0], 0.01, 0.99))
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    least = max(1, min(least, len(y) // 20))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 41)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: dict = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rows, path, value in _tree_paths(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, least):
            rules.setdefault(tuple(sorted(path)), None)
            if value is not None:
                margin[rows] += rate * value
    rules = list(rules)
    m = np.ones((len(y), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for j, above, cut in rule:
            m[:, k] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    w, b = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    v, c, t = w.copy(), b, 1.0
    vector = np.ones(len(rules))
    for _ in range(20):  # largest eigenvalue of the Gram matrix, for the step
        vector = m.T @ (m @ vector.astype(np.float32))
        vector /= max(np.linalg.norm(vector), 1e-12)
    top = float(np.linalg.norm(m @ vector.astype(np.float32)) ** 2) / len(y) + 1.0
    step = 4.0 / top
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(m @ v.astype(np.float32) + c)))
        r = (p - y) / len(y)
        w2 = v - step * (m.T @ r.astype(np.float32))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    live = np.flatnonzero(np.abs(w) > 1e-4)
    named = tuple(tuple((STATISTICS[j], above, cut) for j, above, cut in rules[k]) for k in live)
    return RuleModel(float(b), named, tuple(float(w[k]) for k in live))


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING_ROWS) -> RuleModel:
    """Fit on at most `most` labelled rows that aren't held out, those first in the order of a hash of the id.

    Null labels and ids are left out; of repeated labels the least counts.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null").where(~held_out(F.col("__id")))
    sample = known.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.withColumnRenamed(id_col, "__id").select("__id", F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id")  # `most` ids
    got = statistics(rows, "__t", ("__id", "__y")).orderBy("__id").limit(most).toPandas()
    return fit_rules(got[[f"__{s}" for s in STATISTICS]].to_numpy(np.float64).reshape(-1, len(STATISTICS)), (got["__y"].to_numpy(np.float64) > 0).astype(np.float64))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, score (0 to 1) and predicted (1 from one half on) of every row, empty and null texts too."""
    x = statistics(docs, text_col, carry).withColumn("score", model.column())
    return x.select(*carry, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
