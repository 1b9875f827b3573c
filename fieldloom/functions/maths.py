"""Scalar functions as columns: remapping, index safety, truncation, vectors, distances, curves, seeded hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import col

AXES = ("x", "y", "z")


def remap(v, in_min, in_max, out_min=0.0, out_max=1.0, clamp: bool = False) -> Column:
    """Linear map of [in_min, in_max] to [out_min, out_max]; out_min where the input range is empty."""
    v, in_min, in_max, out_min, out_max = map(col, (v, in_min, in_max, out_min, out_max))
    t = F.when(in_max == in_min, F.lit(0.0)).otherwise((v - in_min) / (in_max - in_min))
    if clamp:
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return out_min + t * (out_max - out_min)


def tile(v, low, high, integer: bool = False) -> Column:
    """Wrap into a range: integers by max - min + 1, others by max - min."""
    v, low, high = map(col, (v, low, high))
    return low + F.pmod(v - low, high - low + (1 if integer else 0))


def safe_index(i, n, mode: str = "ignore") -> Column:
    """An index made valid for n items: ignore gives -1 outside, tile wraps, clamp stops, yoyo goes back and forth."""
    i, n = col(i), col(n)
    match mode:
        case "ignore":
            return F.when((i < 0) | (i >= n), F.lit(-1)).otherwise(i)
        case "tile":
            return F.pmod(i, n)
        case "clamp":
            return F.least(F.greatest(i, F.lit(0)), n - 1)
        case "yoyo":
            period = F.greatest(n * 2 - 2, F.lit(1))
            j = F.pmod(i, period)
            return F.when(j < n, j).otherwise(period - j)
    raise ValueError(f"no index safety {mode!r}")


def truncate(v, mode: str = "none") -> Column:
    """none, round (half up), ceil or floor."""
    v = col(v)
    return {"none": v, "round": F.floor(v + 0.5), "ceil": F.ceil(v), "floor": F.floor(v)}[mode]


def snap(v, step) -> Column:
    v, step = col(v), col(step)
    return F.when(step == 0, v).otherwise(F.floor(v / step + 0.5) * step)


def axes(prefix: str = "", suffix: str = "", names=AXES) -> list[Column]:
    return [F.col(f"{prefix}{a}{suffix}") for a in names]


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((p * q for p, q in zip(a, b)), F.lit(0.0))


def square_distance(a: list[Column], b: list[Column]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0))


def distance(a: list[Column], b: list[Column], metric: str = "euclidean") -> Column:
    """Euclidean, Manhattan or Chebyshev distance of two points."""
    if metric == "euclidean":
        return F.sqrt(square_distance(a, b))
    parts = [F.abs(p - q) for p, q in zip(a, b)]
    return sum(parts, F.lit(0.0)) if metric == "manhattan" else F.greatest(*parts)


def curve(v, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through knots (x, y) in rising x; constant beyond both ends."""
    v = col(v)
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(v < x1, F.lit(float(y0)) + (v - x0) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(v <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def contrast(v, amount: float) -> Column:
    """An s-curve about one half: v^a below, mirrored above."""
    v = col(v)
    return F.when(v < 0.5, F.pow(v * 2, F.lit(amount)) / 2).otherwise(1 - F.pow((1 - v) * 2, F.lit(amount)) / 2)


def fraction(seed: int, *keys) -> Column:
    """A seeded fraction in [0, 1) of the keys' text: the first 13 hex digits of an MD5, so that other engines agree."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def degrees_to_dot(angle: float) -> float:
    return math.cos(math.radians(angle))


def cell(v, size: float, rounded: bool = False) -> Column:
    """Grid index of a coordinate: floored, or rounded half up."""
    return F.floor(col(v) / F.lit(float(size)) + (0.5 if rounded else 0.0)).cast("long")
