"""Noise fields as vectorised functions of places, and as Arrow-batched columns. All are seeded and deterministic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = np.uint64(0x9E3779B97F4A7C15)


def lattice(seed: int, *cells: np.ndarray) -> np.ndarray:
    """A hash in [0, 1) of whole coordinates."""
    h = np.full(len(cells[0]), np.uint64(seed)) * _M + np.uint64(1)
    for c in cells:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def fade(t: np.ndarray) -> np.ndarray:
    return t * t * t * (t * (t * 6 - 15) + 10)


def _corners(p: np.ndarray, value) -> np.ndarray:
    """Interpolation of value(cell, offset) over the 8 corners of each place's cell."""
    base = np.floor(p)
    f = p - base
    w = fade(f)
    out = np.zeros(len(p))
    for i in range(8):
        bits = np.array([(i >> k) & 1 for k in range(3)])
        weight = np.prod(np.where(bits, w, 1 - w), axis=1)
        out += weight * value(base + bits, f - bits)
    return out


def white(p: np.ndarray, seed: int = 0) -> np.ndarray:
    return lattice(seed, *np.floor(p).T) * 2 - 1


def value(p: np.ndarray, seed: int = 0) -> np.ndarray:
    return _corners(p, lambda c, _: lattice(seed, *c.T)) * 2 - 1


def _gradient(c: np.ndarray, d: np.ndarray, seed: int) -> np.ndarray:
    z = lattice(seed, *c.T) * 2 - 1
    a = lattice(seed + 1, *c.T) * 2 * math.pi
    r = np.sqrt(1 - z * z)
    return r * np.cos(a) * d[:, 0] + r * np.sin(a) * d[:, 1] + z * d[:, 2]


def perlin(p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Gradient noise over a cubic lattice."""
    return _corners(p, lambda c, d: _gradient(c, d, seed))


def simplex(p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Gradient noise over a simplicial lattice."""
    s = p.sum(1, keepdims=True) / 3
    cell = np.floor(p + s)
    x0 = p - (cell - cell.sum(1, keepdims=True) / 6)
    rank = np.argsort(np.argsort(-x0, axis=1, kind="stable"), axis=1)
    out = np.zeros(len(p))
    for k in range(4):
        step = (rank < k).astype(np.float64)
        d = x0 - step + k / 6
        t = np.maximum(0.6 - (d**2).sum(1), 0)
        out += t**4 * _gradient(cell + step, d, seed)
    return out * 32


def _features(p: np.ndarray, seed: int, jitter: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to the nearest and the second feature point, and the nearest one's draw."""
    base = np.floor(p)
    near, second, draw = np.full(len(p), np.inf), np.full(len(p), np.inf), np.zeros(len(p))
    for i in range(27):
        c = base + np.array([i % 3 - 1, i // 3 % 3 - 1, i // 9 - 1])
        spot = c + 0.5 + jitter * (np.stack([lattice(seed + k, *c.T) for k in range(3)], 1) - 0.5)
        d = np.sqrt(((spot - p) ** 2).sum(1))
        closer = d < near
        second = np.where(closer, near, np.minimum(second, d))
        draw = np.where(closer, lattice(seed + 3, *c.T), draw)
        near = np.where(closer, d, near)
    return near, second, draw


def worley(p: np.ndarray, seed: int = 0, jitter: float = 1.0) -> np.ndarray:
    return _features(p, seed, jitter)[0] * 2 - 1


def voronoi(p: np.ndarray, seed: int = 0, jitter: float = 1.0) -> np.ndarray:
    return _features(p, seed, jitter)[2] * 2 - 1


def spots(p: np.ndarray, seed: int = 0, radius: float = 0.4) -> np.ndarray:
    return np.clip(1 - _features(p, seed, 0.5)[0] / radius, 0, 1) * 2 - 1


def fbm(p: np.ndarray, seed: int = 0, octaves: int = 4, lacunarity: float = 2.0, gain: float = 0.5, base=perlin, ridge: bool = False) -> np.ndarray:
    """Octaves of a noise; ridged ones fold it at 0."""
    total, amplitude, weight = np.zeros(len(p)), 1.0, 0.0
    for k in range(octaves):
        v = base(p * lacunarity**k, seed + 17 * k)
        total += amplitude * (1 - 2 * np.abs(v) if ridge else v)
        weight += amplitude
        amplitude *= gain
    return total / weight


def marble(p: np.ndarray, seed: int = 0, warp: float = 4.0) -> np.ndarray:
    return np.sin(p[:, 0] * math.pi + warp * fbm(p, seed))


def caustic(p: np.ndarray, seed: int = 0) -> np.ndarray:
    a, b, _ = _features(p, seed, 1.0)
    return np.clip(1 - (b - a) * 2, -1, 1)


def curl(p: np.ndarray, seed: int = 0, step: float = 1e-3) -> np.ndarray:
    """The first component of the curl of three noises."""
    d = np.array([0.0, step, 0.0]), np.array([0.0, 0.0, step])
    return (perlin(p + d[0], seed + 2) - perlin(p - d[0], seed + 2) - perlin(p + d[1], seed + 1) + perlin(p - d[1], seed + 1)) / (2 * step)


def flow(p: np.ndarray, seed: int = 0, time: float = 0.0) -> np.ndarray:
    a = time + lattice(seed, *np.floor(p).T) * 2 * math.pi
    return perlin(p + 0.25 * np.stack([np.cos(a), np.sin(a), np.zeros(len(p))], 1), seed)


def gabor(p: np.ndarray, seed: int = 0, frequency: float = 2.0) -> np.ndarray:
    base, out = np.floor(p), np.zeros(len(p))
    for i in range(27):
        c = base + np.array([i % 3 - 1, i // 3 % 3 - 1, i // 9 - 1])
        d = p - c - np.stack([lattice(seed + k, *c.T) for k in range(3)], 1)
        a = lattice(seed + 3, *c.T) * 2 * math.pi
        out += np.exp(-math.pi * (d**2).sum(1)) * np.cos(2 * math.pi * frequency * (d[:, 0] * np.cos(a) + d[:, 1] * np.sin(a)))
    return np.clip(out, -1, 1)


def swiss(p: np.ndarray, seed: int = 0, octaves: int = 4, erosion: float = 0.3) -> np.ndarray:
    """Ridged octaves whose places are bent by what came before."""
    total, amplitude, weight, bend = np.zeros(len(p)), 1.0, 0.0, np.zeros_like(p)
    for k in range(octaves):
        q = (p + erosion * bend) * 2.0**k
        v = 1 - 2 * np.abs(perlin(q, seed + 17 * k))
        bend = bend + amplitude * np.stack([v, -v, np.zeros(len(p))], 1)
        total, weight, amplitude = total + amplitude * v, weight + amplitude, amplitude * 0.5
    return total / weight


def tiling(p: np.ndarray, seed: int = 0, period: float = 8.0) -> np.ndarray:
    return _corners(p, lambda c, d: _gradient(np.mod(c, period), d, seed))


NOISES = {f.__name__: f for f in (white, value, perlin, simplex, worley, voronoi, spots, fbm, marble, caustic, curl, flow, gabor, swiss, tiling)}


def noise(name: str, x, y, z, frequency: float = 1.0, **kw) -> Column:
    """A noise of a table's places as a column; Arrow batches go through numpy."""
    f = NOISES[name]

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(f(np.stack([a, b, c], 1).astype(np.float64) * frequency, **kw))

    return F.pandas_udf(run, "double")(*[F.col(v) if isinstance(v, str) else F.lit(v) for v in (x, y, z)])
