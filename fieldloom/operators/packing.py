"""Bin packing and constraint solving: greedy and order-dependent, one group per task."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame


def guillotine(items: list[tuple], bin_size: tuple[float, float, float]) -> list[tuple]:
    """(id, bin, x, y, z) of boxes (id, sx, sy, sz), largest first, each into the tightest free space of the first bin that
    has one; the rest of the space is cut in three. Boxes that fit no bin get bin -1.

    Free space only shrinks, so a bin that has no room for a size never has again: each size goes on from the bin that
    took its last box."""
    bins: list[list] = []
    start: dict = {}
    out = []
    for item in sorted(items, key=lambda i: (-i[1] * i[2] * i[3], i[0])):
        name, size = item[0], item[1:]
        if any(s > b for s, b in zip(size, bin_size)):
            out.append((name, -1, 0.0, 0.0, 0.0))
            continue
        for k in range(start.get(size, 0), len(bins) + 1):
            if k == len(bins):
                bins.append([((0.0, 0.0, 0.0), tuple(bin_size))])
            fits = [(f[1][0] * f[1][1] * f[1][2], f) for f in bins[k] if all(s <= b + 1e-9 for s, b in zip(size, f[1]))]
            if fits:
                _, (at, room) = min(fits)
                bins[k].remove((at, room))
                (x, y, z), (rx, ry, rz), (sx, sy, sz) = at, room, size
                for p, r in (((x + sx, y, z), (rx - sx, ry, rz)), ((x, y + sy, z), (sx, ry - sy, rz)), ((x, y, z + sz), (sx, sy, rz - sz))):
                    if min(r) > 1e-9:
                        bins[k].append((p, r))
                start[size] = k
                out.append((name, k, x, y, z))
                break
    return out


def pack(boxes: DataFrame, bin_size: tuple[float, float, float], by: str = "dataset_id", key: str = "id") -> DataFrame:
    """(by, id, bin, x, y, z) of the boxes (by, id, sx, sy, sz) of every group."""
    kind = boxes.schema[by].dataType.simpleString()

    def run(part):
        import pandas as pd

        items = [(int(r[0]), *map(float, r[1:])) for r in part[[key, "sx", "sy", "sz"]].itertuples(index=False)]
        return pd.DataFrame([(part[by].iloc[0], *r) for r in guillotine(items, bin_size)], columns=[by, "id", "bin", "x", "y", "z"])

    return boxes.select(by, key, "sx", "sy", "sz").groupBy(by).applyInPandas(run, f"{by} {kind}, id long, bin long, x double, y double, z double")


def collapse(links: dict, tiles: int, allowed: np.ndarray, seed: int, tries: int = 10) -> dict:
    """A tile for each node such that the tiles of linked nodes are allowed together (allowed[a, b]), or {}: the node with
    the fewest candidates is set by a seeded draw, and what it forbids is removed; a dead end starts anew."""
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        left = {n: np.ones(tiles, bool) for n in links}
        chosen: dict = {}
        heap = [(tiles, n) for n in sorted(links)]  # a node's newest entry is its least; older ones are passed over
        while len(chosen) < len(links):
            n = heapq.heappop(heap)[1]
            if n in chosen:
                continue
            options = np.flatnonzero(left[n])
            if not len(options):
                break
            chosen[n] = int(rng.choice(options))
            left[n] = np.arange(tiles) == chosen[n]
            todo = [n]
            while todo:
                a = todo.pop()
                for b, _ in links[a]:
                    now = left[b] & allowed[left[a]].any(0)
                    if (now != left[b]).any():
                        left[b] = now
                        if b not in chosen:
                            heapq.heappush(heap, (int(now.sum()), b))
                        todo.append(b)
        else:
            return chosen
    return {}


def bond(edges: DataFrame, tiles: int, allowed, seed: int = 1, by: str = "cluster_id") -> DataFrame:
    """(by, node, tile) of every cluster that can be solved."""
    from .search import adjacency

    e = edges.select(by, "src", "dst")
    kind, node = e.schema[by].dataType.simpleString(), e.schema["src"].dataType.simpleString()
    table = np.asarray(allowed, bool)

    def run(part):
        import pandas as pd

        got = collapse(adjacency(part.src, part.dst, np.ones(len(part))), tiles, table, seed)
        return pd.DataFrame([(part[by].iloc[0], n, t) for n, t in sorted(got.items())], columns=[by, "node", "tile"])

    return e.groupBy(by).applyInPandas(run, f"{by} {kind}, node {node}, tile long")
