"""Planar and spatial geometry per dataset: hulls, Delaunay, Voronoi, polygon clipping, offsets, triangulation, faces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list) -> list:
    """Convex hull, counter-clockwise from the least point; points on its sides are left out."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(side):
        out = []
        for p in side:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def delaunay(xy: np.ndarray) -> list:
    """Triangles (counter-clockwise indices) of the points' Delaunay triangulation, by insertion into a large triangle.

    The triangles whose circle holds a new point are found by one vectorised test; their rim is joined to the point.
    Points come from left to right, so a triangle whose circle ends left of the newest is done and is tested no more.
    """
    n = len(xy)
    if n < 3:
        return []
    mid, span = xy.mean(0), max(float(np.ptp(xy, axis=0).max()), 1.0)
    far = 1e4 * span
    p = np.vstack([xy, mid + [[-far, -far], [far, -far], [0.0, far]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circle(t):
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        b2, c2 = (b**2).sum(1), (c**2).sum(1)
        u = np.stack([c[:, 1] * b2 - b[:, 1] * c2, b[:, 0] * c2 - c[:, 0] * b2], 1) / np.where(d == 0, np.nan, d)[:, None]
        return a + u, (u**2).sum(1)

    centre, r2 = circle(tri)
    age, made, done = np.zeros(1, np.int64), 1, []
    seen = set()
    for i in np.lexsort((xy[:, 1], xy[:, 0])):
        if tuple(xy[i]) in seen:
            continue
        seen.add(tuple(xy[i]))
        way = centre - xy[i]
        bad = (way**2).sum(1) < r2 * (1 - 1e-12)
        rim: dict = {}
        for t in tri[bad]:
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                if (b, a) in rim:
                    del rim[(b, a)]
                else:
                    rim[(a, b)] = True
        new = np.array([[a, b, i] for a, b in rim], dtype=np.int64).reshape(-1, 3)
        c, r = circle(new)
        past = (way[:, 0] < 0) & (way[:, 0] ** 2 >= r2 * (1 - 1e-12))
        done += zip(age[past].tolist(), map(tuple, tri[past].tolist()))
        stay = ~(bad | past)
        tri, centre, r2 = np.vstack([tri[stay], new]), np.vstack([centre[stay], c]), np.r_[r2[stay], r]
        age, made = np.r_[age[stay], np.arange(made, made + len(new))], made + len(new)
    done += zip(age.tolist(), map(tuple, tri.tolist()))
    return [t for _, t in sorted(done) if max(t) < n]


def area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def clip_rect(ring: list, low: tuple, high: tuple) -> list:
    """The part of a ring inside a rectangle, side by side."""
    for axis, bound, sign in ((0, low[0], 1), (0, high[0], -1), (1, low[1], 1), (1, high[1], -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ia, ib = (a[axis] - bound) * sign >= 0, (b[axis] - bound) * sign >= 0
            if ia:
                out.append(a)
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[k] + (b[k] - a[k]) * t for k in (0, 1)))
        ring = out
        if not ring:
            break
    return ring


def clip_convex(ring: list, clip: list) -> list:
    """The part of a ring inside a counter-clockwise convex ring."""
    for p, q in zip(clip, clip[1:] + clip[:1]):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            sa, sb = cross(p, q, a), cross(p, q, b)
            if sa >= 0:
                out.append(a)
            if (sa >= 0) != (sb >= 0):
                t = sa / (sa - sb)
                out.append(tuple(a[k] + (b[k] - a[k]) * t for k in (0, 1)))
        ring = out
        if not ring:
            break
    return ring


def offset_convex(ring: list, amount: float) -> list:
    """A counter-clockwise convex ring with its sides moved out (or in), joined where they meet."""
    n = len(ring)
    lines = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        dx, dy = b[0] - a[0], b[1] - a[1]
        k = math.hypot(dx, dy)
        lines.append((a[0] + dy / k * amount, a[1] - dx / k * amount, dx, dy))
    out = []
    for (x, y, dx, dy), (u, v, du, dv) in zip([lines[(i - 1) % n] for i in range(n)], lines):
        d = dx * dv - dy * du
        t = ((u - x) * dv - (v - y) * du) / d if d else 1.0
        out.append((x + dx * t, y + dy * t))
    return out


def ears(ring: list) -> list:
    """Triangles (indices) of a simple ring by cutting ears."""
    idx = list(range(len(ring)))
    if area(ring) < 0:
        idx.reverse()
    out = []
    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            if cross(ring[a], ring[b], ring[c]) <= 0:
                continue
            inside = (all(cross(ring[p], ring[q], ring[i]) >= 0 for p, q in ((a, b), (b, c), (c, a))) for i in idx if i not in (a, b, c) and ring[i] not in (ring[a], ring[b], ring[c]))
            if not any(inside):
                out.append((a, b, c))
                idx.pop(k)
                break
        else:
            break
    return out + ([tuple(idx)] if len(idx) == 3 else [])


def faces(places: dict, links: dict) -> list:
    """Inner faces (rings of nodes, counter-clockwise) of a planar drawing, by walking half edges."""
    turn = {n: sorted(o, key=lambda m, n=n: math.atan2(places[m][1] - places[n][1], places[m][0] - places[n][0])) for n, o in links.items()}
    seen, out = set(), []
    for n in sorted(links):
        for m in turn[n]:
            if (n, m) in seen:
                continue
            ring, a, b = [], n, m
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                around = turn[b]
                a, b = b, around[around.index(a) - 1]
            if area([places[x] for x in ring]) > 1e-12:
                out.append(ring)
    return out


def _per_dataset(df: DataFrame, by: str, kernel, schema: str) -> DataFrame:
    kind = df.schema[by].dataType.simpleString()

    def run(part):
        import pandas as pd

        rows = [(part[by].iloc[0], *r) for r in kernel(part)]
        return pd.DataFrame(rows, columns=[by, *[c.split()[0].strip("`") for c in schema.split(", ")]])

    return df.groupBy(by).applyInPandas(run, f"{by} {kind}, {schema}")


def convex_hull(points: DataFrame, by: str = "dataset_id", key: str = "id") -> DataFrame:
    """(by, idx, id, x, y) of each dataset's hull. Points far inside never leave their task: each task's own hull points
    are all that is shuffled."""
    kind = points.schema[by].dataType.simpleString()
    x = points.select(by, F.col(key).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def local(parts):
        import pandas as pd

        for pdf in parts:
            kept = [pdf.iloc[:0]]
            for _, g in pdf.groupby(by):
                first = {}
                for r in sorted(zip(g.x, g.y, g.id)):
                    first.setdefault(r[:2], r[2])
                ring = hull(list(first))
                kept.append(pd.DataFrame({by: g[by].iloc[0], "id": [first[p] for p in ring], "x": [p[0] for p in ring], "y": [p[1] for p in ring]}))
            yield pd.concat(kept)

    def whole(part):
        first = {}
        for r in sorted(zip(part.x, part.y, part.id)):
            first.setdefault(r[:2], r[2])
        return [(i, int(first[p]), *p) for i, p in enumerate(hull(list(first)))]

    return _per_dataset(x.mapInPandas(local, f"{by} {kind}, id long, x double, y double"), by, whole, "idx long, id long, x double, y double")


def delaunay_edges(points: DataFrame, by: str = "dataset_id", key: str = "id") -> DataFrame:
    """(by, src, dst) of each dataset's Delaunay triangulation."""

    def kernel(part):
        ids, xy = part[key].to_numpy(), part[["x", "y"]].to_numpy(np.float64)
        pairs = {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for t in delaunay(xy) for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        return sorted(pairs)

    return _per_dataset(points.select(by, key, "x", "y"), by, kernel, "src long, dst long")


def delaunay_triangles(points: DataFrame, by: str = "dataset_id", key: str = "id") -> DataFrame:
    def kernel(part):
        ids, xy = part[key].to_numpy(), part[["x", "y"]].to_numpy(np.float64)
        return sorted(tuple(sorted(int(ids[v]) for v in t)) for t in delaunay(xy))

    return _per_dataset(points.select(by, key, "x", "y"), by, kernel, "a long, b long, c long")


def voronoi(points: DataFrame, by: str = "dataset_id", key: str = "id") -> DataFrame:
    """(by, site, x, y, cells): the circumcentres of each dataset's triangles and the three points around each."""

    def kernel(part):
        ids, xy = part[key].to_numpy(), part[["x", "y"]].to_numpy(np.float64)
        out = []
        for i, t in enumerate(sorted(delaunay(xy))):
            a, b, c = xy[list(t)]
            b, c = b - a, c - a
            d = 2 * (b[0] * c[1] - b[1] * c[0])
            u = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / d + a
            out.append((i, float(u[0]), float(u[1]), sorted(int(ids[v]) for v in t)))
        return out

    return _per_dataset(points.select(by, key, "x", "y"), by, kernel, "site long, x double, y double, cells array<long>")


def lloyd(points: DataFrame, rounds: int = 1, by: str = "dataset_id", key: str = "id") -> DataFrame:
    """Points moved to the middle of their Delaunay neighbours' cells: the mean of the centres of their triangles, weighed
    by area; points on the hull stay."""

    def kernel(part):
        ids, xy = part[key].to_numpy(), part[["x", "y"]].to_numpy(np.float64).copy()
        for _ in range(rounds):
            total, weight, edge = np.zeros_like(xy), np.zeros(len(xy)), {}
            for t in delaunay(xy):
                p = xy[list(t)]
                w = abs(cross(*p)) / 2
                for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                    edge[(min(a, b), max(a, b))] = edge.get((min(a, b), max(a, b)), 0) + 1
                for v in t:
                    total[v] += p.mean(0) * w
                    weight[v] += w
            rim = {v for e, n in edge.items() if n == 1 for v in e}
            move = np.array([i for i in range(len(xy)) if weight[i] > 0 and i not in rim], np.int64)
            xy[move] = total[move] / weight[move, None]
        return [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, xy)]

    return _per_dataset(points.select(by, key, "x", "y"), by, kernel, "id long, x double, y double")


def clip(paths: DataFrame, low: tuple, high: tuple, by: str = "path_id") -> DataFrame:
    """Closed paths clipped to a rectangle: (by, idx, x, y)."""

    def kernel(part):
        p = part.sort_values("idx")
        return [(i, *map(float, q)) for i, q in enumerate(clip_rect(list(zip(p.x, p.y)), low, high))]

    return _per_dataset(paths.select(by, "idx", "x", "y"), by, kernel, "idx long, x double, y double")


def triangulate(paths: DataFrame, by: str = "path_id") -> DataFrame:
    """Triangles (by, a, b, c) of simple closed paths, as indices of their points."""

    def kernel(part):
        p = part.sort_values("idx")
        return [tuple(int(i) for i in t) for t in ears(list(zip(p.x, p.y)))]

    return _per_dataset(paths.select(by, "idx", "x", "y"), by, kernel, "a long, b long, c long")


def cells(edges: DataFrame, places: DataFrame, by: str = "cluster_id") -> DataFrame:
    """(by, cell, idx, node) of the inner faces of each planar cluster: edges (by, src, dst) and places (by, id, x, y)."""
    kind = edges.schema[by].dataType.simpleString()

    def run(left, right):
        import pandas as pd

        spots = {r.id: (r.x, r.y) for r in right.itertuples()}
        links: dict = {}
        for a, b in zip(left.src, left.dst):
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
        rows = [(left[by].iloc[0], k, i, n) for k, ring in enumerate(faces(spots, {n: sorted(o) for n, o in links.items()})) for i, n in enumerate(ring)]
        return pd.DataFrame(rows, columns=[by, "cell", "idx", "node"])

    return edges.select(by, "src", "dst").groupBy(by).cogroup(places.select(by, "id", "x", "y").groupBy(by)).applyInPandas(run, f"{by} {kind}, cell long, idx long, node long")
