"""Kernels of blocks against every pair, and plans without rows for pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import along, blocks, probes, spatial

RADIUS = 0.5


@pytest.fixture(scope="module")
def cloud(spark):
    p = np.random.default_rng(8).normal(size=(260, 3)) * 0.3
    p[200:230] = p[:30]
    return p, spark.createDataFrame([(i % 7, i // 7, i, *map(float, q)) for i, q in enumerate(p)], "dataset_id long, idx long, id long, x double, y double, z double")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 90)
    monkeypatch.setattr(blocks, "MOST", 150)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def segments(p):
    return [(i % 7, i // 7, p[i], p[i + 7]) for i in range(len(p) - 7)]


@pytest.fixture(scope="module")
def places(cloud):
    """The nearest segment of every point: path, index, share of it, distance."""
    p, out = cloud[0], {}
    for i, q in enumerate(p):
        best = (np.inf,)
        for path, k, a, b in segments(p):
            t = min(max((q + [0.05, 0, 0] - a) @ (b - a) / ((b - a) @ (b - a)), 0), 1)
            best = min(best, (float(np.linalg.norm(a + (b - a) * t - q - [0.05, 0, 0])), path, k, t))
        if best[0] <= 0.1:
            out[i] = best
    return out


def moved(df):
    return df.withColumn("x", F.col("x") + 0.05), df.withColumnRenamed("dataset_id", "path_id").drop("id")


def test_nearest_segment_makes_no_pairs(cloud, places):
    x = along.nearest_segment(*moved(cloud[1]), 0.1)
    assert joins(x) == 0
    got = {r.id: r for r in x.collect()}
    assert got.keys() == places.keys()
    assert all((r.path_id, r.idx) == places[i][1:3] and abs(r.distance - places[i][0]) < 1e-9 for i, r in got.items())


def test_time_filter_reads_the_nearest_place(cloud, places):
    p = cloud[0]
    length, start = {}, {}
    for path, k, a, b in segments(p):
        start[path, k] = length.get(path, 0.0)
        length[path] = length.get(path, 0.0) + np.linalg.norm(b - a)
    want = {i for i, (_, path, k, t) in places.items() if (start[path, k] + t * np.linalg.norm(segments(p)[k * 7 + path][3] - segments(p)[k * 7 + path][2])) / length[path] > 0.5}
    x = along.time_filter(*moved(cloud[1]), 0.1, ">", 0.5)
    assert joins(x) == 1  # back to the points
    assert {r.id for r in x.collect()} == want


def test_insert_puts_every_point_in_reach(cloud, places):
    points, path = moved(cloud[1])
    x = along.insert(path, points, 0.1)
    assert joins(x) == 1  # back to the points
    got = sorted((r.path_id, round(r.place, 6)) for r in x.collect())
    want = [(i % 7, float(i // 7)) for i in range(len(cloud[0]))] + [(path, k + t) for _, path, k, t in places.values()]
    assert np.allclose(got, sorted((a, round(b, 6)) for a, b in want), atol=1e-5)


def test_best_and_farthest_targets_make_no_pairs(cloud):
    p, df = cloud
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    x, y = spatial.sample_best(df, df, RADIUS, F.col("r_y")), spatial.sample_farthest(df, df, RADIUS)
    assert joins(x) == joins(y) == 0
    near = [np.flatnonzero(d <= RADIUS * RADIUS) for d in d2]
    assert {r.id: r.sampled_id for r in x.collect()} == {i: min(n, key=lambda j: (p[j, 1], j)) for i, n in enumerate(near)}
    assert {r.id: r.sampled_id for r in y.collect()} == {i: min(n, key=lambda j: (-d2[i, j], j)) for i, n in enumerate(near)}


def test_self_prune_decides_dense_points_in_blocks(cloud):
    p, df = cloud
    stay = []
    for i in range(len(p)):
        if all(((p[i] - p[j]) ** 2).sum() > 0.04 for j in stay):
            stay.append(i)
    assert spatial.greedy(p, 0.2) == stay
    assert sorted(r.id for r in spatial.self_prune(df, 0.2, F.col("id"), block=60).collect()) == stay


def test_probes_make_no_pairs(cloud):
    p, df = cloud
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    n = range(len(p))
    x = probes.closest(df, 3, RADIUS)
    assert joins(x) == 0
    want = {(min(i, j), max(i, j)) for i in n for j in sorted((j for j in n if j != i and d2[i, j] <= RADIUS * RADIUS), key=lambda j: (d2[i, j], j))[:3]}
    assert {tuple(r) for r in x.collect()} == want
    x = probes.gradient_flow(df.withColumn("v", F.col("z")), "v", RADIUS)
    assert joins(x) == 0
    up = {i: [j for j in n if d2[i, j] <= RADIUS * RADIUS and p[j, 2] > p[i, 2]] for i in n}
    assert {r.src: r.dst for r in x.collect()} == {i: min(u, key=lambda j: (p[i, 2] - p[j, 2], j)) for i, u in up.items() if u}


def test_dbscan_shuffles_no_edge(cloud):
    p, df = cloud
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.04
    np.fill_diagonal(near, False)
    core = near.sum(1) >= 4
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if near[i, j] and core[i] and core[j]}
    got = [tuple(r) for r in probes.dbscan(df, 0.2, 4).collect()]
    assert len(got) == len(set(got)) and want == {(i, j) for i, j in got if core[i] and core[j]}
    assert {k for e in got for k in e if not core[k]} == {i for i in range(len(p)) if not core[i] and near[i][core].any()}


def test_copies_of_blocks_grow_no_faster_than_rows(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 512)
    monkeypatch.setattr(blocks, "MOST", 131072)
    for n in (0, 1, 600, 10_000, 100_000, 600_000, 1_000_000, 5_000_000):
        a, b = blocks.dealt(n, n)
        assert a >= 1 <= b and max(-(-n // a), -(-n // b)) <= 131072
        assert a + b <= 20 or n > 1_000_000  # copies of a row


@pytest.mark.parametrize("v", [False, True])
def test_pairs_in_reach_of_a_box_are_not_compared(monkeypatch, v):
    p = np.random.default_rng(4).normal(size=(3000, 3)) * 0.05
    p[1000:1100] = p[:100]
    keys = np.random.default_rng(5).permutation(3000)
    compared, square = [], blocks.square
    monkeypatch.setattr(blocks, "square", lambda a, b: compared.append(a.shape[1] * b.shape[1]) or square(a, b))
    one, two = (pa.table({f"{r}{n}": x for n, x in (("id", keys), *zip("xyz", p.T), ("__v", p[:, 2]))}) for r in ("", "r_"))
    got = [e for out in blocks.paired(0.2, "id", "r_id", v, 0.05)(one, two) for e in zip(out["src"].to_pylist(), out["dst"].to_pylist())]
    ok = square(p.T, p.T) <= 0.2 * 0.2
    if v:
        ok &= np.abs(p[:, 2][None, :] - p[:, 2][:, None]) <= 0.05
    i, j = np.nonzero(ok & (keys[:, None] < keys[None, :]))
    assert len(got) == len(set(got)) and set(got) == set(zip(keys[i].tolist(), keys[j].tolist()))
    assert sum(compared) < 0.5 * 3000 * 3000


def test_overlaps_are_counted_once(cloud):
    p, df = cloud
    box = df.select("dataset_id", "id", *[(F.col(a) + k).alias(f"{n}{a}") for a in "xyz" for n, k in (("l", -0.1), ("h", 0.1))])
    x = spatial.overlap_stats(box)
    assert "InArrow" not in x._jdf.queryExecution().optimizedPlan().toString()
    lo, hi, set_ = p - 0.1, p + 0.1, np.arange(len(p)) % 7
    n = ((lo[:, None] <= hi[None]) & (hi[:, None] >= lo[None])).all(2) & (set_[:, None] != set_[None])
    assert {r.id: r.overlap_count for r in x.collect()} == dict(enumerate(n.sum(1).tolist()))
