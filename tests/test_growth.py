"""Kernels whose work must not grow with the square of their rows, against plain versions."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import along, blocks, clusters, fields, geometry, graph, matching, packing, paths, probes, rangejoin, search, spatial
from fieldloom.sources import tables


def plain_spanner(xyz, stretch):
    i, j = np.triu_indices(len(xyz), 1)
    d = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
    links, rows = [[] for _ in xyz], []
    for k in np.lexsort((j, i, d)):
        a, b, length = int(i[k]), int(j[k]), float(d[k])
        best, heap = {a: 0.0}, [(0.0, a)]
        while heap:
            c, n = heapq.heappop(heap)
            for m, w in links[n]:
                if c + w <= stretch * length and c + w < best.get(m, math.inf):
                    best[m] = c + w
                    heapq.heappush(heap, (c + w, m))
        if b not in best:
            links[a].append((b, length))
            links[b].append((a, length))
            rows.append((a, b, length))
    return rows


def test_spanner_is_the_greedy_one():
    p = np.random.default_rng(1).normal(size=(150, 3)) * 0.1
    p[50:70], p[80:110] = p[:20], np.round(p[80:110], 1)
    for stretch in (1.1, 1.5):
        assert search.greedy_spanner(p, stretch) == plain_spanner(p, stretch)
    assert search.greedy_spanner(p[:1], 1.5) == []


def test_delaunay_leaves_finished_triangles_alone(monkeypatch):
    tested = []
    stack = np.vstack
    monkeypatch.setattr(geometry.np, "vstack", lambda x: tested.append(sum(map(len, x))) or stack(x))
    xy = np.random.default_rng(2).random((1500, 2))
    tri = geometry.delaunay(xy)
    assert len(tri) > 2900 and max(tested[1:]) < 1200
    for a, b, c in tri[::97]:  # no point lies in a triangle's circle
        u = np.linalg.solve(2 * np.array([xy[b] - xy[a], xy[c] - xy[a]]), [xy[b] @ xy[b] - xy[a] @ xy[a], xy[c] @ xy[c] - xy[a] @ xy[a]])
        assert (((xy - u) ** 2).sum(1) >= ((xy[a] - u) ** 2).sum() * (1 - 1e-9)).all()


def test_packing_asks_no_full_bin_twice():
    asked = []

    class Size(float):
        def __le__(self, other):
            asked.append(1)
            return float(self) <= other

    items = [(i, Size(i % 5 + 20), Size(10), Size(i % 4 + 30)) for i in range(1500)]
    got = packing.guillotine(items, (60.0, 40.0, 40.0))
    assert len(got) == 1500 and max(k for _, k, *_ in got) > 150
    assert len(asked) < 60 * 1500


RADIUS = 0.4


@pytest.fixture(scope="module")
def cloud(spark):
    p = np.random.default_rng(8).normal(size=(260, 3)) * 0.3
    p[200:230] = p[:30]
    rows = [(i % 7, i // 7, i, *map(float, q), float(i) if i % 9 else None) for i, q in enumerate(p)]
    return p, spark.createDataFrame(rows, "dataset_id long, idx long, id long, x double, y double, z double, v double")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 90)
    monkeypatch.setattr(blocks, "MOST", 150)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_nearest_makes_no_pairs(cloud):
    p, df = cloud
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    x = rangejoin.nearest(df.select("id", "x", "y", "z"), df, 3, skip_self=True)
    assert joins(x) == 0
    got = {(r.id, r["rank"]): (r.r_id, r.r_v) for r in x.collect()}
    want = {(i, k + 1): int(j) for i in range(len(p)) for k, j in enumerate(sorted(range(len(p)), key=lambda j: (d2[i, j], j))[:3])}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v == (float(j) if j % 9 else None) for j, v in got.values())


@pytest.mark.parametrize("kind", ["flow", "pole", "spin"])
def test_tensors_make_no_pairs(cloud, kind):
    p, df = cloud
    e = df.select("x", "y", "z", F.col("v").alias("dx"), F.when(F.col("id") == 5, float("nan")).otherwise(F.col("y")).alias("dy"), F.lit(1.0).alias("dz"))
    x = fields.sample(df, e, RADIUS, kind)
    assert joins(x) == 0
    near = rangejoin.within_radius(df.select("id", "x", "y", "z"), e, RADIUS)
    w, away = 1 - F.col("d2") / (RADIUS * RADIUS), [F.col(f"r_{a}") - F.col(a) for a in "xyz"]
    d, size = [F.col(f"r_d{a}") for a in "xyz"], F.nullif(F.sqrt("d2"), F.lit(0.0))
    v = {"flow": d, "pole": [F.coalesce(a / size, F.lit(0.0)) for a in away], "spin": [d[i] * away[j] - d[j] * away[i] for i, j in ((1, 2), (2, 0), (0, 1))]}[kind]
    want = {r.id: r for r in near.groupBy("id").agg(*[F.sum(a * w).alias(f"v{n}") for n, a in zip("xyz", v)], F.count(F.lit(1)).alias("pings")).collect()}
    got = {r.id: r for r in x.collect()}
    assert got.keys() == want.keys() and all(got[i].pings == r.pings for i, r in want.items())
    for i, r in want.items():
        for n in ("vx", "vy", "vz"):
            assert (got[i][n] is None) == (r[n] is None) and (r[n] is None or np.isclose(got[i][n], r[n], rtol=1e-9, atol=1e-9, equal_nan=True))


def test_sample_within_makes_no_pairs(cloud):
    p, df = cloud
    x = spatial.sample_within(df, df, "v", RADIUS, low=0.05, skip_self=True)
    assert joins(x) == 1  # back to the points
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    for r in x.collect():
        near = [j for j in range(len(p)) if j != r.id and 0.0025 <= d2[r.id, j] <= RADIUS * RADIUS]
        assert (r.success, r.num_samples) == (bool(near), len(near))
        if near:
            w = 1 - d2[r.id, near] / (RADIUS * RADIUS)
            have = [k for k, j in enumerate(near) if j % 9]
            assert np.isclose(r.distance, np.sqrt(d2[r.id, near]).mean())
            assert r.value is None if not have else np.isclose(r.value, sum(w[k] * near[k] for k in have) / w.sum())


def test_crossings_and_overlaps_make_no_pairs(cloud):
    p, df = cloud
    s = [(i % 7, i // 7, p[i], p[i + 7]) for i in range(len(p) - 7)]
    want = set()
    for a, i, o, e in s:
        for b, j, q, f in s:
            u, v, w = e - o, f - q, q - o
            det = u[0] * v[1] - u[1] * v[0]
            if a < b and det and 0 <= (w[0] * v[1] - w[1] * v[0]) / det <= 1 and 0 <= (w[0] * u[1] - w[1] * u[0]) / det <= 1:
                want.add((a, i, b, j))
    x = paths.crossings(df.withColumnRenamed("dataset_id", "path_id"), 0.5)
    assert joins(x) == 0
    got = [(r.path_id, r.idx, r.r_path_id, r.r_idx) for r in x.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_stitch_shares_the_least_path(cloud):
    p, df = cloud
    x = df.withColumn("path_id", F.floor(F.col("id") / 4)).withColumn("idx", F.col("id") % 4)
    ends = {i: p[[4 * i, 4 * i + 3]] for i in range(65)}
    least = {i: i for i in ends}
    for _ in ends:
        for i in ends:
            for j in ends:
                if ((ends[i][:, None] - ends[j][None]) ** 2).sum(2).min() <= 0.04:
                    least[i] = least[j] = min(least[i], least[j])
    assert {r.path_id: r.stitched_id for r in along.stitch(x, 0.2).collect()} == least
    links = blocks.meet(df, blocks.right(df), blocks.forest(5.0, "id", "r_id"), "src long, dst long")
    assert links.count() < 6 * 300  # not 260 x 260


def test_connect_takes_the_shortest_edge_of_each_component(cloud):
    p, df = cloud
    df, p = df.where("id < 120"), p[:120]
    e = probes.knn(df, 1)
    comp = {r.node: r.component for r in graph.components(e).collect()}
    want = {tuple(r) for r in e.collect()}
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    for c in set(comp.values()):
        want.add(min((d2[i, j], min(i, j), max(i, j)) for i in comp for j in comp if comp[i] == c != comp[j])[1:])
    assert {tuple(r) for r in clusters.connect(e, df).collect()} == want


def test_match_values_compares_distinct_values(spark):
    c = spark.createDataFrame([(i, {"n": str(i % 9)} if i % 4 else {"n": "none"}) for i in range(60)], "dataset_id long, m map<string,string>")
    t = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(50)], "k long, need long")
    got = [tuple(r) for r in matching.match_values(c, t, F.try_element_at("m", F.lit("n")), ">", "need", target_key="k").collect()]
    want = [(i, j) for i in range(60) for j in range(50) if i % 4 and j % 7 and i % 9 > j % 5]
    assert sorted(got) == sorted(want)


def test_cones_compare_few_targets(monkeypatch):
    import pyarrow as pa

    n, seen, plain = 4000, [], np.arctan2
    monkeypatch.setattr(blocks.np, "arctan2", lambda y, x: seen.append(y.size) or plain(y, x))
    p = np.random.default_rng(6).normal(size=(n, 3)) * 0.13
    one, two = (pa.table({f"{s}id": np.arange(n), **{f"{s}{a}": v for a, v in zip("xyz", p.T)}}) for s in ("", "r_"))
    got = {(i, c): (s, j) for out in blocks.coned(6, 0.5, False, "id", "r_id")(one, two) for i, j, c, s in zip(out["id"].to_pylist(), out["r_id"].to_pylist(), out["cone"].tolist(), out["score"].tolist())}
    assert sum(seen) < 200 * n  # some 1,200 a point when targets came in rings
    for i in range(0, n, 97):
        d = p - p[i]
        cone = np.mod(np.floor(plain(d[:, 1], d[:, 0]) / (2 * math.pi) * 6), 6)
        for c in range(6):
            near = np.flatnonzero((cone == c) & ((d * d).sum(1) <= 0.25) & (np.arange(n) != i))
            assert ((i, c) in got) == bool(len(near))
            if len(near):
                m = (c + 0.5) * (2 * math.pi / 6)
                assert got[i, c][1] == near[(d[near, 0] * math.cos(m) + d[near, 1] * math.sin(m)).argmin()]


def test_block_numbers_compute_a_place_once(spark):
    p = spark.range(4000).select("id", *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
    x = blocks._blocked(p, [F.col(a) for a in "xyz"], "id", 8, [(0.0, 1.0)] * 3, "b")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan[plan.index("filter(") :]  # cuts are compared with a variable
    n = [r["count"] for r in x.groupBy("b").count().collect()]
    assert len(n) == 8 and max(n) < 700


def test_costs_of_few_links_take_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 60, 90), rng.integers(0, 60, 90), rng.choice([0.0, 0.1, 0.7, 2.3], 90))]
    rows += [(f"c{i}", f"c{i + 1}", 1.0) for i in range(40)] + [("n0", "c0", 0.3), ("n1", None, 1.0), ("u", "v", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    start = spark.createDataFrame([("n0",), ("n3",), ("alone",)], "node string")
    settled, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: settled.append(1) or settle(df))
    got = {r.node: r.cost for r in graph.bellman_ford(e, start).collect()}
    assert len(settled) == 2 and got["c40"] > 40 and got["alone"] == 0.0 and not {"u", None} & set(got)
    monkeypatch.setattr(graph, "LINKS", 0)
    assert {r.node: r.cost for r in graph.bellman_ford(e, start).collect()} == got


def test_simplify_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4), (4, 5), (5, 6), (6, 3), (8, 9)]
    e = spark.createDataFrame(rows, "src long, dst long").mapInArrow(pass_on, "src long, dst long")
    got = {tuple(r) for r in clusters.simplify(e).collect()}
    assert got == {(0, 2), (0, 3), (2, 3), (8, 9)}
    assert read.value == len(rows)


def test_supply_pairs_of_large_tables_take_more_tasks(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in tables.supply_edges(spark, folder).collect())
    monkeypatch.setattr(tables, "ROWS", 500)
    x = tables.supply_edges(spark, folder)
    sizes = [n for n in x.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) >= len(want) / 500 and max(sizes) < 1000
    assert sorted(tuple(r) for r in x.collect()) == want


def test_degree_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "d")]
    got = graph.degree(spark.createDataFrame(rows, "src string, dst string").mapInArrow(pass_on, "src string, dst string")).collect()
    assert {tuple(r) for r in got} == {("a", 2), ("b", 2), ("c", 2), ("d", 2)} and read.value == len(rows)
