import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import blend as B
from fieldloom.functions import compare as C
from fieldloom.functions import maths as M
from fieldloom.functions import noise
from fieldloom.operators import filters, geometry, graph, meta, packing, paths, probes, rangejoin, search, spatial
from fieldloom.plans import catalog

POINTS = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0), (4, 3.0, 0.0)]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("a", i, i, x, y, 0.0) for i, x, y in POINTS], "dataset_id string, idx long, id long, x double, y double, z double")


@pytest.fixture(scope="module")
def kite(spark):
    return spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 0), (0, 2, 3)], "cluster_id long, src long, dst long")


def edges(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_knn(five):
    assert edges(probes.knn(five, 1)) == {(0, 1), (0, 3), (1, 2), (1, 4)}
    assert edges(probes.knn(five, 2)) == {(0, 1), (0, 3), (1, 2), (1, 4), (2, 3), (2, 4)}
    assert edges(probes.knn(five, 2, True)) == {(0, 1), (0, 3), (1, 2), (2, 3)}


def test_dbscan_and_gabriel(five):
    assert edges(probes.dbscan(five, 1.0, 2)) == {(0, 1), (1, 2), (2, 3), (0, 3)}
    whole = five.select(F.col("id").alias("src")).crossJoin(five.select(F.col("id").alias("dst"))).where("src < dst")
    assert edges(graph.gabriel(whole, five)) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4)}


def test_nearest_is_exact_at_any_first_radius(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(120, 3)) * [1, 5, 0.2]
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    got = {}
    for r in rangejoin.nearest(df, df, 3, skip_self=True).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.r_id
    for i, q in enumerate(p):
        d = ((p - q) ** 2).sum(1)
        want = [j for j in np.lexsort((np.arange(120), d)) if j != i][:3]
        assert [got[i][k] for k in (1, 2, 3)] == want


def test_fuse_and_normalize(five):
    assert sorted(r.fused for r in spatial.fuse_voxel(five, 4.0).collect()) == [1, 4]
    assert sorted(r.fused for r in spatial.fuse_voxel(five, 2.0).collect()) == [1] * 5
    assert [round(r.u, 6) for r in spatial.normalize(five).orderBy("idx").collect()] == [0, 0.333333, 0.333333, 0, 1]


def test_closed_path(five):
    square = five.where("idx < 4").withColumnRenamed("dataset_id", "path_id")
    r = paths.summary(square, True).first()
    assert (r.length, r.perimeter, r.area, r.is_clockwise, r.centroid_x) == (4, 4, 1, False, 0.5)
    rows = paths.properties(square, True).orderBy("idx").collect()
    assert [r.distance_to_start for r in rows] == [0, 1, 2, 3] and [r.point_time for r in rows] == [0, 0.25, 0.5, 0.75]


def test_resample_keeps_ends(five):
    rows = paths.resample(five.withColumnRenamed("dataset_id", "path_id"), 6).orderBy("sample").collect()
    assert len(rows) == 6 and (rows[0].x, rows[0].y, rows[-1].x, rows[-1].y) == (0, 0, 3, 0)


def test_centralities(kite):
    want = {0: (0, 0.75, 2.5, 0.522721), 1: (0, 0.75, 2.5, 0.522721), 2: (2, 1.0, 3.0, 0.611628), 3: (0, 0.6, 2.0, 0.281845)}
    got = {r.node: r for r in search.centrality(kite).collect()}
    vector = {r.node: r.score for r in graph.eigenvector(kite, 60).collect()}
    katz = {r.node: round(r.score, 6) for r in graph.katz(kite, 0.1, 40).collect()}
    for n, (between, close, harmonic, eigen) in want.items():
        assert (got[n].betweenness, round(got[n].closeness, 6), got[n].harmonic) == (between, close, harmonic)
        assert abs(vector[n] - eigen) < 1e-5
    assert katz == {0: 1.262916, 1: 1.262916, 2: 1.366246, 3: 1.136625}
    assert {r.node: r.degree for r in graph.degree(kite).collect()} == {0: 2, 1: 2, 2: 3, 3: 1}


def test_kite_structure(kite):
    assert edges(search.bridges(kite)) == {(2, 3)}
    assert edges(graph.remove_leaves(kite)) == {(0, 1), (1, 2), (2, 0)}
    assert edges(graph.remove_leaves(kite, 0)) == {(0, 1), (1, 2), (2, 0)}
    assert graph.spanning_forest(kite.withColumn("weight", F.lit(1.0))).count() == 3
    assert {r.component for r in graph.components(kite).collect()} == {0}
    assert {r.node: r.depth for r in graph.hops(kite, kite.select(F.lit(3).cast("long").alias("node")).limit(1)).collect()}[0] == 2


def test_partition_keys(spark):
    df = spark.createDataFrame([(v,) for v in (-1.5, -0.2, 0.0, 0.2, 1.0, 1.5)], "v double")
    keys = lambda mode: [r.k for r in df.select("v", meta.PartitionRule("v", 1.0, mode=mode).key().alias("k")).orderBy("v").collect()]
    assert keys("floor") == [-2, -1, 1, 1, 2, 2]
    assert keys("ceil") == [-1, 0, 0, 1, 1, 2]


def test_stats(spark):
    r = meta.attribute_stats(spark.createDataFrame([("a", v) for v in (0, 0, 3, 5, 5, -2)], "dataset_id string, v long"), "v").first()
    assert (r.samples, r.min, r.max, r.default_values, r.different_values, r.unique_values, r.set_min, r.set_max) == (6, -2, 5, 2, 4, 2, -2, 5)
    assert abs(r.average - 11 / 6) < 1e-12 and not r.has_only_default and not r.has_only_set
    empty = meta.attribute_stats(spark.createDataFrame([], "dataset_id string, v long"), "v")
    assert empty.count() == 0


def test_nearest_sampling(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 1.0, 0.0, 0.0, 10.0), (8, 2.0, 0.0, 0.0, 20.0)], "id long, x double, y double, z double, v double")
    near, far = spatial.sample_within(a, b, "v", 2.0).orderBy("id").collect()
    assert (near.num_samples, near.distance, near.value) == (2, 1.5, 10.0)
    assert (far.success, far.num_samples, far.distance, far.value) == (False, 0, 2.0, None)


def test_strings_bits_and_modulo(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("r")).first().r
    text = lambda op: ask(C.string(F.lit("abcd"), op, F.lit("abc")))
    assert text("len>") and text("contains") and text("startswith") and not text("endswith") and not text("locale<")
    bit = lambda m: ask(C.bits(F.lit(0b0110), m, F.lit(0b0011)))
    assert bit("any") and not bit("all") and not bit("strict") and not bit("none_any") and bit("none_all")
    assert ask(filters.modulo(F.lit(0.0), F.lit(2.0), "==", 1.0, True)) and ask(filters.modulo(F.lit(-7.5), F.lit(2.0), "==", -1.5))
    assert C.bitmask([0, 63]) == 1 - (1 << 63)
    assert ask(M.curve(F.lit(0.25), [(0, 0), (0.5, 1), (1, 0)])) == 0.5 and ask(M.snap(F.lit(7.4), 2.0)) == 8.0


def test_ordered_folds(spark):
    df = spark.createDataFrame([(0, 10.0, 1.0), (1, 20.0, 0.5), (2, 0.0, 0.5)], "k long, v double, w double")
    assert df.agg(B.aggregate("v", "lerp", "w", "k").alias("r")).first().r == 7.5
    assert df.agg(B.aggregate("v", "copy_source", order="k").alias("r")).first().r == 0.0


def test_search_methods_agree(spark):
    rng = np.random.default_rng(5)
    n = 60
    spots = {i: tuple(rng.random(3)) for i in range(n)}
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (180, 2)) if a != b}
    links = search.adjacency(*zip(*[(a, b, math.dist(spots[a], spots[b])) for a, b in sorted(pairs)]))
    for goal in range(1, n, 7):
        if 0 not in links or goal not in links:
            continue
        cost, path = search.shortest_path(links, 0, goal)
        for other, way in (search.bidirectional(links, 0, goal), search.shortest_path(links, 0, goal, lambda m, g=goal: math.dist(spots[m], spots[g]))):
            assert abs(other - cost) < 1e-9 or (math.isinf(other) and math.isinf(cost))
            assert abs(sum(dict(links[a])[b] for a, b in zip(way, way[1:])) - (0 if math.isinf(cost) else cost)) < 1e-9


def test_fill_never_improves_a_distance():
    links = search.adjacency([0, 0, 1], [1, 2, 2], [1.0, 5.0, 1.0])
    assert search.fill(links, [0])[2][3] == 5.0
    assert set(search.fill(links, [0], {"max_depth": 0})) == {0}


def test_geometry_properties():
    rng = np.random.default_rng(0)
    xy = rng.random((150, 2))
    ring = geometry.hull([tuple(p) for p in xy])
    assert all(geometry.cross(a, b, tuple(p)) >= -1e-12 for a, b in zip(ring, ring[1:] + ring[:1]) for p in xy)
    triangles = geometry.delaunay(xy)
    assert abs(sum(geometry.cross(*xy[list(t)]) / 2 for t in triangles) - geometry.area(ring)) < 1e-6
    for t in triangles[:40]:
        a, b, c = xy[list(t)]
        for p in xy:
            det = np.linalg.det([[*(q - p), (q - p) @ (q - p)] for q in (a, b, c)])
            assert det < 1e-9
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert abs(geometry.area(geometry.clip_rect(square, (1, 1), (3, 3))) - 1) < 1e-12
    assert abs(geometry.area(geometry.clip_convex(square, [(1, 1), (3, 1), (3, 3), (1, 3)])) - 1) < 1e-12
    assert abs(geometry.area(geometry.offset_convex(square, 1)) - 16) < 1e-12
    concave = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert abs(sum(abs(geometry.cross(*[concave[i] for i in t])) / 2 for t in geometry.ears(concave)) - geometry.area(concave)) < 1e-12
    cells = geometry.faces({0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1)}, {0: [1, 2, 3], 1: [0, 2], 2: [0, 1, 3], 3: [0, 2]})
    assert len(cells) == 2


def test_packing_has_no_overlap():
    rng = np.random.default_rng(1)
    items = [(i, *rng.integers(1, 6, 3).astype(float)) for i in range(60)]
    sizes = {i[0]: i[1:] for i in items}
    got = packing.guillotine(items, (8.0, 8.0, 8.0))
    for a in got:
        for b in got:
            if a[0] < b[0] and a[1] == b[1]:
                assert any(a[2 + k] + sizes[a[0]][k] <= b[2 + k] + 1e-9 or b[2 + k] + sizes[b[0]][k] <= a[2 + k] + 1e-9 for k in range(3))
    assert packing.guillotine([(0, 9.0, 1.0, 1.0)], (8.0, 8.0, 8.0))[0][1] == -1


def test_collapse_keeps_the_rules():
    links = search.adjacency([0, 1, 2, 3], [1, 2, 3, 0], [1.0] * 4)
    got = packing.collapse(links, 2, ~np.eye(2, dtype=bool), 1)
    assert all(got[a] != got[b] for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)))


def test_self_prune_is_the_greedy_order(spark):
    rng = np.random.default_rng(2)
    p = rng.random((80, 3))
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    kept: list = []
    for i in range(80):
        if all(((p[i] - p[j]) ** 2).sum() > 0.09 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in spatial.self_prune(df, 0.3, F.col("id")).collect()) == kept


@pytest.mark.parametrize("name", sorted(noise.NOISES))
def test_noise_is_bounded_and_repeatable(name):
    p = np.random.default_rng(4).normal(size=(500, 3)) * 10
    a, b = noise.NOISES[name](p), noise.NOISES[name](p.copy())
    assert (a == b).all() and np.isfinite(a).all() and a.std() > 0


SMALL = ("attribute_stats", "reduce_join", "partition_two_rules", "remap_full", "filter_mean_mode_max", "match_limit", "path_split_partition", "attribute_rolling", "sample_closest", "probe_theta", "merge_points")


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_their_sql(spark, name):
    import os

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    got = catalog.queries()[name](spark, folder)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    place = [[d[0] for d in cursor.description].index(n) for n in names]
    plain = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert sorted(got.columns) == names
    assert plain(got.select(*names).collect()) == plain([[r[i] for i in place] for r in cursor.fetchall()])


WHOLE = ("match_shared_tag_any", "match_shared_tag_all", "match_copy_tags", "match_overlap", "pathfinding_dijkstra", "pathfinding_bidirectional", "pathfinding_astar")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_queries_equal_their_sql(spark, name):
    test_queries_equal_their_sql(spark, name)


def test_whole_matches_use_every_row(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r.candidate, r.target) for r in catalog.queries()["match_overlap"](spark, folder).collect()}
    boxes = {}
    for r in spark.read.parquet(f"{folder}/part.parquet").collect():
        boxes.setdefault(f"{r.p_brand} {r.p_type} {r.p_size // 5}", []).append((r.p_size, r.p_retailprice))
    ends = {k: [(min(c), max(c)) for c in zip(*v)] for k, v in boxes.items()}
    assert got == {(a, b) for a in ends for b in ends if all(p[0] <= q[1] and q[0] <= p[1] for p, q in zip(ends[a], ends[b]))}
    tags = {}
    for r in spark.read.parquet(f"{folder}/customer.parquet").collect():
        tags.setdefault(r.c_nationkey * 100 + math.floor(r.c_acctbal / 500) + 2, set()).add(r.c_mktsegment)
    got = {(r.candidate, r.target) for r in catalog.queries()["match_shared_tag_all"](spark, folder).collect()}
    assert got == {(a, b) for a in tags for b in tags if tags[a] <= tags[b]}


def test_one_search_finds_the_paths_of_each_goal():
    rng = np.random.default_rng(11)
    ends = rng.integers(0, 60, (2, 90))
    links = search.adjacency(*ends.tolist(), rng.integers(1, 6, 90).tolist())
    for start in (0, 7, 99):
        goals = [*range(60), 99, 100]
        assert search.shortest_paths(links, start, goals) == {g: search.shortest_path(links, start, g) for g in goals}


def test_plot_edges_stop_at_every_point(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    length = np.full((n, n), np.inf)
    np.fill_diagonal(length, 0)
    for r in catalog._weighted(spark, folder).collect():
        length[r.src, r.dst] = length[r.dst, r.src] = r.weight
    for k in range(n):
        length = np.minimum(length, length[:, k : k + 1] + length[k])
    got = {(r.start, r.goal): r.cost for r in catalog.queries()["pathfinding_plot_edges"](spark, folder).collect()}
    assert sorted(got) == [(i, i + 1) for i in range(n - 1)]
    assert all(c is None and np.isinf(length[k]) or abs(c - length[k]) < 1e-5 for k, c in got.items())


def test_costs_along_a_chain_of_more_than_64_edges(spark):
    chain = spark.range(80).selectExpr("id AS src", "id + 1 AS dst", "1.5 AS weight").unionByName(spark.createDataFrame([(0, 80, 100.0)], "src long, dst long, weight double"))
    start = spark.createDataFrame([(0,)], "node long")
    # the dear edge pays at the far end only
    assert {r.node: r.cost for r in graph.bellman_ford(chain, start).collect()} == {i: min(1.5 * i, 100 + 1.5 * (80 - i)) for i in range(81)}
    assert {r.node: r.depth for r in graph.hops(chain.where("dst <> 80 or src = 79"), start).collect()} == {i: i for i in range(81)}
    with pytest.raises(ValueError):
        graph.bellman_ford(chain.withColumn("weight", -F.col("weight")), start)


def test_self_prune_decides_every_point_of_a_long_line(spark):
    line = spark.range(110).selectExpr("id", "cast(id AS double) AS x", "0D AS y", "0D AS z").coalesce(1)
    assert sorted(r.id for r in spatial.self_prune(line, 1.5, F.col("id")).collect()) == list(range(0, 110, 2))


def test_components_and_spanning_forest_of_a_long_chain(spark):
    chain = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.hops(chain, spark.createDataFrame([(0,)], "node long")).count() == 101
    assert graph.spanning_forest(chain).count() == 100
