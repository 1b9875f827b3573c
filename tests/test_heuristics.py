import math

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import filters, heuristics, paths

POINTS = [(0, 0.0, 0.0, 0.0, 1.0), (1, 3.0, 0.0, 4.0, 1.5), (2, 3.0, 0.0, 4.0, 9.0), (3, 0.0, 2.0, 0.0, None)]
EDGES = [(0, 1), (0, 3), (1, 2)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(EDGES, "src long, dst long"), spark.createDataFrame(POINTS, "id long, x double, y double, z double, v double")


def scores(x, score):
    return {(r.node, r.other): r.s for r in x.select("node", "other", score.alias("s")).collect()}


def test_steps_go_both_ways_and_scores_agree_with_plain_ones(graph):
    x = heuristics.steps(*graph, ("v",))
    at = {i: p for i, *p in POINTS}
    plain = {}
    for a, b in [*EDGES, *[(b, a) for a, b in EDGES]]:
        way = [q - p for p, q in zip(at[a][:3], at[b][:3])]
        size = math.sqrt(sum(w * w for w in way))
        plain[a, b] = [w / size if size else 0.0 for w in way], size, at[a], at[b]
    up = scores(x, heuristics.steepness())
    signed = scores(x, heuristics.steepness(absolute=False))
    least = scores(x, heuristics.least_nodes())
    assert set(up) == set(plain) == set(least)
    for k, (way, size, a, b) in plain.items():
        assert up[k] == pytest.approx(abs(way[2])) and signed[k] == pytest.approx((way[2] + 1) / 2) and least[k] == 0.5
    goal = (0.0, 2.0, 0.0)
    for k, s in scores(x, heuristics.azimuth(goal)).items():
        way, _, a, _ = plain[k]
        to = [g - p for g, p in zip(goal, a)]
        far = math.sqrt(sum(t * t for t in to))
        assert s == pytest.approx((1 + (sum(p * q for p, q in zip(way, to)) / far if far else 0)) / 2)
    for mode, f in {"increasing": lambda g: (1 - max(-1, min(1, g))) / 2, "avoid": lambda g: min(max(abs(g) / 4, 0), 1), "seek": lambda g: 1 - min(max(abs(g) / 4, 0), 1)}.items():
        for k, s in scores(x, heuristics.gradient("v", mode, high=1.0 if mode == "increasing" else 4.0)).items():
            a, b = plain[k][2][3], plain[k][3][3]
            assert s == pytest.approx(f(b - a)) if None not in (a, b) else s is None or mode == "increasing" or s in (0.0, 1.0)


def test_attribute_score_of_equal_and_of_no_values(spark, graph):
    x = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k long, v double")
    assert [r.score for r in heuristics.attribute(x, "v").collect()] == [0.0, 0.0]
    assert heuristics.attribute(x.where("k > 9"), "v").count() == 0


def test_node_angle_sums_a_nodes_edges(spark, graph):
    e = spark.createDataFrame([(0, 1), (0, 3)], "src long, dst long")
    got = {r.node: r.passes for r in heuristics.node_angle(e, graph[1], 0.1, leaves=True).collect()}
    assert got == {0: True, 1: True, 3: True}
    straight = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.node: r.passes for r in heuristics.node_angle(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), straight, -0.9).collect()}
    assert got == {0: False, 1: True, 2: False}


def test_node_direction(graph):
    got = {m: {r.node: r.passes for r in heuristics.node_direction(*graph, (0.0, 0.0, 1.0), 0.5, m, 2).collect()} for m in ("any", "all", "some")}
    assert got["any"] == {0: True, 1: False, 2: False, 3: False}
    assert got["all"] == {0: False, 1: False, 2: False, 3: False} and not any(got["some"].values())


def test_pickers_from_sets(spark):
    x = spark.range(3000).select(F.lit("a").alias("dataset_id"), F.col("id").alias("idx"))
    r = spark.createDataFrame([(-4, 1), (1020, 1030), (1025, 1027), (2999, 9_000_000_000), (7, 5), (None, None)], "lo long, hi long")
    want = [i for i in range(3000) if i <= 1 or 1020 <= i <= 1030 or i == 2999]
    assert sorted(v.idx for v in filters.pick_ranges(x, r, "lo", "hi").collect()) == want
    assert filters.pick_ranges(x.limit(0), r, "lo", "hi").count() == 0
    p = spark.createDataFrame([(5,), (5,), (-1,), (4000,), (None,)], "k long")
    assert [v.idx for v in filters.pick_set(x, p, "k").collect()] == [5]


def test_text_against_the_next_row_distance_and_look_at(spark):
    x = spark.createDataFrame([("a", 0, 0.0, "s"), ("a", 1, 2.0, "s"), ("a", 2, 2.0, None)], "path_id string, idx long, x double, t string").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "id": F.col("idx")})
    assert {r.idx: r.passes for r in filters.self_compare_string(x, "t", "==", by="path_id").collect()} == {0: True, 1: False, 2: False}
    assert {r.idx: r.dx for r in paths.look_at(x).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}
    assert {r.idx: r.blended for r in paths.inherit(x, "x", "last").collect()} == {0: 2.0, 1: 2.0, 2: 2.0}
    got = filters.distance_nearest(x, x.select("id", "x", "y", "z"), "<", 1.0, skip_self=True).collect()
    assert {r.idx: r.passes for r in got} == {0: False, 1: True, 2: True}
