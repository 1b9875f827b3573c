"""More named queries: travel scores, edge and node filters, pickers from sets, orientation, numeric helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend as B
from ..functions import compare as C
from ..functions import maths as M
from ..operators import filters, graph, heuristics, paths
from ..sources import tables
from .catalog import _KE, _NN, _WP, D2, EVT, PTS, T, _knn_edges, query, r6

# --- Travel scores ---------------------------------------------------------------------------------------------------

#: Steps both ways along the 3-nearest graph, with unit directions; the value of a point is its y.
_TR = f"""{_KE}, ts AS (SELECT a AS node, b AS other, p.x AS px, p.y AS py, p.z AS pz, q.y AS qy, sqrt({D2('p', 'q')}) AS l, (q.x - p.x) / nullif(sqrt({D2('p', 'q')}), 0) AS dx, (q.y - p.y) / nullif(sqrt({D2('p', 'q')}), 0) AS dy, (q.z - p.z) / nullif(sqrt({D2('p', 'q')}), 0) AS dz
FROM (SELECT src AS a, dst AS b FROM ke UNION ALL SELECT dst, src FROM ke) JOIN pts p ON p.id = a JOIN pts q ON q.id = b)"""


def _steps(s, d):
    p = tables.embedding_points(s, d)
    return heuristics.steps(_knn_edges(s, d), p.select("id", "x", "y", "z", F.col("y").alias("v")), ("v",))


_SCORES = {
    "steepness": ("abs(coalesce(dz, 0))", lambda: heuristics.steepness()),
    "steepness_signed": ("(coalesce(dz, 0) + 1) / 2", lambda: heuristics.steepness(absolute=False)),
    "azimuth": ("(coalesce((dx * (0.5 - px) + dy * (0.25 - py) + dz * (0 - pz)) / nullif(sqrt(pow(0.5 - px, 2) + pow(0.25 - py, 2) + pz * pz), 0), 0) + 1) / 2", lambda: heuristics.azimuth((0.5, 0.25, 0.0))),
    "gradient_increasing": ("(1 - least(greatest(qy - py, -1), 1)) / 2", lambda: heuristics.gradient("v")),
    "gradient_decreasing": ("(1 + least(greatest(CASE WHEN l > 1e-4 THEN (qy - py) / l ELSE qy - py END, -1), 1)) / 2", lambda: heuristics.gradient("v", "decreasing", True)),
    "gradient_avoid": ("least(greatest((abs(qy - py) - 0.1) / 0.4, 0), 1)", lambda: heuristics.gradient("v", "avoid", low=0.1, high=0.5)),
    "gradient_seek": ("1 - least(greatest((abs(qy - py) - 0.1) / 0.4, 0), 1)", lambda: heuristics.gradient("v", "seek", low=0.1, high=0.5)),
    "least_nodes": ("0.5", heuristics.least_nodes),
}
for _name, (_sql, _score) in _SCORES.items():
    query(f"WITH {_TR} SELECT node, other, round({_sql}, 6)::DOUBLE AS score FROM ts", f"heuristics_{_name}")(lambda s, d, f=_score: _steps(s, d).select("node", "other", F.round(f(), 6).alias("score")))


@query(f"WITH {_TR} SELECT node, other, round((qy - min(qy) OVER ()) / (max(qy) OVER () - min(qy) OVER ()), 6) AS score FROM ts")
def heuristics_attribute(s, d):
    return heuristics.attribute(_steps(s, d), "to_v").select("node", "other", *r6("score"))


# --- Edges and nodes -------------------------------------------------------------------------------------------------

for _m, (_largest, _keep) in {"keep_highest": (True, True), "keep_lowest": (False, True), "remove_highest": (True, False), "remove_lowest": (False, False)}.items():
    query(
        f"""WITH {_TR}, el AS (SELECT node, arg_min(other, ({'-' if _largest else ''}abs(coalesce(dz, 0)), other)) AS other FROM ts GROUP BY node), ch AS (SELECT DISTINCT least(node, other) AS src, greatest(node, other) AS dst FROM el)
        SELECT src, dst FROM ke {'SEMI' if _keep else 'ANTI'} JOIN ch USING (src, dst)""",
        f"refine_{_m}_score",
    )(
        lambda s, d, g=_largest, k=_keep: graph.elect(
            graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)).select("src", "dst", heuristics.steepness().alias("score")), "score", g, k
        ).select("src", "dst")
    )


@query(f"WITH {_KE} SELECT CASE WHEN p.x <= q.x THEN src ELSE dst END AS src, CASE WHEN p.x <= q.x THEN dst ELSE src END AS dst FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst")
def cluster_edge_order(s, d):
    p = tables.embedding_points(s, d)
    x = _knn_edges(s, d).join(p.select(F.col("id").alias("src"), F.col("x").alias("ax")), "src").join(p.select(F.col("id").alias("dst"), F.col("x").alias("bx")), "dst")
    return graph.edge_order(x, F.col("ax") <= F.col("bx")).select("src", "dst")


@query("""WITH e AS (SELECT c_custkey AS a, c_custkey % 50 + 1 AS b FROM customer UNION ALL SELECT c_custkey % 50 + 1, c_custkey FROM customer UNION ALL SELECT c_custkey, -1 FROM customer)
SELECT DISTINCT least(a, b)::BIGINT AS src, greatest(a, b)::BIGINT AS dst FROM e WHERE a <> b AND a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)""")
def cluster_sanitize(s, d):
    k = T(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    one = k.select(F.col("id").alias("src"), (F.col("id") % 50 + 1).alias("dst"))
    return graph.sanitize(one.union(one.select("dst", "src")).union(k.select("id", F.lit(-1).cast("long"))), k)


@query("SELECT 'n' || n_nationkey AS src, 'c' || c_custkey AS dst FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name > c_mktsegment")
def edge_endpoints_compare_string(s, d):
    n, c = T(s, d, "nation"), T(s, d, "customer")
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    values = n.select(node("n", "n_nationkey").alias("node"), F.col("n_name").alias("value")).union(c.select(node("c", "c_custkey"), "c_mktsegment"))
    e = c.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    return graph.endpoints_compare(e, values, lambda a, b: C.string(a, "locale>", b)).where("passes").select("src", "dst")


for _m, _sql in {"any": "bool_or(ok)", "all": "bool_and(ok)", "some": "count(*) FILTER (ok) >= 2"}.items():
    query(f"WITH {_TR}, ok AS (SELECT node, coalesce(dx, 0) >= 0.3 AS ok FROM ts) SELECT node FROM ok GROUP BY node HAVING {_sql}", f"vtx_filter_edge_direction_{_m}")(
        lambda s, d, m=_m: heuristics.node_direction(_knn_edges(s, d), tables.embedding_points(s, d), (1.0, 0.0, 0.0), 0.3, m, 2).where("passes").select("node")
    )


@query(f"""WITH {_NN}, ke AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM nn WHERE r <= 1), ts AS (SELECT a AS node, b AS other, (q.x - p.x) / sqrt({D2('p', 'q')}) AS dx, (q.y - p.y) / sqrt({D2('p', 'q')}) AS dy, (q.z - p.z) / sqrt({D2('p', 'q')}) AS dz
FROM (SELECT src AS a, dst AS b FROM ke UNION ALL SELECT dst, src FROM ke) JOIN pts p ON p.id = a JOIN pts q ON q.id = b), c AS (SELECT node FROM ts GROUP BY node HAVING count(*) = 2)
SELECT u.node FROM ts u JOIN ts v ON u.node = v.node AND u.other < v.other WHERE u.node IN (SELECT node FROM c) AND u.dx * v.dx + u.dy * v.dy + u.dz * v.dz <= -0.2""")
def vtx_filter_edge_angle(s, d):
    from ..operators import probes

    p = tables.embedding_points(s, d)
    return heuristics.node_angle(probes.knn(p, 1), p, -0.2).where("passes").select("node")


@query("SELECT o_orderkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey")
def sample_vtx_by_id(s, d):
    v = T(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    return T(s, d, "orders").join(v, "o_custkey").select("o_orderkey", "c_name", "c_acctbal")


# --- Filters and pickers ---------------------------------------------------------------------------------------------


@query(f"WITH {PTS} SELECT a.id FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id HAVING sqrt(min({D2()})) <= 0.05")
def filter_distance(s, d):
    p = tables.embedding_points(s, d)
    return filters.distance_nearest(p, p.select("id", "x", "y", "z"), "<=", 0.05, skip_self=True, tolerance=0.0).where("passes").select("id")


@query(f"WITH {EVT}, n AS (SELECT event_id, event_type, lead(event_type) OVER w AS o FROM evt {_WP}) SELECT event_id FROM n WHERE coalesce(event_type = o, false)")
def filter_self_compare_string(s, d):
    return filters.self_compare_string(tables.event_paths(s, d), "event_type", "==", 1, "path_id").where("passes").select("event_id")


@query("SELECT o_orderkey FROM orders")
def filter_constant(s, d):
    return T(s, d, "orders").where(filters.constant(False, invert=True)).select("o_orderkey")


@query("SELECT 'orders' AS dataset, true AS passes UNION ALL SELECT 'customer', false UNION ALL SELECT 'part', false")
def data_filter_attribute_check(s, d):
    rows = [(t, filters.attribute_check(T(s, d, t), "o_orderpriority", "string")) for t in ("orders", "customer", "part")]
    return s.createDataFrame(rows, "dataset string, passes boolean")


@query(f"WITH {PTS} SELECT id FROM pts WHERE idx BETWEEN 2 AND 9")
def picker_range(s, d):
    return filters.picker(tables.embedding_points(s, d), [(2, 9)]).select("id")


@query(f"WITH {PTS}, c AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n FROM pts) SELECT id FROM c WHERE idx IN (SELECT DISTINCT p_size FROM part)")
def picker_indices_from_set(s, d):
    return filters.pick_set(tables.embedding_points(s, d), T(s, d, "part"), "p_size").select("id")


@query(f"WITH {PTS} SELECT id FROM pts WHERE EXISTS (SELECT 1 FROM supplier WHERE idx BETWEEN s_suppkey * 3 AND s_suppkey * 3 + s_nationkey % 2)")
def picker_ranges_from_set(s, d):
    k = T(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("lo"), (F.col("s_suppkey") * 3 + F.col("s_nationkey") % 2).alias("hi"))
    return filters.pick_ranges(tables.embedding_points(s, d), k, "lo", "hi").select("id")


# --- Paths -----------------------------------------------------------------------------------------------------------


@query(f"WITH {EVT}, n AS (SELECT event_id, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM evt {_WP}), u AS (SELECT event_id, bx, b_y, nullif(sqrt(bx * bx + b_y * b_y), 0) AS l FROM n) SELECT event_id, round(coalesce(bx / l, 0), 6) + 0.0 AS dx, round(coalesce(b_y / l, 0), 6) + 0.0 AS dy FROM u")
def path_orient_look_at(s, d):
    x = paths.look_at(tables.event_paths(s, d))
    return x.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy")])


for _m, _sql in {"first": "first_value(y) OVER v", "last": "last_value(y) OVER v", "none": "y"}.items():
    query(
        f"WITH {EVT} SELECT event_id, {_sql} AS blended FROM evt WINDOW v AS (PARTITION BY path_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        f"path_blend_inherit_{_m}",
    )(lambda s, d, m=_m: paths.inherit(tables.event_paths(s, d), "y", m).select("event_id", "blended"))


# --- Numeric helpers -------------------------------------------------------------------------------------------------

_MATHS = {
    "tile": ("v - 900 - floor((v - 900) / 250) * 250 + 900", lambda: M.tile("v", 900.0, 1150.0)),
    "truncate_round": ("floor(v + 0.5)::DOUBLE", lambda: M.truncate("v", "round").cast("double")),
    "truncate_ceil": ("ceil(v)::DOUBLE", lambda: M.truncate("v", "ceil").cast("double")),
    "truncate_floor": ("floor(v)::DOUBLE", lambda: M.truncate("v", "floor").cast("double")),
    "snap": ("floor(v / 25 + 0.5) * 25", lambda: M.snap("v", 25.0)),
    "contrast": ("CASE WHEN u < 0.5 THEN pow(u * 2, 2.0) / 2 ELSE 1 - pow((1 - u) * 2, 2.0) / 2 END", lambda: M.contrast("u", 2.0)),
    "curve": ("CASE WHEN u <= 0.2 THEN 0.0 WHEN u < 0.5 THEN (u - 0.2) / 0.3 WHEN u < 0.9 THEN 1 - (u - 0.5) / 0.4 * 0.5 ELSE 0.5 END", lambda: M.curve("u", [(0.2, 0.0), (0.5, 1.0), (0.9, 0.5)])),
}
for _name, (_sql, _f) in _MATHS.items():
    query(f"SELECT p_partkey, round({_sql}, 5) AS value FROM (SELECT p_partkey, p_retailprice::DOUBLE AS v, (p_partkey % 97) / 96.0::DOUBLE AS u FROM part)", f"maths_{_name}")(
        lambda s, d, f=_f: T(s, d, "part")
        .select("p_partkey", F.col("p_retailprice").cast("double").alias("v"), ((F.col("p_partkey") % 97) / F.lit(96.0)).alias("u"))
        .select("p_partkey", F.round(f(), 5).alias("value"))
    )


@query("SELECT p_partkey, round(p_retailprice / 2, 4) AS price, round((p_size + p_size % 5) / 2, 4) AS size FROM (SELECT p_partkey, p_retailprice::DOUBLE AS p_retailprice, p_size::DOUBLE AS p_size FROM part)")
def blend_all(s, d):
    x = T(s, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("a_price"), F.lit(0.0).alias("b_price"), F.col("p_size").cast("double").alias("a_size"), (F.col("p_size") % 5).cast("double").alias("b_size"))
    return B.blend_all(x, "a_", "b_", "average").select("p_partkey", *[F.round(c, 4).alias(c) for c in ("price", "size")])
