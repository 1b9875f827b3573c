"""Named queries over the driver tables, with equivalent DuckDB SQL.

Every query runs over its whole tables. `_QUERIES` maps a name to (function of session and folder, SQL or None).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend as B
from ..functions import compare as C
from ..functions import maths as M
from ..functions import noise
from ..operators import along, clusters, fields, filters, geometry, graph, matching, meta, packing, paths, probes, search, spatial
from ..sources import shapes, tables

_QUERIES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


T = tables.read
#: Points of the first three dimensions of embeddings; paths of events; graphs.
PTS = """pts AS (SELECT label::VARCHAR AS dataset_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id AS id,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
EVT = """evt AS (SELECT user_id::VARCHAR AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch(date_trunc('second', ts))::DOUBLE AS x, value::DOUBLE AS y, 0.0::DOUBLE AS z, event_id, event_type FROM events)"""
SUP = "sup AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
PLC = """plc AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def D2(a="a", b="b", n="xyz"):
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in n)


# --- Attributes ------------------------------------------------------------------------------------------------------

_STATS = """
WITH v AS ({v}), h AS (SELECT dataset_id, value, count(*) AS n FROM v GROUP BY ALL)
SELECT dataset_id, sum(n)::BIGINT AS samples, min(value) AS min, max(value) AS max, round(sum(value * n) / sum(n), 6) AS average,
  min(value) FILTER (value <> {d}) AS set_min, max(value) FILTER (value <> {d}) AS set_max, coalesce(sum(n) FILTER (value = {d}), 0)::BIGINT AS default_values,
  count(*) FILTER (n = 1) AS unique_values, count(*) AS different_values, count(*) FILTER (n = 1 AND value <> {d}) AS unique_set_values,
  count(*) FILTER (value <> {d}) AS different_set_values, bool_and(value = {d}) AS has_only_default, bool_and(value <> {d}) AS has_only_set, bool_and(n = 1) AS has_only_unique
FROM h GROUP BY dataset_id"""


@query(_STATS.format(v="SELECT l_returnflag AS dataset_id, l_quantity AS value FROM lineitem", d=0))
def attribute_stats(s, d):
    x = T(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), "l_quantity")
    return meta.attribute_stats(x, "l_quantity").withColumn("average", F.round("average", 6))


@query(_STATS.format(v="SELECT p_brand AS dataset_id, p_size AS value FROM part", d=1))
def attribute_stats_default(s, d):
    x = T(s, d, "part").select(F.col("p_brand").alias("dataset_id"), "p_size")
    return meta.attribute_stats(x, "p_size", 1).withColumn("average", F.round("average", 6))


@query("SELECT o_orderpriority AS value, o_orderstatus AS dataset_id, count(*) AS occurrences FROM orders GROUP BY ALL")
def attribute_histogram(s, d):
    return meta.histogram(T(s, d, "orders"), "o_orderpriority", "o_orderstatus").withColumnRenamed("o_orderstatus", "dataset_id")


@query("SELECT o_orderstatus, arg_min(v, k) AS mode FROM (SELECT o_orderstatus, o_orderpriority AS v, (-count(*), o_orderpriority) AS k FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY o_orderstatus")
def attribute_text_mode(s, d):
    return meta.text_mode(T(s, d, "orders"), "o_orderpriority", "o_orderstatus")


for _mode, _sql in {
    "min": "min(n_name)", "max": "max(n_name)", "join": "string_agg(n_name, ', ' ORDER BY n_nationkey)", "hash": "md5(string_agg(n_name, ',' ORDER BY n_nationkey))",
    "sorted_hash": "md5(string_agg(n_name, ',' ORDER BY n_name))",
}.items():
    query(f"SELECT n_regionkey::BIGINT AS region, {_sql} AS reduced FROM nation GROUP BY n_regionkey", f"reduce_{_mode}")(
        lambda s, d, m=_mode: meta.reduce_data(T(s, d, "nation").withColumn("region", F.col("n_regionkey").cast("long")), "n_name", m, "region", "n_nationkey")
    )


@query("SELECT o_custkey, round(sum(o_totalprice), 4) AS reduced FROM orders GROUP BY o_custkey")
def reduce_sum(s, d):
    return meta.reduce_data(T(s, d, "orders"), "o_totalprice", "sum", "o_custkey", "o_orderkey").withColumn("reduced", F.round("reduced", 4))


@query("SELECT l_returnflag AS dataset_id, round(avg(l_quantity), 6) AS reduced FROM lineitem GROUP BY l_returnflag")
def reduce_data(s, d):
    x = T(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), "l_quantity", F.lit(0).alias("idx"))
    return meta.reduce_data(x, "l_quantity", "average").withColumn("reduced", F.round("reduced", 6))


_KEYS = {
    "floor": ("p_retailprice", 100.0, "trunc(v / 100)::BIGINT + CASE WHEN v < 0 THEN -1 ELSE 1 END"), "ceil": ("p_retailprice", 100.0, "ceil(v / 100)::BIGINT"),
    "round": ("p_retailprice", 100.0, "floor(v / 100 + 0.5)::BIGINT"), "modulo": ("p_size", 7.0, "trunc(v)::BIGINT % 7"),
}
for _mode, (_c, _s, _sql) in _KEYS.items():
    query(
        f"WITH k AS (SELECT p_partkey, {_sql} AS key_0 FROM (SELECT p_partkey, {_c}::DOUBLE AS v FROM part)) SELECT p_partkey, key_0, key_0 AS key_sum, dense_rank() OVER (ORDER BY key_0) - 1 AS partition_index FROM k",
        f"partition_{_mode}",
    )(lambda s, d, m=_mode, c=_c, z=_s: meta.partition_by_values(T(s, d, "part").select("p_partkey", c), [meta.PartitionRule(c, z, mode=m)]).select("p_partkey", "key_0", "key_sum", "partition_index"))


@query("""WITH k AS (SELECT p_partkey, least(greatest(trunc((p_retailprice - 1500) / 100)::BIGINT + sign(p_retailprice - 1500)::BIGINT, -3), 3) AS key_0, p_size::BIGINT % 5 AS key_1 FROM part)
SELECT p_partkey, key_0, key_1, key_0 + key_1 AS key_sum, dense_rank() OVER (ORDER BY key_0, key_1) - 1 AS partition_index FROM k""")
def partition_two_rules(s, d):
    rules = [meta.PartitionRule("p_retailprice", 100.0, offset=-1500.0, low=-3, high=3), meta.PartitionRule("p_size", 5.0, mode="modulo")]
    return meta.partition_by_values(T(s, d, "part").select("p_partkey", "p_retailprice", "p_size"), rules).drop("p_retailprice", "p_size")


def _remap_sql(lo, hi, v="c_acctbal", clamp=False):
    t = f"(CASE WHEN {hi} = {lo} THEN 0 ELSE ({v} - {lo}) / ({hi} - {lo}) END)"
    t = f"least(greatest({t}, 0), 1)" if clamp else t
    return f"SELECT c_custkey, round({t} * 10, 6) AS remapped FROM (SELECT *, min({v}) OVER w AS lo, max({v}) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment))"


for _name, _kw, _sql in (
    ("remap_effective", {}, _remap_sql("lo", "hi")), ("remap_full", {"full_range": True}, _remap_sql("least(lo, 0)", "hi")),
    ("remap_fixed", {"in_min": 0.0, "in_max": 5000.0, "clamp": True}, _remap_sql("0", "5000", clamp=True)), ("remap_absolute", {"preserve_sign": False}, _remap_sql("lo", "hi", "abs(c_acctbal)")),
):
    query(_sql, _name)(lambda s, d, k=_kw: meta.attribute_remap(T(s, d, "customer"), "c_acctbal", 0.0, 10.0, "c_mktsegment", **k).select("c_custkey", *r6("remapped")))


@query("SELECT o_custkey, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS hash FROM orders GROUP BY o_custkey")
def attribute_hash(s, d):
    return meta.attribute_hash(T(s, d, "orders"), "o_orderpriority", by="o_custkey", order="o_orderkey")


@query("SELECT o_custkey, md5(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS hash FROM orders GROUP BY o_custkey")
def attribute_hash_uniques(s, d):
    return meta.attribute_hash(T(s, d, "orders"), "o_orderpriority", "uniques", by="o_custkey", order="o_orderkey")


@query("SELECT o_custkey, md5(arg_min(o_orderpriority, o_orderkey) || ',' || arg_max(o_orderpriority, o_orderkey)) AS hash FROM orders GROUP BY o_custkey")
def attribute_hash_ends(s, d):
    return meta.attribute_hash(T(s, d, "orders"), "o_orderpriority", "first_last", by="o_custkey", order="o_orderkey")


@query(f"WITH {PTS} SELECT id, row_number() OVER (PARTITION BY dataset_id ORDER BY x DESC, y, idx) - 1 AS sorted_idx FROM pts")
def sort_points(s, d):
    return meta.sort_points(tables.embedding_points(s, d), [meta.SortRule("x", True), meta.SortRule("y")]).select("id", "sorted_idx")


@query(f"WITH {PTS} SELECT id, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(x / 0.1 + 0.5), floor(y / 0.1 + 0.5) DESC, idx) - 1 AS sorted_idx FROM pts")
def sort_points_tolerance(s, d):
    return meta.sort_points(tables.embedding_points(s, d), [meta.SortRule("x", tolerance=0.1), meta.SortRule("y", True, 0.1)]).select("id", "sorted_idx")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS dataset_index FROM nation")
def sort_data(s, d):
    return meta.sort_data(T(s, d, "nation"), [meta.SortRule("n_regionkey", True)], "n_nationkey").select("n_nationkey", "dataset_index")


@query(f"WITH {PTS}, c AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS entries FROM pts) SELECT id, idx AS index, entries, round(CASE WHEN entries > 1 THEN idx / (entries - 1) ELSE 0 END, 6) AS normalized FROM c")
def write_index(s, d):
    return meta.write_index(tables.embedding_points(s, d)).select("id", "index", "entries", *r6("normalized"))


@query("SELECT c_mktsegment, arg_min(c_name, c_custkey) AS c_name, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY c_mktsegment")
def hoist_attributes(s, d):
    return meta.hoist(T(s, d, "customer"), ["c_name", "c_acctbal"], "first", "c_mktsegment", "c_custkey")


@query("SELECT p_partkey, p_type FROM part")
def meta_cleanup(s, d):
    return meta.cleanup(T(s, d, "part"), drop=["p_size", "p_retailprice", "p_brand"], starts="p_n")


@query("""WITH m AS (SELECT 0 AS t, s_nationkey::VARCHAR AS source_id, s_suppkey AS k, s_acctbal AS bal FROM supplier UNION ALL SELECT 1, c_nationkey::VARCHAR, c_custkey, c_acctbal FROM customer)
SELECT 'merged' AS dataset_id, source_id, bal, row_number() OVER (ORDER BY t, source_id, k) - 1 AS idx FROM m""")
def merge_points(s, d):
    a = T(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("dataset_id"), F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("bal"))
    b = T(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("dataset_id"), F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("bal"))
    return meta.merge([a, b]).select("dataset_id", "source_id", "bal", "idx")


@query("""WITH t AS (SELECT user_id::VARCHAR AS dataset_id, list(DISTINCT event_type) AS tags FROM events GROUP BY user_id)
SELECT event_id, CASE WHEN list_contains(tags, 'purchase') THEN 'purchase' WHEN list_contains(tags, 'click') THEN 'click' ELSE dataset_id END AS merged_id FROM events JOIN t ON t.dataset_id = user_id::VARCHAR""")
def merge_points_by_tag(s, d):
    e = T(s, d, "events").select(F.col("user_id").cast("string").alias("dataset_id"), "event_id")
    return meta.merge_by_tag(e, tables.event_tags(s, d), ["purchase", "click"]).select("event_id", "merged_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 8 AND 12)")
def discard_by_point_count(s, d):
    return meta.discard_by_count(T(s, d, "orders"), 8, 12, "o_custkey").select("o_orderkey")


@query("""WITH p AS (SELECT user_id, md5(string_agg(v, ',' ORDER BY v)) AS h, count(*) AS n FROM (SELECT user_id, floor(value / 50.0)::BIGINT::VARCHAR AS v FROM events) GROUP BY user_id),
k AS (SELECT min(user_id) AS user_id FROM p GROUP BY h, n) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM k)""")
def discard_same(s, d):
    return meta.discard_same(T(s, d, "events"), ["value"], 50.0, "first", "user_id", "event_id").select("event_id")


_FLAGS = "(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END | CASE WHEN o_totalprice > 100000 THEN 2 ELSE 0 END | CASE WHEN o_orderpriority LIKE '1%' THEN 4 ELSE 0 END)"


def _flags():
    return C.flags([F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_orderpriority").startswith("1")])


@query(f"SELECT o_orderkey, {_FLAGS}::BIGINT AS states FROM orders")
def write_states(s, d):
    st = [(F.col("o_orderstatus") == "F", 1, 0), (F.col("o_totalprice") > 100000, 2, 0), (F.col("o_orderpriority").startswith("1"), 4, 0)]
    return meta.write_states(T(s, d, "orders"), st).select("o_orderkey", "states")


for _op, _sql in {"set": "6", "and": "{f} & 6", "or": "{f} | 6", "not": "{f} & ~6", "xor": "xor({f}, 6)"}.items():
    query(f"SELECT o_orderkey, ({_sql.format(f=_FLAGS)})::BIGINT AS flags FROM orders", f"bitmask_{_op}")(
        lambda s, d, o=_op: meta.bitmask_operation(T(s, d, "orders").withColumn("flags", _flags()), "flags", o, 6).select("o_orderkey", "flags")
    )


@query(f"SELECT o_custkey, bit_or({_FLAGS})::BIGINT AS flags FROM orders GROUP BY o_custkey")
def bitmask_merge(s, d):
    return meta.bitmask_merge(T(s, d, "orders").withColumn("flags", _flags()), "flags", "or", "o_custkey")


@query("SELECT p_partkey, upper(concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])) AS guid FROM (SELECT p_partkey, md5('g|' || p_partkey || '|' || p_brand) AS h FROM part)")
def write_guid(s, d):
    return meta.write_guid(T(s, d, "part"), "g", "p_partkey", "p_brand").select("p_partkey", "guid")


def _frac(seed, *keys):
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"SELECT p_partkey, floor({_frac(5, 'p_partkey')} * 2147483648)::BIGINT AS seed FROM part")
def refresh_seed(s, d):
    return meta.refresh_seed(T(s, d, "part"), 5, "p_partkey").select("p_partkey", "seed")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'large' ELSE 'small' END AS size, CASE WHEN o_totalprice > 150000 THEN 1 END AS bonus FROM orders")
def action_write_attributes(s, d):
    return meta.write_attributes(T(s, d, "orders"), F.col("o_totalprice") > 150000, {"size": "large", "bonus": 1}, {"size": "small"}).select("o_orderkey", "size", "bonus")


@query(f"WITH e AS (SELECT r_regionkey, sum(r_regionkey + 1) OVER (ORDER BY r_regionkey) AS u FROM region), k AS (SELECT p_partkey, {_frac(3, 'p_partkey')} * 15 AS d FROM part) SELECT p_partkey, min(r_regionkey)::BIGINT AS entry_id FROM k JOIN e ON u > d GROUP BY p_partkey")
def staging_distribute(s, d):
    e = T(s, d, "region").select(F.col("r_regionkey").cast("long").alias("entry_id"), (F.col("r_regionkey") + 1).alias("weight"))
    return meta.weighted_pick(T(s, d, "part"), e, 3, "p_partkey").select("p_partkey", "entry_id")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def staging_load_properties(s, d):
    props = T(s, d, "nation").select(F.col("n_nationkey").alias("entry_id"), "n_name")
    return meta.load_properties(T(s, d, "customer").withColumn("entry_id", F.col("c_nationkey")), props).select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def staging_type_filter(s, d):
    kinds = T(s, d, "nation").select(F.col("n_nationkey").alias("entry_id"), F.col("n_regionkey").cast("string").alias("kind"))
    return meta.type_filter(T(s, d, "customer").withColumn("entry_id", F.col("c_nationkey")), kinds, ["1", "3"]).select("c_custkey")


# --- Blends ----------------------------------------------------------------------------------------------------------

_BLENDS = {
    "average": "(a + b) / 2", "weight": "a + b * 0.25", "multiply": "a * b", "divide": "CASE WHEN b = 0 THEN a ELSE a / b END", "min": "least(a, b)", "max": "greatest(a, b)", "copy_target": "a", "copy_source": "b",
    "add": "a + b", "subtract": "a - b", "weighted_subtract": "a - b * 0.25", "lerp": "a + (b - a) * 0.25", "unsigned_min": "CASE WHEN abs(b) < abs(a) THEN b ELSE a END", "unsigned_max": "CASE WHEN abs(b) > abs(a) THEN b ELSE a END",
    "absolute_min": "least(abs(a), abs(b))", "absolute_max": "greatest(abs(a), abs(b))", "modulo": "CASE WHEN b = 0 THEN a ELSE a % b END",
}
for _mode, _sql in _BLENDS.items():
    query(f"SELECT c_custkey, round({_sql}, 6) + 0.0 AS blended FROM (SELECT c_custkey, c_acctbal AS a, (c_custkey % 7 - 3)::DOUBLE AS b FROM customer)", f"blend_{_mode}")(
        lambda s, d, m=_mode: T(s, d, "customer").select("c_custkey", (F.round(B.blend("c_acctbal", (F.col("c_custkey") % 7 - 3).cast("double"), m, F.lit(0.25)), 6) + 0.0).alias("blended"))
    )
_FOLDS = {
    "average": "avg(v)", "weight": "sum(v * w) / greatest(sum(w), 1)", "add": "sum(v)", "weighted_add": "sum(v * w)", "min": "min(v)", "max": "max(v)", "absolute_min": "min(abs(v))", "absolute_max": "max(abs(v))",
    "unsigned_max": "arg_max(v, abs(v))", "copy_target": "arg_min(v, k)", "copy_source": "arg_max(v, k)",
}
for _mode, _sql in _FOLDS.items():
    query(f"SELECT n, round({_sql}, 4) AS folded FROM (SELECT c_nationkey::BIGINT AS n, c_acctbal AS v, c_custkey % 3 / 2 AS w, c_custkey AS k FROM customer) GROUP BY n", f"fold_{_mode}")(
        lambda s, d, m=_mode: T(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("n")).agg(F.round(B.aggregate("c_acctbal", m, F.col("c_custkey") % 3 / 2, "c_custkey"), 4).alias("folded"))
    )


@query("SELECT c_custkey, round((c_acctbal + 100) * 0.5, 6) AS c_acctbal FROM customer")
def uber_blend(s, d):
    x = T(s, d, "customer").withColumn("k", F.lit(100.0)).withColumn("h", F.lit(0.5))
    return B.uber_blend(x, [B.Blend("c_acctbal", "k", "add"), B.Blend("c_acctbal", "h", "multiply")]).select("c_custkey", *r6("c_acctbal"))


# --- Filters ---------------------------------------------------------------------------------------------------------

for _name, _op, _sql in (
    ("eq", "==", "="), ("ne", "!=", "<>"), ("ge", ">=", ">="), ("le", "<=", "<="), ("gt", ">", ">"), ("lt", "<", "<"), ("near", "~=", None), ("not_near", "!~=", None),
):
    _where = f"l_quantity {_sql} 25" if _sql else f"abs(l_quantity - 25) {'<=' if _op == '~=' else '>'} 2"
    query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE {_where}", f"filter_numeric_{_name}")(
        lambda s, d, o=_op: T(s, d, "lineitem").where(C.numeric("l_quantity", o, 25, 2)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    )
_TEXT = {
    "eq": ("==", "p_type = v"), "ne": ("!=", "p_type <> v"), "len_eq": ("len==", "length(p_type) = length(v)"), "len_ne": ("len!=", "length(p_type) <> length(v)"), "len_ge": ("len>=", "length(p_type) >= length(v)"),
    "len_le": ("len<=", "length(p_type) <= length(v)"), "len_gt": ("len>", "length(p_type) > length(v)"), "len_lt": ("len<", "length(p_type) < length(v)"), "locale_gt": ("locale>", "p_type > v"),
    "locale_lt": ("locale<", "p_type < v"), "contains": ("contains", "contains(p_type, v)"), "starts": ("startswith", "starts_with(p_type, v)"), "ends": ("endswith", "ends_with(p_type, v)"),
}
for _name, (_op, _sql) in _TEXT.items():
    query(f"SELECT p_partkey FROM (SELECT *, (SELECT min(p_type) FROM part) AS v FROM part) WHERE {_sql}", f"filter_string_{_name}")(
        lambda s, d, o=_op: (lambda p: p.crossJoin(F.broadcast(p.agg(F.min("p_type").alias("v")))).where(C.string("p_type", o, F.col("v"))).select("p_partkey"))(T(s, d, "part"))
    )
for _mode, _sql in {"any": "f & 3 <> 0", "all": "f & 3 = 3", "strict": "f = 3", "none_any": "f & 3 = 0", "none_all": "f & 3 <> 3"}.items():
    _sql = _sql.replace("f & 3", "(f & 3)")
    query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_FLAGS} AS f FROM orders) WHERE {_sql}", f"filter_bitmask_{_mode}")(
        lambda s, d, m=_mode: T(s, d, "orders").where(C.bits(_flags(), m, F.lit(3))).select("o_orderkey")
    )


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000) = (o_orderstatus = 'F')")
def filter_bool_compare(s, d):
    return T(s, d, "orders").where((F.col("o_totalprice") > 100000) == (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 OR l_quantity BETWEEN 40 AND 42")
def filter_within_range(s, d):
    return T(s, d, "lineitem").where(filters.within_range("l_quantity", [(5, 10), (40, 42)])).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size = 0 OR p_partkey % 9 = 0 THEN true ELSE p_size % (p_partkey % 9) = 1 END")
def filter_modulo(s, d):
    return T(s, d, "part").where(filters.modulo("p_size", F.col("p_partkey") % 9, "==", 1, True)).select("p_partkey")


for _m, _ref in {"average": "avg(v)", "median": "median(v)", "central": "(min(v) + max(v)) / 2", "fixed": "25.0"}.items():
    query(
        f"WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, l_quantity AS v FROM lineitem), r AS (SELECT g, {_ref} AS ref FROM x GROUP BY g) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM x JOIN r USING (g) WHERE v >= ref - 4 AND v < ref + 6",
        f"filter_mean_{_m}",
    )(lambda s, d, m=_m: filters.mean_band(T(s, d, "lineitem"), "l_quantity", 4, 6, m, "l_returnflag", 25.0).where("passes").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")))
for _m, _sign in {"mode_min": "", "mode_max": "-"}.items():
    query(
        f"""WITH x AS (SELECT p_partkey, p_brand AS g, p_size AS v FROM part), h AS (SELECT g, v, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT g, arg_min(v, (-n, {_sign}v)) AS ref FROM h GROUP BY g)
        SELECT p_partkey FROM x JOIN r USING (g) WHERE v >= ref - 2 AND v < ref + 2""",
        f"filter_mean_{_m}",
    )(lambda s, d, m=_m: filters.mean_band(T(s, d, "part"), "p_size", 2, 2, m, "p_brand").where("passes").select("p_partkey"))


@query(f"WITH {EVT}, n AS (SELECT *, lead(y) OVER (PARTITION BY path_id ORDER BY idx) AS o FROM evt) SELECT event_id FROM n WHERE coalesce(y > o, false)")
def filter_self_compare(s, d):
    return filters.self_compare(tables.event_paths(s, d), "y", ">", 1, "path_id").where("passes").select("event_id")


@query(f"WITH {EVT}, n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM evt) SELECT a.event_id FROM n a LEFT JOIN n b ON a.path_id = b.path_id AND b.idx = (a.idx * 3) % a.n WHERE coalesce(a.y >= b.y, false)")
def filter_self_compare_index(s, d):
    return filters.self_compare_index(tables.event_paths(s, d), "y", ">=", F.col("idx") * 3, "path_id", safety="tile").where("passes").select("event_id")


@query(f"SELECT o_orderkey FROM orders WHERE {_frac(11, 'o_orderkey')} < 0.3")
def filter_random(s, d):
    return T(s, d, "orders").where(filters.random_filter(0.3, 11, "o_orderkey")).select("o_orderkey")


@query(f"WITH k AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_frac(4, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey FROM k WHERE r <= floor(n * 0.25 + 0.5)")
def filter_random_ratio(s, d):
    return filters.random_ratio(T(s, d, "orders"), 0.25, 4, "o_orderkey", "o_orderstatus").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def contains_hash(s, d):
    return filters.contains(T(s, d, "customer").select("c_custkey"), "c_custkey", T(s, d, "orders").where("o_totalprice > 200000"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def contains_hash_invert(s, d):
    return filters.contains(T(s, d, "customer").select("c_custkey"), "c_custkey", T(s, d, "orders"), "o_custkey", True)


@query(f"WITH {PTS}, n AS (SELECT a.id, a.x, arg_min(b.y, ({D2()}, b.id)) AS v FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id, a.x) SELECT id FROM n WHERE x > v")
def compare_nearest(s, d):
    p = tables.embedding_points(s, d)
    return filters.compare_nearest(p, p.select("id", "x", "y", "z"), "x", ">", "y", skip_self=True).where("passes").select("id")


@query(f"WITH {EVT}, n AS (SELECT event_id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM evt WINDOW w AS (PARTITION BY path_id ORDER BY idx)) SELECT event_id FROM n WHERE coalesce(d > 3600, false)")
def filter_segment_length(s, d):
    return filters.segment_length(tables.event_paths(s, d), ">", 3600.0).where("passes").select("event_id")


@query(f"""WITH {EVT}, n AS (SELECT event_id, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM evt WINDOW w AS (PARTITION BY path_id ORDER BY idx))
SELECT event_id FROM n WHERE coalesce((ax * bx + ay * b_y) / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y), 0) < 0.9, false)""")
def filter_angle(s, d):
    return filters.angle(tables.event_paths(s, d), "<", 0.9).where("passes").select("event_id")


@query(f"WITH {PTS} SELECT id FROM pts WHERE coalesce((z / nullif(sqrt(x * x + y * y + z * z), 0) + 1) / 2 > 0.6, false)")
def filter_dot(s, d):
    return tables.embedding_points(s, d).where(filters.dot_filter(None, ("x", "y", "z"), (0.0, 0.0, 1.0), ">", 0.6)).select("id")


_TAGS = """tags AS (SELECT user_id::VARCHAR AS dataset_id, list_sort(list(event_type)) AS tags, map_from_entries(list((event_type, n))) AS m
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)"""


@query(f"WITH {_TAGS} SELECT dataset_id FROM tags WHERE list_contains(tags, 'purchase')")
def data_filter_tag_check(s, d):
    return tables.event_tags(s, d).where(filters.tag_check("purchase")).select("dataset_id")


@query(f"WITH {_TAGS} SELECT dataset_id FROM tags WHERE len(list_filter(tags, lambda t: t = 'click' OR starts_with(t, 'click.'))) > 0")
def filter_gameplay_tags(s, d):
    return tables.event_tags(s, d).where(filters.hierarchical_tag("click")).select("dataset_id")


@query("SELECT user_id::VARCHAR AS dataset_id FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) > 12")
def data_filter_tag_value(s, d):
    return tables.event_tags(s, d).where(filters.tag_value("click", ">", 12)).select("dataset_id")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def data_filter_entry_count(s, d):
    return filters.entry_count(T(s, d, "events"), ">=", 70, "user_id").select("event_id")


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(p_retailprice) - min(p_retailprice) > 900)")
def data_filter_bounds(s, d):
    return filters.data_bounds(T(s, d, "part"), "p_retailprice", ">", 900, "p_brand").select("p_partkey")


@query(f"WITH {PTS}, c AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n FROM pts) SELECT id FROM c WHERE idx = 0 OR idx = n - 1 OR idx = floor(0.5 * n) OR idx BETWEEN 3 AND 5")
def cherry_pick(s, d):
    return filters.picker(tables.embedding_points(s, d), [0, -1, 0.5, (3, 5)]).select("id")


@query(f"WITH {PTS} SELECT id FROM pts WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -1 AND 0.5 AND z BETWEEN -1 AND 1")
def filter_inclusion_bounds(s, d):
    return tables.embedding_points(s, d).where(filters.inside_box((-0.5, -1, -1), (0.5, 0.5, 1))).select("id")


@query("SELECT o_orderkey, o_totalprice > 150000 AND o_orderstatus <> 'P' AS inside FROM orders")
def uber_filter(s, d):
    inside, outside = filters.uber_filter(T(s, d, "orders"), C.all_of(F.col("o_totalprice") > 150000, F.col("o_orderstatus") != "P"))
    return inside.select("o_orderkey", F.lit(True).alias("inside")).union(outside.select("o_orderkey", F.lit(False)))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 0 WHEN o_totalprice > 100000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END::BIGINT AS bucket FROM orders")
def uber_filter_cascade(s, d):
    return T(s, d, "orders").select("o_orderkey", filters.cascade([F.col("o_totalprice") > 200000, F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"]).alias("bucket"))


@query("SELECT o_orderkey FROM orders WHERE NOT ((o_totalprice > 100000 OR o_orderstatus = 'P') AND o_orderpriority <> '5-LOW')")
def filter_group(s, d):
    inner = C.group("or", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "P")
    return T(s, d, "orders").where(C.group("and", inner, F.col("o_orderpriority") != "5-LOW", invert=True)).select("o_orderkey")


for _m, _agg in {"all": "bool_and(o_totalprice > 20000)", "any": "bool_or(o_totalprice > 250000)", "partial": "avg((o_totalprice > 150000)::INT) >= 0.5"}.items():
    query(f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING {_agg})", f"uber_filter_data_{_m}")(
        lambda s, d, m=_m: filters.uber_filter_data(T(s, d, "orders"), F.col("o_totalprice") > {"all": 20000, "any": 250000, "partial": 150000}[m], m, 0.5, "o_custkey").select("o_orderkey")
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'rest' END AS branch FROM orders")
def branch_on_data(s, d):
    parts = filters.branch(T(s, d, "orders"), "o_orderstatus", ["F", "O"])
    tagged = [p.select("o_orderkey", F.lit(k or "rest").alias("branch")) for k, p in parts.items()]
    return tagged[0].union(tagged[1]).union(tagged[2])


# --- Matching --------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS candidate, r_name AS target FROM nation JOIN region ON n_regionkey >= r_regionkey")
def match_attributes(s, d):
    return matching.match(T(s, d, "nation"), T(s, d, "region"), [matching.by_attributes("n_regionkey", ">=", "r_regionkey")], key="n_name", target_key="r_name")


@query("SELECT n_name AS candidate, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def match_attributes_equal(s, d):
    return matching.match(T(s, d, "nation"), T(s, d, "region"), [matching.by_attributes("n_regionkey", "==", "r_regionkey")], key="n_name", target_key="r_name")


@query("SELECT n_name AS candidate, r_name AS target FROM nation JOIN region ON n_nationkey % 5 = r_regionkey")
def match_by_index(s, d):
    return matching.match(T(s, d, "nation"), T(s, d, "region"), [matching.by_index("n_nationkey", 5, "tile", target="r_regionkey")], key="n_name", target_key="r_name")


@query("SELECT candidate, target FROM (SELECT n_name AS candidate, r_name AS target, row_number() OVER (PARTITION BY n_name ORDER BY r_name) AS r FROM nation JOIN region ON n_regionkey >= r_regionkey) WHERE r <= 2")
def match_limit(s, d):
    return matching.match(T(s, d, "nation"), T(s, d, "region"), [matching.by_attributes("n_regionkey", ">=", "r_regionkey")], limit=2, key="n_name", target_key="r_name")




@query(f"WITH {_TAGS} SELECT dataset_id AS candidate, p_partkey AS target FROM tags JOIN part ON m['click'] > p_size + 20")
def match_tag_attribute(s, d):
    part = T(s, d, "part").withColumn("need", F.col("p_size") + 20)
    return matching.match_values(tables.event_tags(s, d), part, F.try_element_at("tag_values", F.lit("click")), ">", "need", target_key="p_partkey")


@query(f"SELECT n_name AS candidate, r_name AS target FROM nation, region WHERE {_frac(9, 'n_name', 'r_name')} < 0.4")
def match_random(s, d):
    return matching.match(T(s, d, "nation"), T(s, d, "region"), [matching.randomly(0.4, 9, "n_name", "r_name")], key="n_name", target_key="r_name")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)")
def data_match(s, d):
    rule = (F.col("c.c_custkey") == F.col("t.o_custkey")) & (F.col("t.o_totalprice") > F.col("c.c_acctbal") * 20)
    return matching.data_match(T(s, d, "customer"), T(s, d, "orders"), rule).select("c_custkey")


#: Over all rows: the segments of each nation's customers by steps of 500 in balance; the boxes of each brand, type
#: and step of 5 in size.
_STAG = "st AS (SELECT c_nationkey::BIGINT * 100 + floor(c_acctbal / 500)::BIGINT + 2 AS k, list_sort(list(DISTINCT c_mktsegment)) AS tags FROM customer GROUP BY 1)"
_TBOX = "tb AS (SELECT p_brand || ' ' || p_type || ' ' || p_size // 5 AS k, min(p_size) AS a, max(p_size) AS z, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part GROUP BY 1)"


def _step_tags(s, d):
    k = (F.col("c_nationkey").cast("long") * 100 + F.floor(F.col("c_acctbal") / 500) + 2).alias("dataset_id")
    return T(s, d, "customer").groupBy(k).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("tags"))


for _m, _cond in {"any": "list_has_any(a.tags, b.tags)", "all": "list_has_all(b.tags, a.tags)"}.items():
    query(f"WITH {_STAG} SELECT a.k AS candidate, b.k AS target FROM st a, st b WHERE {_cond}", f"match_shared_tag_{_m}")(
        lambda s, d, m=_m: matching.match(_step_tags(s, d), _step_tags(s, d), [matching.shared_tags(m)])
    )


@query(f"WITH {_STAG}, p AS (SELECT a.k, a.tags, flatten(list(b.tags)) AS more FROM st a JOIN st b ON a.k // 2 = b.k // 2 GROUP BY a.k, a.tags) SELECT k, array_to_string(list_sort(list_distinct(tags || more)), ',') AS tags FROM p")
def match_copy_tags(s, d):
    t = _step_tags(s, d)
    pairs = matching.match(t, t, [F.floor(F.col("c.dataset_id") / 2) == F.floor(F.col("t.dataset_id") / 2)])
    return matching.copy_tags(t, pairs, t).select(F.col("dataset_id").alias("k"), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TBOX} SELECT x.k AS candidate, y.k AS target FROM tb x JOIN tb y ON greatest(x.a, y.a) <= least(x.z, y.z) AND greatest(x.c, y.c) <= least(x.e, y.e)")
def match_overlap(s, d):
    b = T(s, d, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type", F.floor(F.col("p_size") / 5).cast("string")).alias("dataset_id"))
    b = b.agg(F.min("p_size").alias("min_x"), F.max("p_size").alias("max_x"), F.min("p_retailprice").alias("min_y"), F.max("p_retailprice").alias("max_y"))
    return matching.match(b, b, [matching.overlap()])


# --- Space -----------------------------------------------------------------------------------------------------------


@query(f"WITH {PTS} SELECT dataset_id, count(*) AS points, " + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}, round((min({a}) + max({a})) / 2, 6) AS center_{a}, round((max({a}) - min({a})) / 2, 6) AS extent_{a}" for a in "xyz") + " FROM pts GROUP BY dataset_id")
def points_to_bounds(s, d):
    x = spatial.bounds(tables.embedding_points(s, d))
    return x.select(*[F.round(c, 6).alias(c) if c[:6] in ("center", "extent") else F.col(c) for c in x.columns])


@query(f"WITH {PTS}, e AS (SELECT *, " + ", ".join(f"min({a}) OVER w AS l{a}, max({a}) OVER w AS h{a}" for a in "xyz") + " FROM pts WINDOW w AS (PARTITION BY dataset_id)) SELECT id, " + ", ".join(f"round(coalesce(({a} - l{a}) / nullif(h{a} - l{a}, 0), 0), 6) AS {u}" for a, u in zip("xyz", "uvw")) + " FROM e")
def normalize(s, d):
    return spatial.normalize(tables.embedding_points(s, d)).select("id", *r6("u", "v", "w"))


@query(f"WITH {PTS} SELECT dataset_id, " + ", ".join(f"floor({a} / 0.5 + 0.5)::BIGINT AS key_{a}" for a in "xyz") + ", count(*) AS fused, " + ", ".join(f"round(avg({a}), 6) AS {a}" for a in "xyz") + " FROM pts GROUP BY ALL")
def fuse_voxel(s, d):
    return spatial.fuse_voxel(tables.embedding_points(s, d), 0.5).select("dataset_id", "key_x", "key_y", "key_z", "fused", *r6("x", "y", "z"))


@query(f"WITH {PTS} SELECT a.id, count(b.id) AS collocations FROM pts a LEFT JOIN pts b ON a.id <> b.id AND {D2()} <= 0.0625 GROUP BY a.id")
def collocation_count(s, d):
    return spatial.collocation(tables.embedding_points(s, d), 0.25).select("id", "collocations")


#: Every point samples among all points moved a little, so that none is its own nearest target by identity.
_TG = f"{PTS}, tg AS (SELECT id, x + 0.05 AS x, y, z FROM pts)"


def _targets(s, d):
    p = tables.embedding_points(s, d)
    return p, p.withColumn("x", F.col("x") + 0.05).withColumn("v", F.col("id").cast("double"))


@query(f"""WITH {_TG}, n AS (SELECT a.id, sqrt({D2()}) AS dist, 1 - ({D2()}) / 0.25 AS w, b.id::DOUBLE AS v FROM pts a JOIN tg b ON {D2()} <= 0.25)
SELECT p.id, count(n.id) > 0 AS success, count(n.id) AS num_samples, round(coalesce(avg(dist), 0.5), 6) AS distance, round(CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE avg(v) END, 6) AS value
FROM pts p LEFT JOIN n ON n.id = p.id GROUP BY p.id""")
def sample_nearest_point(s, d):
    a, b = _targets(s, d)
    return spatial.sample_within(a, b, "v", 0.5).select("id", "success", "num_samples", *r6("distance", "value"))


@query(f"WITH {_TG} SELECT a.id, arg_min(b.id, ({D2()}, b.id)) AS sampled_id, round(sqrt(min({D2()})), 6) AS distance, true AS success FROM pts a JOIN tg b ON true GROUP BY a.id")
def sample_closest(s, d):
    a, b = _targets(s, d)
    return spatial.sample_nearest(a, b).select("id", "sampled_id", "success", *r6("distance"))


@query(f"WITH {_TG} SELECT a.id, arg_max(b.id, ({D2()}, -b.id)) AS sampled_id, round(sqrt(max({D2()})), 6) AS distance FROM pts a JOIN tg b ON {D2()} <= 0.25 GROUP BY a.id")
def sample_farthest(s, d):
    a, b = _targets(s, d)
    return spatial.sample_farthest(a, b, 0.5).select("id", "sampled_id", *r6("distance"))


@query(f"WITH {_TG} SELECT a.id, arg_min(b.id, (b.y, b.id)) AS sampled_id FROM pts a JOIN tg b ON {D2()} <= 0.25 GROUP BY a.id")
def sample_best(s, d):
    a, b = _targets(s, d)
    return spatial.sample_best(a, b, 0.5, F.col("r_y"))


_BOX = f"{PTS}, box AS (SELECT dataset_id, id, x - 0.1 AS lx, x + 0.1 AS hx, y - 0.1 AS ly, y + 0.1 AS hy, z - 0.1 AS lz, z + 0.1 AS hz FROM pts)"


def _boxes(s, d):
    return tables.embedding_points(s, d).select("dataset_id", "id", *[(F.col(a) + k).alias(f"{n}{a}") for a in "xyz" for n, k in (("l", -0.1), ("h", 0.1))])


@query(f"""WITH {_BOX}, n AS (SELECT a.id, count(b.id) AS overlap_count FROM box a LEFT JOIN box b ON a.dataset_id <> b.dataset_id AND a.lx <= b.hx AND a.hx >= b.lx AND a.ly <= b.hy AND a.hy >= b.ly AND a.lz <= b.hz AND a.hz >= b.lz GROUP BY a.id)
SELECT id, overlap_count, round(coalesce(overlap_count / nullif((SELECT max(overlap_count) FROM n), 0), 0), 6) AS relative_overlap_count FROM n""")
def sample_overlap_stats(s, d):
    return spatial.overlap_stats(_boxes(s, d)).select("id", "overlap_count", *r6("relative_overlap_count"))


@query(f"""WITH {_BOX} SELECT id, CASE WHEN lx >= -0.5 AND hx <= 0.5 AND ly >= -0.5 AND hy <= 0.5 AND lz >= -0.5 AND hz <= 0.5 THEN 'inside'
WHEN hx < -0.5 OR lx > 0.5 OR hy < -0.5 OR ly > 0.5 OR hz < -0.5 OR lz > 0.5 THEN 'outside' ELSE 'touching' END AS place FROM box""")
def spatial_triage(s, d):
    return _boxes(s, d).select("id", spatial.triage(None, (-0.5,) * 3, (0.5,) * 3).alias("place"))


@query(f"WITH {PTS} SELECT id, " + ", ".join(f"round({a} - 1 + {_frac(20 + i, 'id')} * 2, 6) AS {a}" for i, a in enumerate("xyz")) + " FROM pts")
def transform_points(s, d):
    return spatial.transform(tables.embedding_points(s, d), 20, "id", (-1,) * 3, (1,) * 3).select("id", *r6("x", "y", "z"))


@query(f"WITH {_BOX} SELECT id, " + ", ".join(f"round(l{a} + (h{a} - l{a}) * 0.25, 6) AS {a}" for a in "xyz") + " FROM box")
def move_pivot(s, d):
    return spatial.move_pivot(_boxes(s, d), (0.25,) * 3).select("id", *r6("x", "y", "z"))


@query(f"WITH {PTS}, e AS (SELECT dataset_id, max(x) AS ex, min(y) AS ey, (min(z) + max(z)) / 2 AS ez FROM pts GROUP BY dataset_id), q AS (SELECT dataset_id, id, pow(x - ex, 2) + pow(y - ey, 2) + pow(z - ez, 2) AS d FROM pts JOIN e USING (dataset_id)) SELECT dataset_id, arg_min(id, (d, id)) AS picked, round(sqrt(min(d)), 6) AS distance FROM q GROUP BY dataset_id")
def point_on_bounds(s, d):
    return spatial.point_on_bounds(tables.embedding_points(s, d), (1.0, 0.0, 0.5)).select("dataset_id", "picked", *r6("distance"))


@query(f"WITH {_BOX} SELECT id, 0::BIGINT AS e, round(lx, 6) AS x, round((ly + hy) / 2, 6) AS y FROM box UNION ALL SELECT id, 1, round(hx, 6), round((ly + hy) / 2, 6) FROM box")
def bounds_axis_to_points(s, d):
    return spatial.bounds_axis(_boxes(s, d)).select("id", F.col("end").cast("long").alias("e"), *r6("x", "y"))


@query(f"WITH {PTS} SELECT id, CASE WHEN abs(z) >= 0 THEN CASE WHEN z > 0 THEN '+z' WHEN z < 0 THEN '-z' ELSE '+x' END END AS axis FROM pts WHERE z <> 0")
def best_match_axis(s, d):
    return tables.embedding_points(s, d).where("z <> 0").select("id", spatial.best_axis().alias("axis"))


@query(f"WITH {PTS} SELECT p.id, r_regionkey::BIGINT AS copy_id, round(p.x + r_regionkey, 6) AS x FROM pts p, region")
def copy_to_points(s, d):
    t = T(s, d, "region").select(F.col("r_regionkey").cast("long").alias("copy_id"), F.col("r_regionkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return spatial.copy_to(tables.embedding_points(s, d), t).select("id", F.col("t_copy_id").alias("copy_id"), *r6("x"))


# --- Paths -----------------------------------------------------------------------------------------------------------

_WP = "WINDOW w AS (PARTITION BY path_id ORDER BY idx)"
_STEP = f"{EVT}, st AS (SELECT *, coalesce(sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)), 0) AS dn, coalesce(sqrt(pow(lag(x) OVER w - x, 2) + pow(lag(y) OVER w - y, 2)), 0) AS dp FROM evt {_WP})"
_LEN = f"{_STEP}, ln AS (SELECT *, coalesce(sum(dn) OVER (PARTITION BY path_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ds, sum(dn) OVER (PARTITION BY path_id) AS al FROM st)"


@query(f"WITH {_LEN} SELECT event_id, round(dn, 4) AS distance_to_next, round(dp, 4) AS distance_to_prev, round(ds, 3) AS distance_to_start, round(al - ds, 3) + 0.0 AS distance_to_end, round(CASE WHEN al > 0 THEN ds / al ELSE 0 END, 6) AS point_time FROM ln")
def path_properties(s, d):
    x = paths.properties(tables.event_paths(s, d))
    return x.select("event_id", *[F.round(c, 4).alias(c) for c in ("distance_to_next", "distance_to_prev")], *[(F.round(c, 3) + 0.0).alias(c) for c in ("distance_to_start", "distance_to_end")], *r6("point_time"))


@query(f"""WITH {_STEP}, c AS (SELECT *, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - coalesce(lead(x) OVER w, first_value(x) OVER w) * y AS cr FROM st {_WP})
SELECT path_id, count(*) AS points, round(sum(dn), 3) AS length, round(avg(y), 6) AS centroid_y FROM c GROUP BY path_id""")
def path_summary(s, d):
    return paths.summary(tables.event_paths(s, d)).select("path_id", "points", F.round("length", 3).alias("length"), *r6("centroid_y"))


@query("""WITH p AS (SELECT p_brand AS path_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y FROM part),
c AS (SELECT path_id, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - coalesce(lead(x) OVER w, first_value(x) OVER w) * y AS cr,
  sqrt(pow(coalesce(lead(x) OVER w, first_value(x) OVER w) - x, 2) + pow(coalesce(lead(y) OVER w, first_value(y) OVER w) - y, 2)) AS s FROM p WINDOW w AS (PARTITION BY path_id ORDER BY idx))
SELECT path_id, round(abs(sum(cr) / 2), 4) AS area, sum(cr) < 0 AS is_clockwise, round(sum(s), 4) AS perimeter FROM c GROUP BY path_id""")
def path_area(s, d):
    x = tables.points(T(s, d, "part"), F.col("p_brand"), ["p_partkey"], F.col("p_size"), F.col("p_partkey") % 50).withColumnRenamed("dataset_id", "path_id")
    return paths.summary(x, True).select("path_id", F.round("area", 4).alias("area"), "is_clockwise", F.round("perimeter", 4).alias("perimeter"))


def _smooth_sql(w):
    terms = [(i, 1 - abs(i) / w) for i in range(-w + 1, w)]
    at = lambda i: f"lead(y, {i}) OVER w" if i > 0 else f"lag(y, {-i}) OVER w" if i < 0 else "y"
    up = " + ".join(f"coalesce(({at(i)}) * {k!r}, 0)" for i, k in terms)
    down = " + ".join(f"CASE WHEN {at(i)} IS NOT NULL THEN {k!r} ELSE 0 END" for i, k in terms)
    return f"WITH {EVT} SELECT event_id, round(({up}) / ({down}), 6) AS smooth_y FROM evt {_WP}"


@query(_smooth_sql(4))
def path_smooth(s, d):
    return paths.smooth(tables.event_paths(s, d), 4, names=("y",)).select("event_id", *r6("smooth_y"))


@query(f"WITH {EVT}, n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM evt) SELECT event_id, ((idx - 5 % n + n) % n)::BIGINT AS idx FROM n")
def path_shift(s, d):
    return paths.shift(tables.event_paths(s, d), 5).select("event_id", "idx")


@query(f"WITH {EVT} SELECT event_id, max(idx) OVER (PARTITION BY path_id) - idx AS idx FROM evt")
def path_reverse(s, d):
    return paths.reverse(tables.event_paths(s, d)).select("event_id", "idx")


_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_SPLITS = {
    "split": (f"sum(c) OVER (PARTITION BY path_id ORDER BY idx {_RUN})", ""), "remove": (f"sum(c) OVER (PARTITION BY path_id ORDER BY idx {_RUN})", "WHERE c = 0"),
    "disconnect": (f"sum(c) OVER (PARTITION BY path_id ORDER BY idx {_RUN}) - c", ""), "partition": (f"sum(k) OVER (PARTITION BY path_id ORDER BY idx {_RUN})", ""),
}
for _m, (_sum, _w) in _SPLITS.items():
    query(
        f"""WITH {EVT}, c AS (SELECT *, (event_type = 'purchase')::INT AS c FROM evt), k AS (SELECT *, CASE WHEN c <> lag(c) OVER (PARTITION BY path_id ORDER BY idx) THEN 1 ELSE 0 END AS k FROM c), z AS (SELECT *, ({_sum})::BIGINT AS sub_id FROM k)
        SELECT event_id, sub_id, row_number() OVER (PARTITION BY path_id, sub_id ORDER BY idx) - 1 AS sub_idx FROM z {_w}""",
        f"path_split_{_m}",
    )(lambda s, d, m=_m: paths.split(tables.event_paths(s, d), F.col("event_type") == "purchase", m).select("event_id", "sub_id", "sub_idx"))


@query(f"WITH {EVT}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM evt {_WP}), k AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [0] ELSE [0, 1, 2] END) AS sub FROM n) SELECT event_id, sub::BIGINT AS sub, round(x + coalesce((nx - x) * sub / 3, 0), 4) AS x, round(y + coalesce((ny - y) * sub / 3, 0), 6) AS y FROM k")
def path_subdivide(s, d):
    return paths.subdivide(tables.event_paths(s, d), 2).select("event_id", "sub", F.round("x", 4).alias("x"), *r6("y"))


@query(f"""WITH {EVT}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM evt {_WP}), l AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM n),
k AS (SELECT *, unnest(range(CASE WHEN nx IS NULL THEN 1 ELSE floor(len / 40000)::BIGINT + 1 END)) AS sub FROM l) SELECT event_id, sub::BIGINT AS sub, round(x + coalesce((nx - x) * sub * 40000 / nullif(len, 0), 0), 3) AS x FROM k""")
def path_subdivide_distance(s, d):
    return paths.subdivide(tables.event_paths(s, d), 40000.0, "distance").select("event_id", "sub", F.round("x", 3).alias("x"))


@query(f"""WITH {_LEN}, g AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ln {_WP}), k AS (SELECT DISTINCT path_id, al, unnest(range(10)) AS sample FROM ln WHERE al > 0)
SELECT k.path_id, k.sample::BIGINT AS sample, round(CASE WHEN g.nx IS NULL OR k.sample = 9 THEN l.x ELSE g.x + (g.nx - g.x) * (k.sample * k.al / 9 - g.ds) / g.dn END, 2) AS x
FROM k LEFT JOIN g ON g.path_id = k.path_id AND g.dn > 0 AND ceil(g.ds / (k.al / 9)) <= k.sample AND k.sample <= ceil((g.ds + g.dn) / (k.al / 9)) - 1 AND k.sample < 9
JOIN (SELECT path_id, arg_max(x, idx) AS x FROM evt GROUP BY path_id) l ON l.path_id = k.path_id""")
def path_resample(s, d):
    return paths.resample(tables.event_paths(s, d), 10).select("path_id", "sample", F.round("x", 2).alias("x"))


@query(f"WITH {EVT} SELECT event_id, round(y + (coalesce(lead(y) OVER w, y) - y) * 0.5, 6) AS y FROM evt {_WP}")
def path_slide(s, d):
    return paths.slide(tables.event_paths(s, d), 0.5).select("event_id", *r6("y"))


@query(f"WITH {_LEN} SELECT event_id FROM ln WHERE ds >= 50000 AND al - ds >= 50000")
def path_shrink(s, d):
    return paths.shrink(tables.event_paths(s, d), 50000.0, 50000.0).select("event_id")


@query(f"WITH {EVT} SELECT event_id, round((coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / 2, 6) AS ty FROM evt {_WP}")
def path_tangents(s, d):
    return paths.tangents(tables.event_paths(s, d)).select("event_id", *r6("ty"))


@query(f"WITH {_LEN} SELECT event_id, round(a + (b - a) * CASE WHEN al > 0 THEN ds / al ELSE 0 END, 5) AS blended FROM (SELECT *, first_value(y) OVER v AS a, last_value(y) OVER v AS b FROM ln WINDOW v AS (PARTITION BY path_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
def path_blend(s, d):
    return paths.blend_ends(tables.event_paths(s, d), "y").select("event_id", F.round("blended", 5).alias("blended"))


@query(f"""WITH {EVT}, n AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM evt {_WP})
SELECT event_id FROM n WHERE coalesce((ax * bx + ay * b_y) / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y), 0), -1) < 0.999""")
def path_fuse_collinear(s, d):
    return paths.fuse_collinear(tables.event_paths(s, d)).select("event_id")


@query(f"""WITH {EVT}, e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'click' THEN 1 END AS e FROM evt),
s AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY idx {_RUN}), 0) AS s FROM e), b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY path_id ORDER BY idx), 0) AS b FROM s),
k AS (SELECT *, sum((s = 1 AND b = 0)::INT) OVER (PARTITION BY path_id ORDER BY idx {_RUN}) - 1 AS k FROM b)
SELECT event_id, s = 1 AS is_inside_range, CASE WHEN s = 1 THEN k ELSE -1 END::BIGINT AS range_index, CASE WHEN s = 1 THEN row_number() OVER (PARTITION BY path_id, k, s ORDER BY idx) - 1 ELSE -1 END::BIGINT AS index_inside_range FROM k""")
def attribute_rolling(s, d):
    x = paths.rolling(tables.event_paths(s, d), F.col("event_type") == "click", F.col("event_type") == "purchase")
    return x.select("event_id", "is_inside_range", "range_index", "index_inside_range")


@query(f"WITH {_STEP}, n AS (SELECT *, lead(idx) OVER w AS dst FROM st {_WP}) SELECT path_id, idx AS src, dst, round(dn, 4) AS length FROM n WHERE dst IS NOT NULL")
def path_to_edges(s, d):
    return paths.to_edges(tables.event_paths(s, d)).select("path_id", "src", "dst", F.round("length", 4).alias("length"))


# --- Probes and graphs -----------------------------------------------------------------------------------------------

_NN = f"{PTS}, nn AS (SELECT a.id AS a, b.id AS b, {D2()} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D2()}, b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id)"


@query(f"WITH {_NN} SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM nn WHERE r <= 5")
def probe_knn(s, d):
    return probes.knn(tables.embedding_points(s, d), 5)


@query(f"WITH {_NN} SELECT least(a, b) AS src, greatest(a, b) AS dst FROM nn WHERE r <= 5 GROUP BY ALL HAVING count(*) = 2")
def probe_knn_mutual(s, d):
    return probes.knn(tables.embedding_points(s, d), 5, True)


@query(f"WITH {_NN} SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM nn WHERE r <= 3 AND d <= 0.16")
def probe_closest(s, d):
    return probes.closest(tables.embedding_points(s, d), 3, 0.4)


@query(f"""WITH {_NN}, e AS (SELECT * FROM nn WHERE d <= 0.0625), c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), k AS (SELECT * FROM e WHERE b IN (SELECT a FROM c)),
f AS (SELECT a, b FROM k WHERE a IN (SELECT a FROM c) UNION ALL SELECT a, arg_min(b, (d, b)) FROM k WHERE a NOT IN (SELECT a FROM c) GROUP BY a) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM f""")
def probe_dbscan(s, d):
    return probes.dbscan(tables.embedding_points(s, d), 0.25, 4)


@query(f"""WITH {PTS}, e AS (SELECT a.id AS a, b.id AS b, {D2()} AS d, ((floor(atan2(b.y - a.y, b.x - a.x) / (2 * pi()) * 6)::BIGINT % 6) + 6) % 6 AS c, b.x - a.x AS dx, b.y - a.y AS dy FROM pts a JOIN pts b ON a.id <> b.id AND {D2()} <= 0.25),
f AS (SELECT a, arg_min(b, (dx * cos((c + 0.5) * (2 * pi() / 6)) + dy * sin((c + 0.5) * (2 * pi() / 6)), b)) AS b FROM e GROUP BY a, c) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM f""")
def probe_theta(s, d):
    return probes.theta(tables.embedding_points(s, d), 6, 0.5)


@query(f"WITH {PTS}, e AS (SELECT a.id AS a, b.id AS b, {D2()} AS d FROM pts a JOIN pts b ON a.id <> b.id AND {D2()} <= 0.25 AND {D2()} > 0 AND (b.x - a.x) / sqrt({D2()}) >= 0.8), f AS (SELECT a, arg_min(b, (d, b)) AS b FROM e GROUP BY a) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM f")
def probe_direction(s, d):
    return probes.direction(tables.embedding_points(s, d), (1.0, 0.0, 0.0), 0.8, 0.5)


@query(f"WITH {PTS}, e AS (SELECT a.id AS src, b.id AS dst, b.z - a.z AS r FROM pts a JOIN pts b ON {D2()} <= 0.25 AND b.z > a.z) SELECT src, arg_min(dst, (-r, dst)) AS dst FROM e GROUP BY src")
def probe_gradient_flow(s, d):
    return probes.gradient_flow(tables.embedding_points(s, d).withColumn("v", F.col("z")), "v", 0.5)


@query(f"WITH {PTS} SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM pts a JOIN pts b ON a.id <> b.id AND {D2()} <= 0.09 AND abs(a.z - b.z) <= 0.05")
def probe_level_set(s, d):
    return probes.level_set(tables.embedding_points(s, d).withColumn("v", F.col("z")), "v", 0.05, 0.3)


@query(f"WITH {PTS} SELECT id AS src, o AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY dataset_id ORDER BY x, id) AS o FROM pts) WHERE o IS NOT NULL")
def probe_chain(s, d):
    return probes.chain(tables.embedding_points(s, d), "x")


@query(f"WITH {PTS} SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON a.dataset_id = b.dataset_id AND b.idx = a.idx + 2")
def probe_index(s, d):
    return probes.by_index(tables.embedding_points(s, d), F.col("idx") + 2)


@query(f"WITH {PTS} SELECT a.id AS src, arg_min(b.id, ({D2()}, b.id)) AS dst FROM pts a JOIN pts b ON a.id % 25 <> 0 AND b.id % 25 = 0 GROUP BY a.id")
def probe_hub_and_spoke(s, d):
    p = tables.embedding_points(s, d)
    return probes.hub_and_spoke(p, p.where("id % 25 = 0"))


_DEG = "deg AS (SELECT n AS node, count(*) AS degree FROM (SELECT src AS n FROM {e} UNION ALL SELECT dst FROM {e}) GROUP BY n)"


@query(f"WITH {SUP}, {_DEG.format(e='sup')} SELECT node, degree FROM deg")
def cluster_degree(s, d):
    return graph.degree(tables.supply_edges(s, d))


@query(f"WITH {SUP}, {_DEG.format(e='sup')}, b AS (SELECT src AS node, dst AS other FROM sup UNION ALL SELECT dst, src FROM sup) SELECT b.node, arg_min(other, (-degree, other)) AS largest, arg_min(other, (degree, other)) AS smallest FROM b JOIN deg ON deg.node = other GROUP BY b.node")
def special_neighbors(s, d):
    return graph.special_neighbours(tables.supply_edges(s, d))


@query(f"WITH {PLC}, {_DEG.format(e='plc')} SELECT src, dst FROM plc WHERE src NOT IN (SELECT node FROM deg WHERE degree = 1) AND dst NOT IN (SELECT node FROM deg WHERE degree = 1)")
def remove_leaves(s, d):
    return graph.remove_leaves(tables.place_edges(s, d))


def _knn_edges(s, d):
    return probes.knn(tables.embedding_points(s, d), 3)


_KE = f"{_NN}, ke AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM nn WHERE r <= 3), ep AS (SELECT src, dst, sqrt({D2('p', 'q')}) AS length, q.x - p.x AS dx FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst)"
_KB = f"{_KE}, kb AS (SELECT src AS node, dst AS other, length FROM ep UNION ALL SELECT dst, src, length FROM ep)"


@query(f"WITH {_KE} SELECT src, dst, round(length, 6) AS length, round(coalesce(dx / nullif(length, 0), 0), 6) AS dir_x FROM ep")
def edge_properties(s, d):
    return graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)).select("src", "dst", *r6("length", "dir_x"))


for _n, _big, _keep in (("keep_longest", True, True), ("keep_shortest", False, True), ("remove_longest", True, False), ("remove_shortest", False, False)):
    _k = "(-length, other)" if _big else "(length, other)"
    query(
        f"WITH {_KB}, el AS (SELECT DISTINCT least(node, o) AS src, greatest(node, o) AS dst FROM (SELECT node, arg_min(other, {_k}) AS o FROM kb GROUP BY node)) SELECT src, dst FROM ep {'SEMI' if _keep else 'ANTI'} JOIN el USING (src, dst)", f"refine_{_n}"
    )(lambda s, d, b=_big, k=_keep: graph.elect(graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)), "length", b, k).select("src", "dst"))


@query(f"WITH {_KE} SELECT src, dst FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.id <> src AND o.id <> dst AND pow(o.x - (p.x + q.x) / 2, 2) + pow(o.y - (p.y + q.y) / 2, 2) + pow(o.z - (p.z + q.z) / 2, 2) < ({D2('p', 'q')}) / 4 * (1 - 1e-12))")
def refine_gabriel(s, d):
    return graph.gabriel(_knn_edges(s, d), tables.embedding_points(s, d)).select("src", "dst")


@query(f"WITH {_KB} SELECT node, round(max(length), 6) AS longest, round(min(length), 6) AS shortest, round(avg(length), 6) AS average FROM kb GROUP BY node")
def special_edges(s, d):
    return graph.special_edges(graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d))).select("node", *r6("longest", "shortest", "average"))


@query(f"WITH {_KB} SELECT node, round(avg(p.x), 6) AS mean, round(min(p.x), 6) AS low, round(sum(p.x), 6) AS total FROM kb JOIN pts p ON p.id = other GROUP BY node")
def sample_neighbors(s, d):
    v = tables.embedding_points(s, d).select(F.col("id").alias("node"), F.col("x").alias("value"))
    return graph.sample_neighbours(_knn_edges(s, d), v, {"mean": F.avg, "low": F.min, "total": F.sum}).select("node", *r6("mean", "low", "total"))


for _m, _agg in {"all": "bool_and(p.x > -1)", "some": "count(*) FILTER (p.x > -1) >= 2"}.items():
    query(f"WITH {_KB} SELECT node, {_agg} AS passes FROM kb JOIN pts p ON p.id = other GROUP BY node", f"vtx_filter_adjacency_{_m}")(
        lambda s, d, m=_m: graph.adjacency_filter(_knn_edges(s, d), tables.embedding_points(s, d).select(F.col("id").alias("node"), F.col("x").alias("value")), F.col("value") > -1, m, 2)
    )
_ENDS = {"none": "NOT a AND NOT b", "both": "a AND b", "any": "a OR b", "start": "a", "end": "b", "seesaw": "a <> b"}
for _m, _cond in _ENDS.items():
    query(f"WITH {_KE} SELECT src, dst FROM (SELECT src, dst, p.x > 0 AS a, q.x > 0 AS b FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst) WHERE {_cond}", f"edge_endpoints_{_m}")(
        lambda s, d, m=_m: graph.endpoints_check(_knn_edges(s, d), tables.embedding_points(s, d).select(F.col("id").alias("node"), (F.col("x") > 0).alias("flag")), m).where("passes").select("src", "dst")
    )


@query(f"WITH {_KE} SELECT src, dst FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst WHERE p.x > q.x")
def edge_endpoints_compare(s, d):
    v = tables.embedding_points(s, d).select(F.col("id").alias("node"), F.col("x").alias("value"))
    return graph.endpoints_compare(_knn_edges(s, d), v, lambda a, b: a > b).where("passes").select("src", "dst")


@query(f"WITH {_KE} SELECT src, dst FROM ke WHERE src IN (SELECT id FROM pts WHERE y > 0) AND dst IN (SELECT id FROM pts WHERE y > 0)")
def filter_vtx(s, d):
    return graph.filter_vertices(_knn_edges(s, d), tables.embedding_points(s, d).where("y > 0"))


@query(f"WITH {_KE}, n AS (SELECT src || '-' || dst AS e, src AS v FROM ke UNION ALL SELECT src || '-' || dst, dst FROM ke) SELECT DISTINCT x.e AS a, y.e AS b FROM n x JOIN n y ON x.v = y.v AND x.e < y.e")
def dual_graph(s, d):
    return graph.dual(_knn_edges(s, d))


@query(f"WITH RECURSIVE {_KE}, u AS (SELECT src AS a, dst AS b FROM ke UNION ALL SELECT dst, src FROM ke), c AS (SELECT DISTINCT a AS node, a AS r FROM u UNION SELECT c.node, u.b FROM c JOIN u ON u.a = c.r) SELECT node, min(r) AS component FROM c GROUP BY node")
def components(s, d):
    return graph.components(_knn_edges(s, d))


@query(f"WITH RECURSIVE {PLC}, u AS (SELECT src AS a, dst AS b FROM plc UNION ALL SELECT dst, src FROM plc), f AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT u.b, f.depth + 1 FROM f JOIN u ON u.a = f.node WHERE f.depth < 6) SELECT node, min(depth)::BIGINT AS depth FROM f GROUP BY node")
def flood_fill_depth(s, d):
    return graph.hops(tables.place_edges(s, d), s.createDataFrame([("r0",)], "node string"))


def _unroll(step, start, rounds):
    out = [f"s0 AS ({start})"] + [f"s{i + 1} AS ({step.format(p=f's{i}')})" for i in range(rounds)]
    return ", ".join(out), f"s{rounds}"


_KZ, _KZN = _unroll("SELECT kb.node, (sum(v.score) * 0.1 + 1.0)::DOUBLE AS score FROM kb JOIN {p} v ON v.node = kb.other GROUP BY kb.node", "SELECT DISTINCT node, 1.0::DOUBLE AS score FROM kb", 6)


@query(f"WITH {_KB}, {_KZ} SELECT node, round(score, 6) AS score FROM {_KZN}")
def centrality_katz(s, d):
    return graph.katz(_knn_edges(s, d), 0.1, 6).select("node", *r6("score"))


_EV, _EVN = _unroll("SELECT node, t / sqrt(sum(t * t) OVER ()) AS score FROM (SELECT kb.node, sum(v.score) AS t FROM kb JOIN {p} v ON v.node = kb.other GROUP BY kb.node)", "SELECT DISTINCT node, 1.0 / sqrt((SELECT count(DISTINCT node) FROM kb)) AS score FROM kb", 6)


@query(f"WITH {_KB}, {_EV} SELECT node, round(score, 6) AS score FROM {_EVN}")
def centrality_eigenvector(s, d):
    return graph.eigenvector(_knn_edges(s, d), 6).select("node", *r6("score"))


_BF, _BFN = _unroll("SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM {p} UNION ALL SELECT kb.other, v.cost + kb.length FROM {p} v JOIN kb ON kb.node = v.node) GROUP BY node", "SELECT 0::BIGINT AS node, 0.0::DOUBLE AS cost", 64)


@query(f"WITH {_KB}, {_BF} SELECT node, round(cost, 6) AS cost FROM {_BFN}")
def bellman_ford(s, d):
    e = graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)).withColumnRenamed("length", "weight")
    return graph.bellman_ford(e, s.createDataFrame([(0,)], "node long")).select("node", *r6("cost"))


@query(f"""WITH RECURSIVE {_KB}, rc AS (SELECT src, dst, length, src AS node FROM ep UNION SELECT r.src, r.dst, r.length, k.other FROM rc r JOIN kb k ON k.node = r.node AND k.length < r.length)
SELECT src, dst, round(length, 6) AS weight FROM ep e WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.src = e.src AND rc.dst = e.dst AND rc.node = e.dst)""")
def refine_mst(s, d):
    e = graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)).withColumnRenamed("length", "weight")
    return graph.spanning_forest(e).select("src", "dst", *r6("weight"))


@query(f"WITH {_KE} SELECT src % 4 AS cluster_id, count(*) AS n, sum(dst)::BIGINT AS total FROM ke GROUP BY src % 4")
def cluster_pack_unpack(s, d):
    e = _knn_edges(s, d).withColumn("cluster_id", F.col("src") % 4)
    return graph.unpack(graph.pack(e)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("total"))


# --- Shapes and functions --------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS k, x::BIGINT AS ix, y::BIGINT AS iy, round((n_nationkey + (x - 1) * 0.5)::DOUBLE, 6) AS x, round(((y - 0.5) * 0.5)::DOUBLE, 6) AS y FROM nation, range(3) a(x), range(2) b(y)")
def shape_grid(s, d):
    seeds = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return shapes.grid(seeds, 3, 2, 1, 0.5).select("k", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), *r6("x", "y"))


@query("SELECT n_nationkey::BIGINT AS k, i::BIGINT AS step, round(2 * cos(radians(360.0 / 8 * i)), 6) + 0.0 AS x, round(2 * sin(radians(360.0 / 8 * i)), 6) + 0.0 AS y FROM nation, range(8) a(i)")
def shape_circle(s, d):
    seeds = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return shapes.circle(seeds, F.lit(8), F.lit(2.0)).select("k", F.col("step").cast("long").alias("step"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")])


@query("SELECT n_nationkey::BIGINT AS k, i::BIGINT AS step, round(1 - (i * 2 + 1) / 20.0, 6) AS z, round(sqrt(1 - pow(1 - (i * 2 + 1) / 20.0, 2)) * cos(i * pi() * (3 - sqrt(5))), 6) AS x FROM nation, range(20) a(i)")
def shape_sphere(s, d):
    seeds = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return shapes.phi_sphere(seeds, 20).select("k", F.col("step").cast("long").alias("step"), *r6("z", "x"))


for _m, _sql in {"ignore": "CASE WHEN i < 0 OR i >= 10 THEN -1 ELSE i END", "tile": "((i % 10) + 10) % 10", "clamp": "least(greatest(i, 0), 9)", "yoyo": "CASE WHEN ((i % 18) + 18) % 18 < 10 THEN ((i % 18) + 18) % 18 ELSE 18 - ((i % 18) + 18) % 18 END"}.items():
    query(f"SELECT p_partkey, ({_sql})::BIGINT AS i FROM (SELECT p_partkey, p_partkey % 60 - 25 AS i FROM part)", f"index_safety_{_m}")(
        lambda s, d, m=_m: T(s, d, "part").select("p_partkey", M.safe_index(F.col("p_partkey") % 60 - 25, F.lit(10), m).cast("long").alias("i"))
    )
for _m, _sql in {"euclidean": "sqrt(pow(x, 2) + pow(y, 2) + pow(z, 2))", "manhattan": "abs(x) + abs(y) + abs(z)", "chebyshev": "greatest(abs(x), abs(y), abs(z))"}.items():
    query(f"WITH {PTS} SELECT id, round({_sql}, 6) AS distance FROM pts", f"distance_{_m}")(
        lambda s, d, m=_m: tables.embedding_points(s, d).select("id", F.round(M.distance(M.axes(), [F.lit(0.0)] * 3, m), 6).alias("distance"))
    )


# --- Kernels ---------------------------------------------------------------------------------------------------------


def _weighted(s, d):
    e = graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)).withColumnRenamed("length", "weight")
    return e.withColumn("cluster_id", F.lit(0).cast("long"))


def _from_first(s, d):
    return tables.embedding_points(s, d).select(F.lit(0).cast("long").alias("cluster_id"), F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))


for _m in ("dijkstra", "bidirectional", "astar"):
    query(f"WITH {_KB}, {_BF} SELECT 0::BIGINT AS start, node AS goal, round(cost, 6) AS cost FROM {_BFN}", f"pathfinding_{_m}")(
        lambda s, d, m=_m: search.paths(_weighted(s, d), _from_first(s, d), m, tables.embedding_points(s, d).withColumn("cluster_id", F.lit(0).cast("long")) if m == "astar" else None)
        .where("cost is not null").select("start", "goal", *r6("cost"))
    )


@query()
def pathfinding_plot_edges(s, d):
    stops = tables.embedding_points(s, d).select(F.lit(0).cast("long").alias("cluster_id"), F.col("id").alias("idx"), "id")
    return search.plot(_weighted(s, d), stops).select("start", "goal", *r6("cost"), F.size("path").cast("long").alias("nodes"))


@query()
def flood_fill(s, d):
    seeds = s.createDataFrame([(0, 0), (0, 7)], "cluster_id long, node long")
    return search.flood_fill(_weighted(s, d), seeds, max_depth=8).select("node", "seed", "depth", "order", *r6("distance"), "ending")


@query()
def centrality_betweenness(s, d):
    return search.centrality(_weighted(s, d)).select("node", *r6("betweenness", "closeness", "harmonic"))


@query(f"""WITH RECURSIVE {_KB}, rc AS (SELECT src, dst, src AS node FROM ep UNION SELECT r.src, r.dst, k.other FROM rc r JOIN kb k ON k.node = r.node AND NOT (least(k.node, k.other) = r.src AND greatest(k.node, k.other) = r.dst))
SELECT src, dst FROM ep e WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.src = e.src AND rc.dst = e.dst AND rc.node = e.dst)""")
def refine_bridges(s, d):
    return search.bridges(_weighted(s, d)).select("src", "dst")


@query()
def probe_greedy_spanner(s, d):
    return search.spanner(tables.embedding_points(s, d)).select("dataset_id", "src", "dst", *r6("length"))


@query()
def cluster_break_to_paths(s, d):
    return search.break_to_paths(_weighted(s, d)).drop("cluster_id")


#: A hull's edges: both ends, counter-clockwise, have no point of their dataset to the right, and none beyond them in line.
_HULL = f"""{PTS}, he AS (SELECT a.dataset_id, a.id AS p, b.id AS q, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM pts a JOIN pts b ON a.dataset_id = b.dataset_id AND a.id <> b.id
WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.dataset_id = a.dataset_id AND r.id <> a.id AND r.id <> b.id AND (b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) <= 0))"""


@query(f"""WITH RECURSIVE {_HULL}, st AS (SELECT dataset_id, arg_min(p, (px, py)) AS p FROM he GROUP BY dataset_id), w AS (SELECT dataset_id, 0::BIGINT AS idx, p AS id FROM st
UNION ALL SELECT w.dataset_id, w.idx + 1, h.q FROM w JOIN he h ON h.dataset_id = w.dataset_id AND h.p = w.id JOIN st ON st.dataset_id = w.dataset_id WHERE h.q <> st.p) SELECT dataset_id, idx, id FROM w""")
def convex_hull_2d(s, d):
    return geometry.convex_hull(tables.embedding_points(s, d)).select("dataset_id", "idx", "id")


@query()
def delaunay_2d(s, d):
    return geometry.delaunay_edges(tables.embedding_points(s, d))


@query()
def topology_point_surface(s, d):
    return geometry.delaunay_triangles(tables.embedding_points(s, d))


@query()
def voronoi_2d(s, d):
    return geometry.voronoi(tables.embedding_points(s, d)).select("dataset_id", "site", *r6("x", "y"))


@query()
def lloyd_relax_2d(s, d):
    return geometry.lloyd(tables.embedding_points(s, d), 2).select("dataset_id", "id", *r6("x", "y"))


@query()
def clipper_rect_clip(s, d):
    rings = geometry.convex_hull(tables.embedding_points(s, d)).withColumnRenamed("dataset_id", "path_id")
    return geometry.clip(rings, (-0.5, -0.5), (0.5, 0.5)).select("path_id", "idx", *r6("x", "y"))


@query()
def clipper_triangulate(s, d):
    rings = geometry.convex_hull(tables.embedding_points(s, d)).withColumnRenamed("dataset_id", "path_id")
    return geometry.triangulate(rings)


@query()
def find_all_cells(s, d):
    p = tables.embedding_points(s, d)
    e = geometry.delaunay_edges(p).withColumnRenamed("dataset_id", "cluster_id")
    return geometry.cells(e, p.withColumnRenamed("dataset_id", "cluster_id"))


@query(f"WITH {_KE}, u AS (SELECT src AS a, dst AS b FROM ke UNION ALL SELECT dst, src FROM ke), m AS (SELECT a, avg(x) AS mx FROM u JOIN pts ON id = b GROUP BY a) SELECT id, round(x + (mx - x) * 0.5, 6) AS x FROM pts JOIN m ON a = id")
def relax_laplacian(s, d):
    return fields.relax(_knn_edges(s, d), tables.embedding_points(s, d), 1, 0.5).select("id", *r6("x"))


_FLOW = f"""WITH {_TG}, n AS (SELECT a.id, 1 - ({D2()}) / 0.16 AS w, b.y AS dx FROM pts a JOIN tg b ON {D2()} <= 0.16) SELECT id, round(sum(dx * w), 6) AS vx, count(*) AS pings FROM n GROUP BY id"""


def _effectors(s, d):
    a, b = _targets(s, d)
    return a, b.withColumn("dx", F.col("y")).withColumn("dy", F.lit(0.0)).withColumn("dz", F.lit(1.0))


@query(_FLOW)
def tensor_flow(s, d):
    a, b = _effectors(s, d)
    return fields.sample(a, b, 0.4).select("id", *r6("vx"), "pings")


@query(_FLOW.replace("b.y AS dx", f"coalesce((b.x - a.x) / nullif(sqrt({D2()}), 0), 0) AS dx"))
def tensor_pole(s, d):
    a, b = _effectors(s, d)
    return fields.sample(a, b, 0.4, "pole").select("id", *r6("vx"), "pings")


@query(_FLOW.replace("b.y AS dx", "0 * (b.z - a.z) - 1.0 * (b.y - a.y) AS dx"))
def tensor_spin(s, d):
    a, b = _effectors(s, d)
    return fields.sample(a, b, 0.4, "spin").select("id", *r6("vx"), "pings")


@query()
def tensors_transform(s, d):
    a, b = _effectors(s, d)
    return fields.transform(a, b, 0.4, 0.05, 3).select("id", *r6("x", "y", "z", "traveled"), "updates", "stopped")


@query()
def bin_packing(s, d):
    boxes = T(s, d, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("sx"), F.lit(10.0).alias("sy"), (F.col("p_partkey") % 20 + 1).cast("double").alias("sz"))
    return packing.pack(boxes, (60.0, 40.0, 40.0))


@query()
def valency_bonding(s, d):
    return packing.bond(_weighted(s, d), 5, [[i != j for j in range(5)] for i in range(5)]).drop("cluster_id")


for _name in noise.NOISES:
    query(None, f"noise_{_name}")(lambda s, d, n=_name: tables.embedding_points(s, d).select("id", F.round(noise.noise(n, "x", "y", "z", 3.0), 6).alias("value")))


@query(f"""WITH RECURSIVE {PTS}, od AS (SELECT id, x, y, z, row_number() OVER (ORDER BY id) AS o FROM pts), nb AS (SELECT a.id, a.o, list(b.id) FILTER (b.id IS NOT NULL) AS l FROM od a LEFT JOIN od b ON b.o < a.o AND {D2()} <= 0.0625 GROUP BY a.id, a.o),
st AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS kept UNION ALL SELECT n.o, CASE WHEN list_has_any(st.kept, coalesce(n.l, [])) THEN st.kept ELSE list_append(st.kept, n.id) END FROM st JOIN nb n ON n.o = st.o + 1)
SELECT unnest(kept) AS id FROM (SELECT arg_max(kept, o) AS kept FROM st)""")
def self_pruning(s, d):
    return spatial.self_prune(tables.embedding_points(s, d), 0.25, F.col("id")).select("id")


@query(f"WITH {_HULL} SELECT a.id, h.dataset_id AS path_id FROM pts a JOIN he h ON (h.py > a.y) <> (h.qy > a.y) AND a.x < h.px + (a.y - h.py) * (h.qx - h.px) / (h.qy - h.py) GROUP BY a.id, h.dataset_id HAVING count(*) % 2 = 1")
def sample_inside_path(s, d):
    p = tables.embedding_points(s, d)
    return paths.inside_path(p, geometry.convex_hull(p).withColumnRenamed("dataset_id", "path_id").withColumn("z", F.lit(0.0)))


@query(f"""WITH {PTS}, sg AS (SELECT dataset_id AS p, idx, x, y, lead(x) OVER w - x AS ux, lead(y) OVER w - y AS uy FROM pts WINDOW w AS (PARTITION BY dataset_id ORDER BY idx)),
cr AS (SELECT a.p AS path_id, a.idx, b.p AS r_path_id, b.idx AS r_idx, a.x, a.y, a.ux, a.uy, ((b.x - a.x) * b.uy - (b.y - a.y) * b.ux) / nullif(a.ux * b.uy - a.uy * b.ux, 0) AS alpha, ((b.x - a.x) * a.uy - (b.y - a.y) * a.ux) / nullif(a.ux * b.uy - a.uy * b.ux, 0) AS beta
FROM sg a JOIN sg b ON a.p < b.p AND a.ux IS NOT NULL AND b.ux IS NOT NULL) SELECT path_id, idx, r_path_id, r_idx, round(alpha, 6) AS alpha, round(x + ux * alpha, 6) AS x, round(y + uy * alpha, 6) AS y FROM cr WHERE alpha BETWEEN 0 AND 1 AND beta BETWEEN 0 AND 1""")
def path_crossings(s, d):
    p = tables.embedding_points(s, d).withColumnRenamed("dataset_id", "path_id")
    return paths.crossings(p, 0.5).select("path_id", "idx", "r_path_id", "r_idx", *r6("alpha", "x", "y"))


# --- Clusters --------------------------------------------------------------------------------------------------------


@query(f"WITH {_KE} SELECT src, dst FROM ep WHERE length > 0.3")
def edge_filter_length(s, d):
    return clusters.edge_length_filter(_knn_edges(s, d), tables.embedding_points(s, d), ">", 0.3).select("src", "dst")


@query(f"WITH {_KE} SELECT src, dst FROM ep WHERE coalesce(dx / nullif(length, 0), 0) >= 0.5")
def edge_filter_direction(s, d):
    return clusters.edge_direction_filter(_knn_edges(s, d), tables.embedding_points(s, d), (1.0, 0.0, 0.0), 0.5).select("src", "dst")


_KD = f"{_KB}, kd AS (SELECT node, count(*) AS g FROM kb GROUP BY node)"
for _m, _cond in {"any": "a.g > 4 OR b.g > 4", "both": "a.g > 4 AND b.g > 4", "sum": "a.g + b.g > 4"}.items():
    query(f"WITH {_KD} SELECT src, dst FROM ke JOIN kd a ON a.node = src JOIN kd b ON b.node = dst WHERE {_cond}", f"edge_filter_num_vtx_{_m}")(
        lambda s, d, m=_m: clusters.edge_degree_filter(_knn_edges(s, d), ">", 4, m).select("src", "dst")
    )


@query(f"WITH {_KD} SELECT node FROM kd WHERE g >= 4")
def vtx_filter_num_edges(s, d):
    return clusters.vertex_degree_filter(_knn_edges(s, d), ">=", 4)


_SPK = f"{_KE}, sp AS (SELECT src AS node, dst AS other, q.x - p.x AS vx, q.y - p.y AS vy, q.z - p.z AS vz, length FROM ep JOIN pts p ON p.id = src JOIN pts q ON q.id = dst UNION ALL SELECT dst, src, p.x - q.x, p.y - q.y, p.z - q.z, length FROM ep JOIN pts p ON p.id = src JOIN pts q ON q.id = dst)"


@query(f"WITH {_SPK}, r AS (SELECT node, max(vx) - min(vx) AS a, max(vy) - min(vy) AS b, max(vz) - min(vz) AS c FROM sp GROUP BY node) SELECT node, round(a, 6) AS range_x, round(sqrt(a * a + b * b + c * c), 6) AS amplitude FROM r")
def vtx_amplitude(s, d):
    return clusters.amplitude(_knn_edges(s, d), tables.embedding_points(s, d)).select("node", *r6("range_x", "amplitude"))


@query(f"WITH {_SPK} SELECT node, arg_min(other, (-vx / length, other)) AS matched, round(max(vx / length), 6) AS dot FROM sp GROUP BY node")
def vtx_edge_match(s, d):
    return clusters.edge_match(_knn_edges(s, d), tables.embedding_points(s, d), (1.0, 0.0, 0.0)).select("node", "matched", *r6("dot"))


_ORB = f"{_SPK}, ob AS (SELECT node, bit_or(CASE WHEN vx / length >= 0.7 THEN 1 ELSE 0 END | CASE WHEN -vx / length >= 0.7 THEN 2 ELSE 0 END | CASE WHEN vy / length >= 0.7 THEN 4 ELSE 0 END) AS mask FROM sp GROUP BY node)"
_WAYS = [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]


@query(f"WITH {_ORB} SELECT node, mask::BIGINT AS mask FROM ob")
def valency_write_orbitals(s, d):
    return clusters.orbitals(_knn_edges(s, d), tables.embedding_points(s, d), _WAYS)


@query(f"WITH {_ORB}, u AS (SELECT src AS a, dst AS b FROM ke UNION ALL SELECT dst, src FROM ke) SELECT a, b FROM u JOIN ob p ON p.node = a JOIN ob q ON q.node = b WHERE p.mask = 1 AND q.mask = 2")
def valency_patterns(s, d):
    e = _knn_edges(s, d)
    return clusters.patterns(e, clusters.orbitals(e, tables.embedding_points(s, d), _WAYS), 1, 2)


@query()
def cluster_connect(s, d):
    return clusters.connect(probes.knn(tables.embedding_points(s, d), 1), tables.embedding_points(s, d))


@query(f"""WITH {_KE}, g AS (SELECT src, dst, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM ke JOIN pts p ON p.id = src JOIN pts q ON q.id = dst)
SELECT src, dst FROM g WHERE NOT (ax * bx < 0 AND (ay + (b_y - ay) * (0 - ax) / nullif(bx - ax, 0)) BETWEEN -5 AND 5)""")
def cluster_cut(s, d):
    wall = s.createDataFrame([(0.0, -5.0, 0.0, 5.0)], "x double, y double, to_x double, to_y double")
    return clusters.cut(_knn_edges(s, d), tables.embedding_points(s, d), wall, 0.5).select("src", "dst")


@query(f"""WITH {_KE}, k AS (SELECT id, min(id) OVER (PARTITION BY floor(x / 0.3 + 0.5), floor(y / 0.3 + 0.5), floor(z / 0.3 + 0.5)) AS n FROM pts)
SELECT DISTINCT least(a.n, b.n) AS src, greatest(a.n, b.n) AS dst FROM ke JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.n <> b.n""")
def cluster_fuse(s, d):
    return clusters.fuse(_knn_edges(s, d), tables.embedding_points(s, d), 0.3)[0]


@query()
def cluster_simplify(s, d):
    return clusters.simplify(_knn_edges(s, d))


@query(f"WITH {PTS}, tg AS (SELECT id, x + 0.1 AS x, y, z FROM pts) SELECT a.id AS target, arg_min(b.dataset_id, ({D2()}, b.id)) AS cluster FROM tg a JOIN pts b ON true GROUP BY a.id")
def cluster_pick_closest(s, d):
    p = tables.embedding_points(s, d)
    return clusters.pick_closest(p, p.withColumn("x", F.col("x") + 0.1), "dataset_id")


@query("WITH m AS (SELECT 0 AS c, s_suppkey AS k FROM supplier UNION ALL SELECT 1, c_custkey FROM customer) SELECT c::BIGINT AS cluster, k, row_number() OVER (ORDER BY c, k) - 1 AS new_id FROM m")
def cluster_merge_vtx(s, d):
    a, b = T(s, d, "supplier").select(F.col("s_suppkey").alias("k")), T(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return clusters.merge_vertices([a, b], "k").select(F.col("cluster").cast("long").alias("cluster"), "k", "new_id")


@query(f"""WITH {_KE}, sg AS (SELECT src, dst, length, src || '-' || dst AS k, p.x, p.y, q.x - p.x AS ux, q.y - p.y AS uy FROM ep JOIN pts p ON p.id = src JOIN pts q ON q.id = dst),
cr AS (SELECT CASE WHEN a.length >= b.length THEN b.k ELSE a.k END AS k, ((b.x - a.x) * b.uy - (b.y - a.y) * b.ux) / nullif(a.ux * b.uy - a.uy * b.ux, 0) AS alpha, ((b.x - a.x) * a.uy - (b.y - a.y) * a.ux) / nullif(a.ux * b.uy - a.uy * b.ux, 0) AS beta
FROM sg a JOIN sg b ON a.k < b.k AND a.src <> b.src AND a.dst <> b.dst AND a.src <> b.dst AND a.dst <> b.src) SELECT src, dst FROM sg WHERE k NOT IN (SELECT k FROM cr WHERE alpha BETWEEN 0 AND 1 AND beta BETWEEN 0 AND 1)""")
def refine_overlap(s, d):
    return clusters.overlap_removal(_knn_edges(s, d), tables.embedding_points(s, d), 0.3).select("src", "dst")


_H = f"{_KE}, h AS (SELECT src, dst, length / (SELECT max(length) FROM ep) AS a, (dx / length + 1) / 2 AS b FROM ep WHERE length > 0)"
for _m, _sql in {"weighted": "(a * 2 + b) / 3", "sum": "a * 2 + b", "min": "least(a * 2, b)", "max": "greatest(a * 2, b)", "geometric": "exp((ln(greatest(a * 2, 1e-12)) + ln(greatest(b, 1e-12))) / 2)", "harmonic": "2 / (1 / greatest(a * 2, 1e-12) + 1 / greatest(b, 1e-12))"}.items():
    query(f"WITH {_H} SELECT src, dst, round({_sql}, 6) AS score FROM h", f"heuristics_{_m}")(
        lambda s, d, m=_m: clusters.normalized(graph.edge_properties(_knn_edges(s, d), tables.embedding_points(s, d)), "length", "a")
        .where("length > 0")
        .select("src", "dst", F.round(clusters.heuristic([(F.col("a"), 2.0), ((F.col("dir_x") + 1) / 2, 1.0)], m), 6).alias("score"))
    )


# --- Along paths -----------------------------------------------------------------------------------------------------

#: Paths of embeddings, a label each, in the order of ids; points are all of them, moved a little.
_EPA = f"{_TG}, sg AS (SELECT dataset_id AS path_id, idx, x, y, z, lead(x) OVER w AS tx, lead(y) OVER w AS ty, lead(z) OVER w AS tz, lead(idx) OVER w AS ti FROM pts WINDOW w AS (PARTITION BY dataset_id ORDER BY idx))"
_PRJ = f"""{_EPA}, dn AS (SELECT *, coalesce(sqrt(pow(tx - x, 2) + pow(ty - y, 2) + pow(tz - z, 2)), 0) AS dn FROM sg), al AS (SELECT *, coalesce(sum(dn) OVER (PARTITION BY path_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ds, sum(dn) OVER (PARTITION BY path_id) AS al FROM dn),
pr AS (SELECT p.id, s.*, least(greatest(((p.x - s.x) * (tx - s.x) + (p.y - s.y) * (ty - s.y) + (p.z - s.z) * (tz - s.z)) / nullif(dn * dn, 0), 0), 1) AS t, p.x AS px, p.y AS py, p.z AS pz FROM tg p JOIN al s ON tx IS NOT NULL),
ds AS (SELECT *, sqrt(pow(x + (tx - x) * t - px, 2) + pow(y + (ty - y) * t - py, 2) + pow(z + (tz - z) * t - pz, 2)) AS d FROM pr), ns AS (SELECT id, arg_min(path_id, (d, path_id, idx)) AS path_id, arg_min(idx, (d, path_id, idx)) AS idx, arg_min(t, (d, path_id, idx)) AS t, min(d) AS d, arg_min((ds + t * dn) / al, (d, path_id, idx)) AS tm, any_value(px) AS px FROM ds WHERE d <= 0.2 GROUP BY id)"""


def _moved_and_paths(s, d):
    p = tables.embedding_points(s, d)
    return p.withColumn("x", F.col("x") + 0.05), p.withColumnRenamed("dataset_id", "path_id").drop("id")


@query(f"WITH {_PRJ} SELECT id, path_id, idx, round(t, 5) AS t, round(d, 6) AS distance FROM ns")
def sample_nearest_path(s, d):
    return along.nearest_segment(*_moved_and_paths(s, d), 0.2).select("id", "path_id", "idx", F.round("t", 5).alias("t"), *r6("distance"))


@query(f"WITH {_PRJ} SELECT id FROM ns WHERE tm > 0.5")
def filter_time(s, d):
    return along.time_filter(*_moved_and_paths(s, d), 0.2, ">", 0.5).select("id")


@query(f"WITH {_PRJ} SELECT path_id, round(idx + t, 5) AS place, round(px, 6) AS x FROM ns UNION ALL SELECT dataset_id, idx, round(x, 6) FROM pts")
def path_insert(s, d):
    p, q = _moved_and_paths(s, d)
    return along.insert(q, p, 0.2).select("path_id", F.round("place", 5).alias("place"), *r6("x"))


@query(f"""WITH {EVT}, n AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS b_y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM evt {_WP}), f AS (SELECT *, sqrt(pow(bx - x, 2) + pow(b_y - y, 2)) AS fb, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS fn FROM n)
SELECT event_id, part::BIGINT AS part, round(CASE WHEN bx IS NULL OR nx IS NULL THEN x WHEN part = 0 THEN x + (bx - x) * coalesce(least(600 / nullif(fb, 0), 0.5), 0) ELSE x + (nx - x) * coalesce(least(600 / nullif(fn, 0), 0.5), 0) END, 3) AS x
FROM f, LATERAL (SELECT unnest(CASE WHEN bx IS NULL OR nx IS NULL THEN [0] ELSE [0, 1] END) AS part)""")
def path_bevel(s, d):
    return along.bevel(tables.event_paths(s, d), 600.0).select("event_id", "part", F.round("x", 3).alias("x"))


@query()
def path_stitch(s, d):
    p = tables.embedding_points(s, d).withColumn("path_id", F.floor(F.col("id") / 4)).withColumn("idx", F.col("id") % 4)
    return along.stitch(p.select("path_id", "idx", "x", "y", "z"), 0.4)


@query(f"""WITH {_EPA}, t AS (SELECT *, (coalesce(tx, x) - coalesce(lag(x) OVER w, x)) / 2 AS g FROM sg WINDOW w AS (PARTITION BY path_id ORDER BY idx)), u AS (SELECT *, lead(g) OVER (PARTITION BY path_id ORDER BY idx) AS h FROM t),
k AS (SELECT path_id, idx, i AS step, i / 3 AS s, x, tx, g, h FROM u, range(3) r(i) WHERE tx IS NOT NULL) SELECT path_id, idx, step::BIGINT AS step, round(x * (2*s*s*s - 3*s*s + 1) + g * (s*s*s - 2*s*s + s) + tx * (3*s*s - 2*s*s*s) + h * (s*s*s - s*s), 6) + 0.0 AS x FROM k""")
def create_spline(s, d):
    x = along.spline(tables.embedding_points(s, d).withColumnRenamed("dataset_id", "path_id"), 3)
    return x.select("path_id", "idx", "step", (F.round("x", 6) + 0.0).alias("x"))


@query(f"""WITH {_EPA}, c AS (SELECT path_id, idx, greatest(0, """ + ", ".join(f"least((-0.4 - {a}) / nullif(t{a} - {a}, 0), (0.4 - {a}) / nullif(t{a} - {a}, 0))" for a in "xyz") + ") AS e, least(1, " + ", ".join(f"greatest((-0.4 - {a}) / nullif(t{a} - {a}, 0), (0.4 - {a}) / nullif(t{a} - {a}, 0))" for a in "xyz") + ") AS l FROM sg WHERE tx IS NOT NULL) SELECT path_id, idx, round(e, 6) AS enter, round(l, 6) AS leave FROM c WHERE e <= l")
def path_bounds_intersection(s, d):
    return along.box_crossings(tables.embedding_points(s, d).withColumnRenamed("dataset_id", "path_id"), (-0.4,) * 3, (0.4,) * 3).select("path_id", "idx", *r6("enter", "leave"))


@query(f"WITH {_BOX} SELECT id, round(least(1 / (hx - lx), 2 / (hy - ly), 3 / (hz - lz)), 6) AS scale_x FROM box")
def staging_fitting(s, d):
    return along.fit(_boxes(s, d), (1.0, 2.0, 3.0)).select("id", *r6("scale_x"))


@query(f"WITH {PTS} SELECT id, round(z, 6) AS z FROM pts")
def flat_projection(s, d):
    return along.restore(along.flatten(tables.embedding_points(s, d))).select("id", *r6("z"))


@query(f"WITH {_KB} SELECT node, count(*) FILTER (p.x > 0) AS passing, round(count(*) FILTER (p.x > 0) / count(*), 6) AS share FROM kb JOIN pts p ON p.id = other GROUP BY node")
def sampler_test_neighbors(s, d):
    v = tables.embedding_points(s, d).select(F.col("id").alias("node"), F.col("x").alias("value"))
    return along.test_neighbours(_knn_edges(s, d), v, F.col("value") > 0).select("node", "passing", *r6("share"))


@query(f"WITH {_TG}, n AS (SELECT a.id, 1 - ({D2()}) / 0.16 AS w, b.y AS dx FROM pts a JOIN tg b ON {D2()} <= 0.16) SELECT id FROM n GROUP BY id HAVING sum(dx * w) > 0.2")
def filter_tensor_dot(s, d):
    a, b = _effectors(s, d)
    return fields.sample(a, b, 0.4).where(fields.dot((1.0, 0.0, 0.0)) > 0.2).select("id")


@query(f"WITH {_KE} SELECT src + r_regionkey * 1000000 AS src, dst + r_regionkey * 1000000 AS dst FROM ke, region")
def cluster_copy_to_points(s, d):
    k = T(s, d, "region").select((F.col("r_regionkey").cast("long") * 1_000_000).alias("k"))
    return _knn_edges(s, d).crossJoin(F.broadcast(k)).select((F.col("src") + F.col("k")).alias("src"), (F.col("dst") + F.col("k")).alias("dst"))  # one copy for each target is what this node makes


from . import extended  # noqa: E402, F401  (registers its queries)
