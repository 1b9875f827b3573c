"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, word_count

#: Words in a block, and in a shard of a source, about.
BLOCK, SHARD = 256, 1_000_000
#: So many sources are broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Targets of the rows (source, source_size) of a table with one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share share[0] / share[1] of all words. A
    target stops at `most` times its source's size; the excess is shared anew by weight until none is above: sources
    are sorted by cap / weight, and the first level that the rest can take is the common one.
    """
    every = Window.partitionBy()  # one row per source only
    order = every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = every.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    budget = F.col("total") * share[0] - F.col("capped") * share[1]  # times share[1]
    ranked = ranked.withColumn("free", F.col("weight") * budget <= F.col("cap") * F.col("rest") * share[1])
    ranked = ranked.withColumn("level", F.min(F.when(F.col("free"), F.struct("capped", -F.col("rest")))).over(every))
    left = F.col("total") * share[0] - F.col("level.capped") * share[1]
    shared = F.col("weight").cast("double") * left.cast("double") / (-F.col("level.col2") * share[1]).cast("double")
    free = F.col("level").isNotNull() & (F.col("capped") >= F.col("level.capped")) & (F.col("rest") <= -F.col("level.col2"))
    return ranked.select("source", "source_size", F.when(free, shared).otherwise(F.col("cap").cast("double")).alias("target"))


def sainte_lague(votes: DataFrame, by: list[str], seats: Column, vote: Column, name: str = "seats") -> DataFrame:
    """votes with a column of integer seats: `seats` of each group of `by` go to the highest quotients vote / (2 k + 1).

    A row's seats differ from its share by less than (rows of the group x share / seats) / 2 + 2, so only quotients in
    that window are ranked: the number of quotients is in proportion to the rows, not to the seats. Ties go to the
    smaller `tie` column.
    """
    whole = Window.partitionBy(*by)
    x = votes.withColumn("__n", seats).withColumn("__v", vote.cast("double"))
    x = x.withColumn("__all", F.sum("__v").over(whole)).withColumn("__rows", F.count(F.lit(1)).over(whole))
    x = x.withColumn("__share", F.when(F.col("__all") > 0, F.col("__n") * F.col("__v") / F.col("__all")).otherwise(F.lit(0.0)))
    span = F.ceil(F.when(F.col("__n") > 0, F.col("__share") * F.col("__rows") / (F.col("__n") * 2)).otherwise(F.lit(0.0))) + 2
    x = x.withColumn("__lo", F.greatest(F.lit(0).cast("long"), F.floor("__share") - span)).withColumn("__hi", F.floor("__share") + span)
    x = x.withColumn("__left", F.col("__n") - F.sum("__lo").over(whole))
    q = x.where("__v > 0").select(*by, "tie", "__left", "__v", F.explode(F.sequence("__lo", "__hi")).alias("__k"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("__v") / (2 * F.col("__k") + 1)).desc(), "tie", "__k"))
    won = q.withColumn("__r", rank).where(F.col("__r") <= F.col("__left")).groupBy(*by, "tie").agg(F.count(F.lit(1)).alias("__won"))
    a, b = x.alias("a"), won.alias("b")
    on = F.col("a.tie") == F.col("b.tie")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    keep = [F.col(f"a.{c}") for c in votes.columns]
    return a.join(b, on, "left").select(*keep, (F.col("a.__lo") + F.coalesce(F.col("b.__won"), F.lit(0))).alias(name))


def _number(hexes: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(hexes, start, n), 16, 10).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, seed: str = "mix-1", **kw) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken, and the plan of its shard.

    1. Sizes of rows and sources. Each source is cut into shards of about `shard` words, and at most about a tenth as
       many rows, by a hash of the id, so the largest source is as many groups as its size asks for.
    2. The mix has as many blocks of `block` words as all targets hold (rounded). Sainte-Laguë deals them to the sources
       by the quotients of their targets, and each source's blocks to its shards by their words. The words of a shard
       stand one after another in seeded order and are cut into blocks. A first whole pass takes each block once; the
       remaining quota is a systematic sample with a seeded start.
    3. A row's share is what the taken blocks hold of it, so no row gives more than two times its size.

    Null text has size 0 and is taken 0 times. A null source is a source of its own. Rows with the same id are taken
    in the order of their sizes. The result depends on rows and seed only.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    base = base.withColumn("hash", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    base = materialize(base)
    sizes = materialize(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    goal = targets(sizes, **kw).withColumn("tag", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("tie", F.col("tag"))
    due = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")  # one row per source only
    goal = sainte_lague(goal.withColumn("__due", due), [], F.col("__due"), F.col("target"), "due").drop("__due", "tie")
    rows_of = sizes.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("tag"), "source_rows")
    many = F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("source_rows") * 10 / shard), F.lit(1).cast("long"))
    goal = materialize(goal.join(rows_of, "tag").withColumn("shards", many).drop("source_rows"))
    base = base.withColumn("tag", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    if goal.count() <= FEW_SOURCES:
        goal = F.broadcast(goal)  # else a shuffled join, whose hot keys adaptive execution splits
    rows = base.drop("source").join(goal, "tag").withColumn("shard", F.pmod(_number(F.col("hash"), 1, 8), F.col("shards")))
    parts = rows.groupBy("tag", "shard").agg(F.sum("size").alias("words"), F.first("due").alias("due"))
    parts = parts.withColumn("tie", F.col("shard"))
    parts = sainte_lague(parts, ["tag"], F.col("due"), F.col("words"), "quota")
    parts = parts.withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("quota", F.least("quota", F.col("blocks") * 2))
    parts = parts.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    parts = parts.withColumn("extra", F.col("quota") - F.col("passes") * F.col("blocks"))
    turn = F.md5(F.concat_ws("|", F.lit(seed), "tag", F.col("shard").cast("string")))
    parts = parts.withColumn("turn", F.when(F.col("blocks") > 0, F.pmod(_number(turn, 1, 8), F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    rows = rows.join(parts.select("tag", "shard", "blocks", "passes", "extra", "turn"), ["tag", "shard"])
    line = Window.partitionBy("tag", "shard").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size")).withColumn("block", F.lit(block).cast("long"))
    taken = F.col("passes") * F.col("size") + words_before(F.col("end")) - words_before(F.col("start"))
    return rows.withColumn("taken", taken)


def blocks_before(b: Column) -> Column:
    """How many of the first b blocks the systematic sample holds: `extra` of `blocks`, from `turn` on."""
    at = (b * F.col("extra") + F.col("turn")).cast("long")
    return F.when(F.col("blocks") > 0, F.floor(at / F.col("blocks"))).otherwise(F.lit(0).cast("long"))


def words_before(x: Column) -> Column:
    """How many of a shard's first x words the sampled blocks hold."""
    b = F.floor(x / F.col("block"))
    here = blocks_before(b)
    return here * F.col("block") + (blocks_before(b + 1) - here) * (x - b * F.col("block"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars", **kw) -> DataFrame:
    """The rows of the mix, with the columns of docs: whole passes repeat a row as it is, and a sampled part of it is
    one more row whose text is the words taken, joined by single spaces; count_col is set to its length.

    Rows are joined to the plan by id, source and size; rows that agree in all three are mixed alike.
    """
    chosen = plan(docs, id_col, text_col, source_col, **kw)
    chosen = chosen.groupBy("doc_id", "source", "size").agg(*[F.first(c).alias(c) for c in ("start", "end", "block", "blocks", "passes", "extra", "turn", "taken")])
    x = docs.withColumn("__size", word_count(F.col(text_col))).alias("x")
    on = F.col(f"x.{id_col}").eqNullSafe(F.col("p.doc_id")) & F.col(f"x.{source_col}").eqNullSafe(F.col("p.source")) & (F.col("x.__size") == F.col("p.size"))
    own = [F.col(f"x.{c}").alias(c) for c in docs.columns]
    mixed = x.join(chosen.alias("p"), on).select(*own, *[F.col(f"p.{c}").alias(f"__{c}") for c in ("start", "block", "blocks", "passes", "extra", "turn", "taken", "size")])
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    block_of = lambda i: F.floor((F.col("__start") + i) / F.col("__block"))
    before = lambda b: F.floor((b * F.col("__extra") + F.col("__turn")) / F.col("__blocks"))
    part = F.array_join(F.filter(words, lambda w, i: before(block_of(i) + 1) > before(block_of(i))), " ")
    none = F.array().cast("array<struct<text:string,part:boolean>>")
    copy = lambda text, is_part: F.struct(text.alias("text"), F.lit(is_part).alias("part"))
    whole = F.when(F.col("__size") > 0, F.array_repeat(copy(F.col(text_col), False), F.col("__passes").cast("int"))).otherwise(none)
    rest = F.when(F.col("__taken") > F.col("__passes") * F.col("__size"), F.array(copy(part, True))).otherwise(none)
    # One join and one explode: a text is shuffled once, whether it is taken whole, in part, or both.
    out = mixed.where("__taken > 0").withColumn("__new", F.explode(F.concat(whole, rest)))
    new = {text_col: F.col("__new.text")}
    if count_col in docs.columns:
        new[count_col] = F.when(F.col("__new.part"), F.length("__new.text").cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col))
    return out.withColumns(new).select(*docs.columns)


QUERY_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, (SELECT sum(source_size)::BIGINT FROM s) AS total FROM r),
-- A set of capped sources: those at or below a ratio of cap to weight. The common level is of the first set that holds all it must.
l AS (
  SELECT a.cap / a.weight AS ratio, a.total, coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)::BIGINT AS capped,
         coalesce(sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight), 0)::BIGINT AS rest
  FROM c a, c b GROUP BY a.source, a.cap, a.weight, a.total),
f AS (SELECT * FROM l WHERE ratio * rest * 2 >= 3 * total - 2 * capped ORDER BY ratio LIMIT 1),
t AS (
  SELECT c.source, c.source_size, CASE WHEN c.cap / c.weight >= f.ratio
         THEN c.weight::DOUBLE * (3 * f.total - 2 * f.capped)::DOUBLE / (f.rest * 2)::DOUBLE ELSE c.cap::DOUBLE END AS target,
         greatest(1, ceil(c.source_size / 1000000), ceil(c.source_rows * 10 / 1000000))::BIGINT AS shards, coalesce('s' || c.source, 'n') AS tag
  FROM c LEFT JOIN f ON true),
x AS (
  SELECT d.*, t.source_size, t.target, t.tag, ('0x' || substr(d.hash, 1, 8))::BIGINT % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- All blocks are dealt to the sources by plain highest quotients of their targets.
z AS (SELECT round(sum(target) / 256)::BIGINT AS n FROM t),
y AS (SELECT tag, target / (2 * k + 1) AS quotient, k, n FROM t, z, LATERAL (SELECT unnest(range(n + 1)) AS k) WHERE target > 0),
u AS (SELECT tag, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, tag, k) AS i FROM y) WHERE i <= n GROUP BY tag),
p AS (SELECT x.tag, shard, sum(size)::BIGINT AS words, coalesce(first(u.seats), 0)::BIGINT AS seats FROM x LEFT JOIN u ON x.tag = u.tag GROUP BY x.tag, shard),
-- Plain highest quotients, one for each seat that a shard could get.
q AS (SELECT tag, shard, seats, words::DOUBLE / (2 * k + 1) AS quotient, k FROM p, LATERAL (SELECT unnest(range(seats + 1)) AS k) WHERE words > 0),
w AS (SELECT tag, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY quotient DESC, shard, k) AS n FROM q) WHERE n <= seats GROUP BY tag, shard),
b AS (
  SELECT p.tag, p.shard, ceil(words / 256)::BIGINT AS blocks, least(coalesce(quota, 0), 2 * ceil(words / 256)::BIGINT) AS quota
  FROM p LEFT JOIN w ON p.tag = w.tag AND p.shard = w.shard),
g AS (
  SELECT tag, shard, blocks, quota // greatest(blocks, 1) AS passes, quota % greatest(blocks, 1) AS extra,
         ('0x' || substr(md5('mix-1|' || tag || '|' || shard), 1, 8))::BIGINT % greatest(blocks, 1) AS turn
  FROM b),
o AS (
  SELECT x.doc_id, size, source_size, target, passes, extra, turn, greatest(blocks, 1) AS blocks,
         sum(size) OVER (PARTITION BY x.tag, x.shard ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM x JOIN g ON x.tag = g.tag AND x.shard = g.shard),
-- Blocks that a row touches, with the words it has in each.
k AS (SELECT *, e - size AS s FROM o),
v AS (
  SELECT doc_id, size, source_size, target, passes * size + CASE WHEN size = 0 THEN 0 ELSE
         coalesce(list_sum(list_transform(range(s // 256, (e - 1) // 256 + 1), lambda j :
           CASE WHEN ((j + 1) * extra + turn) // blocks > (j * extra + turn) // blocks
                THEN least(e, (j + 1) * 256) - greatest(s, j * 256) ELSE 0 END)), 0) END AS taken
  FROM k)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM v
"""
