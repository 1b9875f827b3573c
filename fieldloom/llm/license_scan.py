"""License scans by diagonal voting over word k-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Between words stands all of ASCII but letters and digits; listed one by one, as the regular expression engine looks
#: single characters up in a table. Texts are lower-cased before.
GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() or chr(c).isupper()) + "]+"
#: The one code point beyond ASCII whose lower case is a letter of ASCII alone, and a stand-in that is none.
KELVIN, OTHER = "\u212a", "\u0137"
#: (label, phrase) that count wherever their words stand consecutively.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, text) that may differ a little where they occur.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "copyright all rights reserved"),
)


def template_grams(spark, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Word 2-grams of the templates: w0, w1, template, tpos, total, label, exact. The list is a parameter of some dozens of lines."""
    rows = []
    for k, (label, text) in enumerate([*base, *templates]):
        words = text.split()
        if not text.isascii() or text != text.lower():
            raise ValueError("templates are lower case ASCII")
        if not 2 <= len(words) <= 60:
            raise ValueError("a template has 2 to 60 words")
        rows += [(a, b, k, i, len(words) - 1, label, k < len(base)) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "w0 string, w1 string, template int, tpos int, total int, label string, exact boolean")


def split_words(text: Column) -> Column:
    """Lower-cased words of a text; their ASCII letters are those that lower-casing A-Z alone gives."""
    parts = F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))), GAP)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def diagonals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **lists) -> DataFrame:
    """Votes (row, doc_id, template, label, exact, total, diagonal, mask, first, last), and for each row of docs a vote
    without template that has its number of words, n_words. One pass over the texts, checkpointed, which numbers the rows.

    Every rolling 2-gram of words is joined by its hash to the templates' positions; a hash match counts only if the
    words agree. A match votes for the diagonal word position - template position; mask has the template positions.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), split_words(F.col(text_col)).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    # The pair at the end has no second word; a pair of nothing is put before it all, and carries the number of words.
    pairs = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("a"), F.size("words").cast("string").alias("b"))), pairs)
    rolling = words.select("row", "doc_id", F.posexplode(pairs).alias("at", "gram")).select("row", "doc_id", (F.col("at") - 1).alias("dpos"), "gram.a", "gram.b")
    rolling = rolling.withColumn("hash", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.xxhash64("a", "b")))
    grams = template_grams(docs.sparkSession, **lists).withColumn("hash", F.xxhash64("w0", "w1"))
    hits = rolling.join(F.broadcast(grams), (rolling["hash"] == grams["hash"]) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")), "left")
    hits = hits.where("template is not null or dpos < 0")
    votes = hits.groupBy("row", "doc_id", "template", "label", "exact", "total", (F.col("dpos") - F.coalesce("tpos", F.lit(0))).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.min("dpos").alias("first"),
        F.sum(F.when(F.col("dpos") < 0, F.col("b").cast("long"))).alias("n_words"), F.max("dpos").alias("last"),
    )
    return materialize(votes)


def spans_of(votes: DataFrame, gap: int = 2, coverage: float = 0.8) -> DataFrame:
    """Verified spans of votes: row, doc_id, template, label, exact, start (word), coverage.

    An exact phrase needs all its 2-grams on one diagonal. Of other templates, diagonals up to `gap` apart merge; the
    merged span holds if it has `coverage` of the template's 2-grams within 1.5 times its length, and if no other of more
    coverage begins at most `gap` words away.
    """
    exact = votes.where("exact and bit_count(mask) = total").select("row", "doc_id", "template", "label", "exact", F.col("first").alias("start"), F.lit(1.0).alias("coverage"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    loose = votes.where("not exact").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > gap).cast("long"), F.lit(0).cast("long")))
    loose = loose.withColumn("cluster", F.sum("new").over(line))
    loose = loose.groupBy("row", "doc_id", "template", "label", "exact", "total", "cluster").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("start"), F.max("last").alias("last"))
    loose = loose.withColumn("coverage", F.bit_count("mask") / F.col("total"))
    loose = loose.where((F.col("coverage") >= coverage) & ((F.col("last") - F.col("start") + 1) * 2 <= F.col("total") * 3))
    around = Window.partitionBy("row").orderBy("start").rangeBetween(-gap, gap)
    loose = loose.withColumn("most", F.max("coverage").over(around)).where("coverage >= most")
    return exact.unionByName(loose.select(*exact.columns))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, coverage: float = 0.8, **lists) -> DataFrame:
    """Verified spans of all texts, with a number `row` of the text's row; null and empty texts have none."""
    return spans_of(diagonals(docs, id_col, text_col, **lists), gap, coverage)


def joined(labels: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, coverage: float = 0.8, **lists) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest coverage of a verified span, or 0. A null text counts as empty: no words, null first and
    last word, empty labels. Rows with equal or null ids are judged each for itself.
    """
    votes = diagonals(docs, id_col, text_col, **lists)
    found = spans_of(votes, gap, coverage).groupBy("row").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    a, b = votes.where("template is null").select("row", "doc_id", "n_words").alias("a"), found.alias("b")
    return a.join(b, F.col("a.row") == F.col("b.row"), "left").select(
        "a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query_sql(base=BASE, templates=TEMPLATES) -> str:
    listed = ", ".join(f"({k}, '{label}', string_split('{text}', ' '), {str(k < len(base)).lower()})" for k, (label, text) in enumerate([*base, *templates]))
    return f"""
WITH t(template, label, words, exact) AS (VALUES {listed}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words) - 1)) AS i FROM d WHERE len(words) > 1),
x AS (
  SELECT DISTINCT p.doc_id, t.template, p.i, j - 1 AS j
  FROM p, t, LATERAL (SELECT unnest(range(1, len(t.words))) AS j)
  WHERE list_contains(t.words, p.words[p.i + 1]) AND p.words[p.i + 1] = t.words[j] AND p.words[p.i + 2] = t.words[j + 1]),
g AS (SELECT doc_id, template, i - j AS diagonal, count(DISTINCT j) AS n, min(i) AS lo, max(i) AS hi, list(j) AS js FROM x GROUP BY ALL),
e AS (SELECT g.doc_id, t.label, true AS exact, lo AS start, 1.0::DOUBLE AS cover FROM g JOIN t USING (template) WHERE t.exact AND n = len(t.words) - 1),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM (
  SELECT g.*, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2 THEN 1 ELSE 0 END AS fresh FROM g)),
c AS (SELECT doc_id, template, cluster, len(list_distinct(flatten(list(js)))) AS n, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY ALL),
h AS (
  SELECT c.doc_id, t.label, false AS exact, lo AS start, n::DOUBLE / (len(t.words) - 1) AS cover FROM c JOIN t USING (template)
  WHERE NOT t.exact AND n::DOUBLE / (len(t.words) - 1) >= 0.8 AND (hi - lo + 1) * 2 <= (len(t.words) - 1) * 3),
f AS (
  SELECT * FROM e UNION ALL SELECT doc_id, label, exact, start, cover FROM (
    SELECT *, max(cover) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS most FROM h) WHERE cover >= most),
s AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id)
"""
