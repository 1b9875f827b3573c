"""URL filtering by association rules that FP-growth mines from labelled pages. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (verdict, host and path prefix) of the curated rules.
CURATED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, last two labels, path segments (# for those with digits), query keys, fragment."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    keys = F.filter(F.split(rest, "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit("")))),
            F.transform(labels, lambda x: F.concat(F.lit("label="), x)),
            F.array(F.concat(F.lit("domain="), F.substring_index("host", ".", -2))),
            F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), F.lit("segment=#")).otherwise(F.concat(F.lit("segment="), lower_ascii(x)))),
            F.transform(keys, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1))),
            F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, min_support: float = 0.001, min_count: int = 5, min_lift: float = 1.25) -> DataFrame:
    """Rules (rule_id, antecedent, token) for bad pages from rows (tokens, bad), each with the token that it is indexed by.

    FP-growth finds the token sets of at least min_count bad pages and min_support of all; a rule is a set of any number
    of tokens whose share of bad pages (its confidence) is min_lift times that of all pages or more. A rule that holds
    all tokens of another one is left out, as it blocks nothing more. As each page has few tokens, the support bounds the
    number of rules: it doesn't grow with the pages.
    """
    from pyspark.ml.fpm import FPGrowth

    n, bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if bad < min_count:
        return labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, token string")
    items = labelled.select(F.concat("tokens", F.array(F.when(F.col("bad"), F.lit("bad")).otherwise(F.lit("good")))).alias("items"))
    # half a page below the count wanted, so that rounding in the product can't ask for one more
    support = max(min_support, (min_count - 0.5) / n)
    rules = FPGrowth(minSupport=support, minConfidence=min(1.0, min_lift * (bad / n))).fit(items).associationRules
    rules = rules.where(F.element_at("consequent", 1) == "bad").select(F.array_sort("antecedent").alias("antecedent"))
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("antecedent")))
    kept = rules.where(F.size("antecedent") == 1).select("rule_id", "antecedent")
    size = F.size("antecedent")
    part = rules.where(size > 1).select("rule_id", "antecedent", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(antecedent)) - 2"))).alias("mask"))
    part = part.select("rule_id", F.xxhash64(F.filter("antecedent", lambda x, i: F.getbit(F.col("mask"), i) == 1)).alias("less"))
    more = part.join(rules.select(F.col("rule_id").alias("less")), "less", "left_semi").select("rule_id").distinct()
    kept = kept.union(rules.where(size > 1).select("rule_id", "antecedent").join(more, "rule_id", "left_anti"))
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = kept.select("rule_id", F.explode("antecedent").alias("token")).join(seen, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("least"))
    return materialize(kept.join(rare, "rule_id").select("rule_id", "antecedent", "least.token"))


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (url) of rows that hold every token of some rule: an inverted index has each rule at its rarest token."""
    held = pages.select("url", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
    return held.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def curated(rules=CURATED) -> Column:
    """The longest rule that fits host and path, as a struct (rule, verdict), or null: one expression over a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=CURATED, **mining) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict.

    A page is labelled by the first number of its path, which names a document of labels. Mined rules block a URL
    that they match; a curated rule that fits overrides them. A null URL, or one without ://, has empty host and path
    and is allowed unless its few tokens match. Repeated rows are judged alike; a null quality is no label.
    """
    x = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    x = x.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    urls = materialize(x.where("url is not null").groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", tokens(F.col("url"))))
    known = urls.withColumn("doc_id", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)"))
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialize(known.where("doc_id is not null").join(quality, "doc_id").select("tokens", (F.col("quality") == 0).alias("bad")))
    hit = matches(urls, mine(labelled, **mining)).withColumn("hit", F.lit(True))
    out = x.join(hit, "url", "left").withColumn("fit", curated(rules))
    method = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"))


QUERY_SQL = """
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (
  SELECT url, path, unnest(list_distinct(
    ['scheme=' || translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     'domain=' || array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')]
    || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'label=' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
         CASE WHEN regexp_matches(x, '[0-9]') THEN 'segment=#' ELSE 'segment=' || translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END)
    || list_transform(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'key=' || string_split(x, '=')[1])
    || CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END)) AS token
  FROM (SELECT DISTINCT url, host, path FROM u WHERE url IS NOT NULL)),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
t AS (
  SELECT k.url, list_sort(list(token)) AS tokens, any_value(quality) = 0 AS bad
  FROM k JOIN l ON l.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) GROUP BY k.url),
n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS b FROM t),
-- Every set of tokens of every labelled page.
x AS (SELECT list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS part, bad FROM t, LATERAL (SELECT unnest(range(1, (1 << len(tokens))::BIGINT)) AS mask)),
r AS (
  SELECT part FROM (SELECT part, count(*) AS c, count(*) FILTER (bad) AS g FROM x GROUP BY part), n
  WHERE g >= greatest(5, ceil(0.001 * n)) AND g::DOUBLE / c >= 1.25::DOUBLE * (b::DOUBLE / n)),
w AS (SELECT url, list(token) AS tokens FROM k GROUP BY url),
h AS (SELECT DISTINCT url FROM w, r WHERE list_has_all(tokens, part))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN url IN (SELECT url FROM h) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE rule WHEN 'example.com/en/7' THEN 'allow' WHEN 'net/de/' THEN 'allow' WHEN 'com/en/' THEN 'block' WHEN 'example.net/de/8' THEN 'block' WHEN 'org/es/' THEN 'block' END AS verdict
  FROM u)
"""
