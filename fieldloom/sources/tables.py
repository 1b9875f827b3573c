"""Adapters from plain tables to the data model: points (dataset_id, idx, x, y, z), paths, graphs and tag catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compare import col

#: Rows of a task that holds them in a hash table (some 100 bytes each).
ROWS = 1 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(df: DataFrame, dataset, order: list, x, y=0.0, z=0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table of points: dataset_id, idx (0-based in `order` within its dataset), x, y, z and the columns kept."""
    w = Window.partitionBy("dataset_id").orderBy(*order)
    coords = {a: col(v).cast("double") for a, v in (("x", x), ("y", y), ("z", z))}
    out = df.withColumn("dataset_id", col(dataset).cast("string")).withColumns(coords)
    return out.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).select("dataset_id", "idx", "x", "y", "z", *keep)


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    """The first three dimensions of embeddings as points, a dataset for each label; `id` is vec_id."""
    e = read(spark, folder, "embeddings").withColumn("id", F.col("vec_id"))
    at = lambda i: F.element_at("embedding", i).cast("double")
    return points(e, F.col("label"), ["vec_id"], at(1), at(2), at(3), keep=("id",))


def event_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one open path per user: x is seconds since the epoch, y the value, in the order of time and id."""
    e = read(spark, folder, "events")
    return points(e, F.col("user_id"), ["ts", "event_id"], F.unix_timestamp("ts"), F.col("value"), keep=("event_id", "event_type")).withColumnRenamed("dataset_id", "path_id")


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows of a table that is counted, at most about ROWS of it in a task. Adaptive execution would join partitions
    until there is one for each core, whose hash table grows with the input."""
    parts = -(-df.count() // ROWS)
    return (df.repartition(parts, *df.columns) if parts > df.sparkSession.sparkContext.defaultParallelism else df).distinct()


def supply_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct supplier-part edges of lineitem: src 's' + key, dst 'p' + key."""
    li = distinct(read(spark, folder, "lineitem").select("l_suppkey", "l_partkey"))
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def place_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of regions, nations, suppliers and customers as named vertices."""
    nation, supplier, customer = (read(spark, folder, t) for t in ("nation", "supplier", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
        .union(supplier.select(name("n", "s_nationkey"), name("s", "s_suppkey")))
        .union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    )


def event_tags(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog of datasets (users) with their tags (event types) and a map of counts."""
    e = read(spark, folder, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("user_id").cast("string").alias("dataset_id")).agg(
        F.array_sort(F.collect_set("event_type")).alias("tags"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.col("n").cast("string"))))).alias("tag_values")
    )
