"""Exact dedup by 128-bit content hash, with a byte comparison inside groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, squeeze_spaces


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of ASCII white space became one space. They are grouped by
    MD5; the least and the greatest text of each group are compared, so a group of different texts shows, and only
    such groups are grouped again by the text itself. Both bounds and counts are formed before the shuffle, so a text
    that a third of all rows hold sends one row from each task.

    Null text is the empty text. A null id is larger than any other, and stays only in a group without other ids. Rows
    that repeat the id that stays are all kept. An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), squeeze_spaces(F.col(text_col)).alias("norm")).withColumn("key", F.unhex(F.md5("norm")))
    groups = materialize(
        base.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"), (F.min("norm") != F.max("norm")).alias("clash"))
    )
    keyed = base.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    out = keyed.join(groups.where(~F.col("clash")), "key")
    if groups.where("clash").limit(1).count():
        mixed = base.join(groups.where("clash").select("key"), "key", "left_semi")
        inner = mixed.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
        again = mixed.withColumn("text_sha256", F.sha2("norm", 256)).join(inner, ["key", "norm"])
        out = out.drop("clash").unionByName(again.drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of equal texts: the one with the smallest id.

    A repeated id keeps its rows whose text stays. Null ids are compared as values.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = docs.withColumn("__own", F.sha2(squeeze_spaces(F.col(text_col)), 256))
    return keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__own"] == kept["__sha"]), "left_semi").drop("__own")
