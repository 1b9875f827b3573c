"""The corpus pipeline: from documents to encoded training text.

Each stage works on all that the one before kept and, but for the last, returns the columns of documents. Rejected by the
classifier, repeated, nearly repeated and unmixed documents go; a document that the mix takes more than once comes as
several rows, and one that it takes in part with the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import exact_dedup, mixing, ngram_join, quality_rules, unigram
from fieldloom.llm.common import discard, store

#: The classifier's rules and weights are no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier predicts to be good."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_rules.score(docs, model, carry=tuple(docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, four fifths in common."""
    return ngram_join.drop_near(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes of each source."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's text and ids, digests of these and of the text they decode to, with the row's source and number of tokens."""
    return unigram.encode_decode(docs, carry=("source",), whole=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. Each other stage is written to the shared folder and read again; what a
    stage has read is removed once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = store(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
