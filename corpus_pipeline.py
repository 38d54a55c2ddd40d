"""Documents to packed training sequences, in stages that each keep what the last one left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm import jaccard_join, mixing, quality, queries, substring_dedup
from lintmill.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, prior = quality.train(docs, labels, queries.remainder("doc_id", 3) == 1)
    return quality.score(docs, model, prior).filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar word shingles link."""
    return jaccard_join.one_per_component(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word sequences that occur elsewhere too."""
    return _documents(substring_dedup.remove_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights of the sources take, repeats as rows of their own."""
    mixed = mixing.mix_sources(docs, mixing.word_count("text"), F.xxhash64("text"))
    return _documents(mixing.mixed_texts(mixed))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return queries.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Recompression, hashes and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
