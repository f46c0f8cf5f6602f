"""The corpus pipeline: five stages from raw documents to a mix, each written and read again before the next.

quality: documents scoring under the threshold go. simhash: one document of each group of
near-duplicates stays (candidates by op2's fingerprints and, as 4 bits reach only nearly equal texts, by minimum hashes; verified
similarity of 0.8 or more on five-word shingles). decontaminate:
documents with benchmark passages go. pii: personal data inside the texts is replaced. mix: documents get the words that the mix
takes from them; those that it takes nothing from go. Each stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremolite.llm import cnn_quality, decontaminate, mixing, pii, shingles
from tremolite.llm.common import set_aside, table
from tremolite.operators.sinks import scratch


def _aside(stage):
    """The stage sees doc_id, text and source under their names and all other columns under neutral ones."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, back = set_aside(docs, ("doc_id", "text", "source"))
        return back(stage(spark, plain, sf_dir))
    return run


@_aside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = cnn_quality.train(docs, table(spark, sf_dir, "labels"))
    return cnn_quality.score(docs, net).where(F.col("_quality") >= cnn_quality.THRESHOLD).select(*docs.columns)


@_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.survivors(docs)


@_aside
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).where(~F.col("_bench_bad")).select(*docs.columns)


@_aside
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).select(*docs.columns)


@_aside
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).taken().where(F.col("_mix_taken") > 0)
    return taken.select(*docs.columns, F.col("_mix_size").alias("mix_size"), F.col("_mix_source_size").alias("mix_source_size"),
                        F.col("_mix_target").alias("mix_target"), F.col("_mix_taken").alias("mix_taken"))


STAGES = [("quality", quality), ("simhash", near_duplicates), ("decontaminate", decontamination), ("pii", personal_data), ("mix", mix)]
# Scores of a fitted network, fingerprints and permutations have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
