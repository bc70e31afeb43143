"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input. Counted as part of salesignal.llm.

Every stage keeps null and empty texts and texts of any length like others, and rows whose doc_id is null (they are in no list of rows that go). Rows that repeat a doc_id share a fate where it is decided by doc_id: in the n-gram join, decontamination and mixing. An empty table gives an empty one; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.llm.common import new_path, table
from salesignal.llm.decontaminate import decontaminated
from salesignal.llm.mixing import mixed
from salesignal.llm.ngram_join import ngram_join
from salesignal.llm.sharding import shard_documents
from salesignal.llm.toxicity import in_training, toxicity

#: Share of tokens by domain (high, low, toxic), at most. High-quality documents anchor the budget: they all stay, the rest is thinned to its share; of a domain that holds less, as the toxic one after the first stage, all stay.
TARGETS = (0.95, 0.04, 0.01)
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity(docs, table(spark, sf_dir, "labels"), in_training()).filter("toxicity < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at five words and 0.8, the one with the smallest doc_id stays."""
    gone = ngram_join(docs, k=5, num=80, den=100).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that bring the domains' tokens to TARGETS."""
    return mixed(docs, table(spark, sf_dir, "labels"), TARGETS, anchor=0, at_most=True).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, SHARDS).select(*docs.columns, "shard", "slot", "grown_shard")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: Learned scores and iterative fits have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
