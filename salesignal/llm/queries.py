"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.llm.common import doc_key_crc, table
from salesignal.llm.decontaminate import decontamination
from salesignal.llm.exact_dedup import exact_dedup
from salesignal.llm.filter_audit import document_audit
from salesignal.llm.importance import importance_draw
from salesignal.llm.language import language_id
from salesignal.llm.line_dedup import line_dedup
from salesignal.llm.lm import lm_scores
from salesignal.llm.mixing import DOMAINS, mixed_rates
from salesignal.llm.ngram_join import ngram_join
from salesignal.llm.secrets import KINDS, joined, secret_scan
from salesignal.llm.sharding import shard_documents
from salesignal.llm.toxicity import in_training, toxicity
from salesignal.llm.warc import archived_pages


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"), least_bytes=0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), in_training(folds=5, held=0))
    held_out = F.coalesce(doc_key_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    score = F.col("toxicity")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxic_hits").alias("hits"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(doc_key_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    found = language_id(docs, doc_key_crc(F.col("doc_id")) % 4 != 2)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.octet_length("text").cast("long").alias("clean_bytes"), F.sha2(F.col("text"), 256).alias("clean_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates.select("doc_id", "tokens", "domain", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", *[F.col("residual")[i].alias(f"missed_{d}") for i, d in enumerate(DOMAINS)])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), num=10, den=100, least_words=20, ngrams=(1, 1), buckets=10_000, seed="2024")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = doc_key_crc(F.col("doc_id")) % 7
    scores = lm_scores(table(spark, sf_dir, "documents"), fold != 2)
    return scores.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
