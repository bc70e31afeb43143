"""The taste prior kept up to date by a stream of reactions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.operators.select import boosted, judged
from salesignal.sources.readers import read_or_empty


def running_counts(events: DataFrame) -> DataFrame:
    """Totals by category since the stream began, for output mode update: a batch gives the categories that it changed."""
    return judged(events).groupBy("category").agg(F.count_if("good").alias("positive"), F.count_if("bad").alias("negative"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the table below path that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [re.fullmatch(r"version=(\d+)", f.getPath().getName()) for f in files.listStatus(root)]
    return sorted(int(m[1]) for m in found if m and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{m[0]}/_SUCCESS")))


def counts_at(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The totals of the last version (before a given one): a row a category."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], "category string, positive bigint, negative bigint")
    return read_or_empty(spark, f"{path}/version={known[-1]}", "category string, positive bigint, negative bigint")


def merge_into(path: str):
    """foreachBatch: the totals of a batch take the place of older ones of their categories, and all totals are written as the batch's version. Totals are absolute and a batch starts from the version before it, so a batch that is replayed writes the same again. The table has a row a category, few however many events."""

    def write(batch: DataFrame, batch_id: int) -> None:
        old = counts_at(batch.sparkSession, path, batch_id)
        rows = old.join(batch.select("category"), "category", "left_anti").unionByName(batch)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def current_prior(spark: SparkSession, path: str) -> DataFrame:
    """The prior as of the last batch."""
    return boosted(counts_at(spark, path))
