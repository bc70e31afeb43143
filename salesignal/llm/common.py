"""Helpers shared by the training-data operators: tables, shared working tables, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest table, in bytes of its rows, that an operator sends to every executor.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where that is unset, a temporary folder on one machine (master local), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="salesignal-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_delete, spark, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/salesignal/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter; the folder's owner clears it then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, so a lost executor costs no recomputation, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body names it (inlining it into a lambda would compute it for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doc_key_crc(doc_id: Column) -> Column:
    """crc32 of doc_id written as text; the folds of the labelled operators."""
    return F.crc32(doc_id.cast("string"))


def size_within(df: DataFrame, bytes_of: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, measured by one aggregate, hold at most limit bytes."""
    return (df.agg(F.sum(bytes_of)).first()[0] or 0) <= limit


#: A key with more than this share of all rows is hot, with FEW rows at least: so there are 20,000 hot keys at most.
HOT, FEW = 20_000, 400


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has a row for each key and `_n`, the number of rows with it. total: the number of rows.

    The rows of a hot key are dealt over as many tasks as they fill, by a hash of their other columns, and the key's group goes to each of these. The list of hot keys, HOT at most, is broadcast, so keys are to be small; all else is shuffled by key.
    """
    limit = max(FEW, -(-total // HOT))
    hot = F.broadcast(groups.filter(F.col("_n") > limit).select(*keys, F.col("_n").alias("_hot")))
    return dealt_join(rows.join(hot, keys, "left"), groups, keys, F.coalesce("_hot", F.lit(0)), total, how).drop("_hot")


def dealt_join(rows: DataFrame, groups: DataFrame, keys: list[str], n: Column, total: int, how: str = "inner") -> DataFrame:
    """salted_join for rows that know by themselves (n) how many of them share their key, if these are many."""
    limit = max(FEW, -(-total // HOT))
    others = [F.col(c) for c in rows.columns if c not in keys] or [F.lit(0)]
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.greatest(F.lit(1), F.ceil(n / limit))).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("_n") / limit)).cast("int") - 1))).drop("_n")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType], drop: tuple[str, ...] = ()) -> T.StructType:
    names = {n for n, _ in fields} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, k) for n, k in fields])
