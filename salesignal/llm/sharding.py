"""Sharding by jump consistent hashing (Lamping and Veach, 2014), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.llm.common import let

# The generator of the published algorithm: key = key * 2862933555777941757 + 1, modulo 2**64.
MULTIPLIER = 2862933555777941757
LOW = (1 << 21) - 1
HIGH = (1 << 22) - 1
C0, C1, C2 = MULTIPLIER & LOW, MULTIPLIER >> 21 & LOW, MULTIPLIER >> 42


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 in limbs of 21, 21 and 22 bits, so that no product passes 2**63 (ANSI arithmetic raises there)."""
    a0 = key.bitwiseAND(F.lit(LOW))
    a1 = F.shiftrightunsigned(key, 21).bitwiseAND(F.lit(LOW))
    a2 = F.shiftrightunsigned(key, 42)
    r0 = a0 * C0 + 1
    r1 = a0 * C1 + a1 * C0 + F.shiftright(r0, 21)
    top = F.shiftleft((a1 * C2 + a2 * C1).bitwiseAND(F.lit(1).cast("long")), 21)  # of the products at 2**63 only the last bit counts
    r2 = a0 * C2 + a1 * C1 + a2 * C0 + F.shiftright(r1, 21) + top
    low = r0.bitwiseAND(F.lit(LOW))
    mid = F.shiftleft(r1.bitwiseAND(F.lit(LOW)), 21)
    return low.bitwiseOR(mid).bitwiseOR(F.shiftleft(r2.bitwiseAND(F.lit(HIGH)), 42))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1. A null key gives shard 0.

    Each step draws the next shard count at which the key would move; the last draw below the count is the shard. Draws grow by one at least, so `shards` steps always suffice, and a row whose draw has passed the count is left as it is.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def step(state: Column, _: Column) -> Column:
        def moved(key: Column) -> Column:
            unit = (F.shiftrightunsigned(key, 33) + 1).cast("double")
            draw = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / unit)).cast("long")
            return F.struct(key.alias("key"), state["j"].alias("b"), draw.alias("j"))

        return F.when(state["j"] < shards, let(_next_key(state["key"]), moved)).otherwise(state)

    # the first step gives b = 0: state.j is 0 then, as the published loop starts with j = 0
    def first(key: Column) -> Column:
        unit = (F.shiftrightunsigned(key, 33) + 1).cast("double")
        return F.struct(key.alias("key"), F.lit(0).cast("long").alias("b"), F.floor(F.lit(float(1 << 31)) / unit).cast("long").alias("j"))

    start = let(_next_key(key.cast("long")), first)
    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.coalesce(F.aggregate(steps, start, step)["b"], F.lit(0)).cast("int")


def stable_key(column: Column, data_type: str) -> Column:
    """Whole numbers are their own key; other values are hashed to 64 bits."""
    return column.cast("long") if data_type in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column)


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 200_000) -> DataFrame:
    """Every row of docs with `shard`, `grown_shard` (with one shard more), `slot`, `size` and `text_crc32`.

    The law is `key`: the key's value and the number of shards decide, nothing else, so rows move only into an added shard, and in the expected fraction 1 / (shards + 1). `slot` numbers the rows of a shard from 0 without gaps. No task sees a whole shard: rows are numbered within (shard, bucket of the key's hash), and the buckets' counts, a few bytes each, give the offsets. `size` is the text's UTF-8 bytes plus 1.

    Null keys go to shard 0, null texts count as no bytes (crc32 0), repeated rows each get a slot of their own; inside a bucket rows are ordered by key, crc32 and size. Buckets are cut by key and text, so rows that share a key, or have none, are spread as well. An empty table gives an empty table. Columns of docs named like the results are replaced; all others are kept.
    """
    kind = dict(docs.dtypes)[key]
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with those below
    own, body = F.col(private[key]), F.coalesce(F.col(private[text]).cast("string"), F.lit(""))
    k = stable_key(own, kind)
    buckets = max(1, -(-docs.count() // (rows_per_bucket * shards)))
    new = {"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body)}
    rows = docs.toDF(*private.values()).withColumns(new).withColumn("bucket", F.pmod(F.xxhash64(own, "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy(own, "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(offsets, ["shard", "bucket"])
    others = [F.col(i).alias(c) for c, i in private.items() if c not in new and c != "slot"]
    return numbered.select(*others, *new, (F.col("before") + F.col("rank")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows of each shard below path/shard=N."""
    sharded.write.partitionBy("shard").parquet(path)
