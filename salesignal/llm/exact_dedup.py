"""Exact dedup against a history by a minimal perfect hash over its distinct digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import stored

#: Distinct digests in a bucket of the perfect hash, on average.
BUCKET = 4096
DIGEST = 32


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text in UTF-8 after lower-casing A-Z only; a null text counts as empty."""

    def hashed(batches):
        for batch in batches:
            texts = batch.column(1)
            digests = [hashlib.sha256((t.as_buffer().to_pybytes() if t.is_valid else b"").lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(hashed, f"doc_id {kind}, digest binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit words of each digest; the bucket uses neither."""
    raw = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, DIGEST // 8)
    return raw[:, 1], raw[:, 2]


def _slot(a: np.ndarray, b: np.ndarray, seed: np.ndarray, m: int) -> np.ndarray:
    return (_mix(a + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b) % np.uint64(m)).astype(np.int64)


def build_bucket(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct digests by hash and displace: (seed of each group, slot of each digest), with as many slots as digests. Groups are placed largest first; a group's seed is the first that sends its digests to free, different slots."""
    m = len(digests)
    a, b = _words(digests)
    groups = max(1, m // 4)
    group = (b % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(groups + 1))
    seeds = np.zeros(groups, np.uint32)
    free = np.ones(m, bool)
    slots = np.zeros(m, np.int64)
    for g in np.argsort(-(ends[1:] - ends[:-1]), kind="stable"):
        own = order[ends[g] : ends[g + 1]]
        if not len(own):
            break
        first, width = 0, 16
        while True:
            tried = np.arange(first, first + width)
            at = _slot(a[own][None, :], b[own][None, :], tried[:, None], m)
            ok = free[at].all(axis=1)
            if len(own) > 1 and ok.any():
                sorted_at = np.sort(at, axis=1)
                ok &= (sorted_at[:, 1:] != sorted_at[:, :-1]).all(axis=1)
            if ok.any():
                break
            first, width = first + width, min(4 * width, 1 << 14)
        k = int(np.argmax(ok))
        seeds[g] = tried[k]
        slots[own] = at[k]
        free[at[k]] = False
    return seeds, slots


def look_up(seeds: np.ndarray, m: int, held: list[bytes], asked: list[bytes]) -> np.ndarray:
    """Slot of each asked digest, or -1: the hash sends every digest somewhere, so all 32 bytes in the slot are compared."""
    if not m or not asked:
        return np.full(len(asked), -1, np.int64)
    a, b = _words(asked)
    at = _slot(a, b, seeds[(b % np.uint64(len(seeds))).astype(np.int64)], m)
    slots = np.frombuffer(b"".join(held), dtype=f"V{DIGEST}")
    own = np.frombuffer(b"".join(asked), dtype=f"V{DIGEST}")
    return np.where(slots[at] == own, at, -1)


def _with_bucket(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets)).cast("int"))


def build_history(rows: DataFrame, per_bucket: int = BUCKET) -> DataFrame:
    """The history's index, a row for each bucket: bucket, buckets, seeds (4 bytes each), slots (full digests by slot), winners and copies by slot.

    rows has doc_id and digest, repeats included; the winner is the largest doc_id of a digest. Digests are grouped before anything is moved (a digest that a third of all rows share leaves a task once), and buckets are cut from the digest's leading bits, so they are even however many copies there are.
    """
    distinct = stored(rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("copies")), "history")
    buckets = max(1, -(-distinct.count() // per_bucket))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = list(pdf["digest"])
        seeds, slots = build_bucket(held)
        by_slot = np.argsort(slots)
        return pd.DataFrame(
            {
                "bucket": [key[0]],
                "buckets": [buckets],
                "seeds": [seeds.astype("<u4").tobytes()],
                "slots": [b"".join(held[i] for i in by_slot)],
                "winners": [[None if pd.isna(w) else int(w) for w in pdf["winner"].iloc[by_slot]]],
                "copies": [[int(n) for n in pdf["copies"].iloc[by_slot]]],
            }
        )

    kind = dict(rows.dtypes)["doc_id"]
    return _with_bucket(distinct, buckets).groupBy("bucket").applyInPandas(build, f"bucket int, buckets int, seeds binary, slots binary, winners array<{kind}>, copies array<bigint>")


def probe_history(asked: DataFrame, history: DataFrame, buckets: int, parts: int = 1) -> DataFrame:
    """Each distinct digest of asked (digest, newest, asked) with its winner and copies in the history: null and 0 for nonmembers. A bucket's questions are dealt into so many parts, each of which gets the bucket's index row."""
    kind = dict(asked.dtypes)["newest"]

    def probe(index: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"digest": [], "newest": [], "asked": [], "winner": [], "copies": []})
        own = list(rows["digest"])
        out = rows[["digest", "newest", "asked"]].copy()
        if not len(index):
            return out.assign(winner=None, copies=0)
        x = index.iloc[0]
        m = len(x["slots"]) // DIGEST
        at = look_up(np.frombuffer(x["seeds"], "<u4"), m, [x["slots"]], own)
        hit = at >= 0
        winners, copies = x["winners"], x["copies"]
        out["winner"] = pd.array([winners[i] if ok and winners[i] is not None else None for i, ok in zip(at, hit, strict=True)], dtype="Int64")
        out["copies"] = [int(copies[i]) if ok else 0 for i, ok in zip(at, hit, strict=True)]
        return out

    index = history.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = _with_bucket(asked, buckets).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    return index.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInPandas(probe, f"digest binary, newest {kind}, asked bigint, winner {kind}, copies bigint")


def dedup_against(rows: DataFrame, history_rows: DataFrame, per_bucket: int = BUCKET) -> DataFrame:
    """(digest, keep_id, group_size) for every distinct digest of rows and history_rows (both doc_id, digest).

    Members: the history's slot gives winner and copies, and the batch adds its own; the largest doc_id stays. Nonmembers have met no equal text in the history and group among themselves. Digests that only the history has come from the index itself.
    """
    history = stored(build_history(history_rows, per_bucket), "perfect-hash")
    found = history.select("buckets").limit(1).collect()
    buckets = found[0][0] if found else 1
    asked = stored(rows.groupBy("digest").agg(F.max("doc_id").alias("newest"), F.count("*").alias("asked")), "asked")
    # a small history has few buckets: a large batch is dealt over as many tasks as its own digests fill
    parts = max(1, -(-asked.count() // (buckets * per_bucket)))
    probed = stored(probe_history(asked, history, buckets, parts), "probed")
    both = probed.select("digest", F.greatest("newest", "winner").alias("keep_id"), (F.col("asked") + F.col("copies")).alias("group_size"))
    slots = history.select(F.posexplode("winners").alias("slot", "keep_id"), "slots", "copies").select(
        F.expr(f"substring(slots, slot * {DIGEST} + 1, {DIGEST})").alias("digest"), "keep_id", F.expr("copies[slot]").alias("group_size")
    )
    return both.unionByName(slots.join(probed.select("digest"), "digest", "left_anti"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", history_from=None, per_bucket: int = BUCKET) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 and from_history.

    Texts are equal when their bytes are, after lower-casing A-Z only; of equal texts the row with the largest doc_id stays. Rows with doc_id at or above history_from are the history over whose distinct digests the perfect hash is built (where it is not given: the median, so about half of the rows), the others are looked up in it. The result does not depend on the cut.

    Null texts count as empty. A null doc_id never wins over another; repeated rows with the winning doc_id are all kept, being one document. An empty table gives an empty result; other columns of docs are ignored.
    """
    rows = stored(digest_rows(docs, doc_id, text), "digests")
    if history_from is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        history_from = 0 if middle is None else middle
    old = F.coalesce(F.col("doc_id") >= F.lit(history_from), F.lit(False))
    groups = dedup_against(rows.filter(~old), rows.filter(old), per_bucket)
    # the side with one row a digest is the smaller one; a hot digest's rows are split by the adaptive skew join
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        old.alias("from_history"),
    )
