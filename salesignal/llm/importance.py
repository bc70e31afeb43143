"""Importance resampling towards a target: hashed n-gram features counted and weighed by Arrow kernels, a Gumbel draw of the best scores, ranked range by range."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.llm.common import stored

#: What stands between words: all ASCII signs but digits and letters. Letters are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that go through the kernels at once, and rows of a range of the ranking.
CHUNK, RANGE = 1 << 22, 1 << 20


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in runs of about CHUNK bytes; null is an empty text."""
    texts = column.fill_null("")
    run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield texts.slice(a, b - a)


def ngram_buckets(texts: pa.Array, least: int, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n from 1 to most: n, the text that each run of n words is from, in order, and the run's bucket (none for n below least).

    Runs of n words are pairs of a run of n - 1 and the word after it, so they are numbered by distinct pairs of dictionary indices; the crc32 of a run goes on from that of the shorter one, and each distinct run is hashed once.
    """
    words = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat = pc.list_flatten(words)
    real = pc.greater(pc.binary_length(flat), 0)  # what stands before a first and after a last separator is empty
    text = pc.list_parent_indices(words).filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.filter(real).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    first, run, hashes = np.arange(len(word)), word, np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    for n in range(1, most + 1):
        if n > 1:
            after = first + n - 1
            inside = after < len(word)
            inside[inside] = text[first[inside]] == text[after[inside]]
            first = first[inside]
            distinct, run = np.unique(run[inside] * len(spelled) + word[after[inside]], return_inverse=True)
            shorter, last = np.divmod(distinct, max(1, len(spelled)))
            hashes = np.fromiter((zlib.crc32(b" " + spelled[w], h) for w, h in zip(last.tolist(), hashes[shorter].tolist(), strict=True)), np.int64, len(distinct))
        yield n, text[first], (hashes % buckets)[run] if n >= least else run[:0]


def bucket_counts(texts: DataFrame, text: str = "text", ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of the features of all rows; buckets without a feature have no row. A task sends one row for each bucket it meets."""

    def counted(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                for _, _, bucket in ngram_buckets(piece, *ngrams, buckets):
                    count += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met])], names=["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed share of each bucket in the target and in the source. `buckets` numbers of each side come to the driver, however large the tables are."""

    def column(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = column(source), column(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, fixed by seed and doc_id (null counts as an empty id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, weight (sum of the gains of its features) and score (weight and Gumbel noise)."""
    gains = bucket_gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets), buckets)
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def weighed(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for piece in _pieces(batch.column(1)):
                words, features, weight = (np.zeros(len(piece), np.int64) for _ in range(3))
                for n, of, bucket in ngram_buckets(piece, *ngrams, buckets):
                    each = np.bincount(of, minlength=len(piece))
                    if n == 1:
                        words += each
                    if len(bucket):
                        filled = np.flatnonzero(each)
                        features += each
                        weight[filled] += np.add.reduceat(np.take(held.value, bucket), (np.cumsum(each) - each)[filled])
                for rows, part in zip(out, (words, features, weight), strict=True):
                    rows.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)) for rows in out]], names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(weighed, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows with `rank` 1, 2, 3... by score, larger first, then doc_id, smaller first (null ids last), then the other figures. total: the number of rows.

    Rows are dealt by ranges of this order, equal scores too, and the range that a row is in is written with it; a range's first rank follows from the counts of those before it. So no task orders more than a range.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    ranges = max(1, -(-total // RANGE))
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # one row a range
    starts, before = [], 0
    for r, n in counts:
        starts.append((r, before))
        before += n
    offsets = dealt.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def importance_draw(docs: DataFrame, target: DataFrame, num: int = 10, den: int = 100, least_words: int = 20, **options) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, weight, score and rank: of the rows with least_words words or more, floor(num * rows / den) with the largest scores are drawn and ranked; others have no rank.

    The exponential of Gumbel's trick: the largest of weight and noise are a draw without replacement in proportion to the importance weights exp(weight / 1000). Null and empty texts have no features, weight 0, and are never drawn when least_words is above 0. Rows of one doc_id share their noise and are ranked each. Rows without doc_id take the noise of an empty id. An empty table of docs gives an empty result; with an empty target weights are those against an even distribution. docs may have any other columns.
    """
    rows = stored(scored(docs, target, **options), "scored")
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    total = rows.filter(able).count()
    rank = F.when(F.col("rank") <= num * total // den, F.col("rank")).alias("rank")
    drawn = ranked(rows.filter(able), total).select(*rows.columns, rank)
    return drawn.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))


def importance_resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Rows of one doc_id are drawn together, when one of them is; rows without doc_id are not drawn."""
    drawn = importance_draw(docs, target, doc_id=doc_id, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the draw
    return docs.toDF(*private.values()).join(drawn, F.col(private[doc_id]) == F.col("_drawn"), "left_semi").select(*[F.col(i).alias(c) for c, i in private.items()])
