"""Benchmark decontamination by greedy string tiling: running Karp-Rabin matching (Wise, 1993) behind a join on shared token seeds."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import BROADCAST_BYTES, dealt_join, salted_join, size_within, stored
from salesignal.llm.tokens import BASE, INVERSE, mix, text_parts, words_of

#: Shortest tile, in tokens.
LEAST_TILE = 4
#: Share of an item's tokens that tiles must cover for the document to count as containing it.
LEAST_COVERAGE = 0.5

# ASCII letters are lower-cased and other ASCII signs part tokens; bytes of other characters stay.
_TOKEN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def _prepared(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), F.lower(F.col(text).cast("string")).cast("binary").alias("text"))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return words_of([t.translate(_TOKEN) for t in texts])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    odd = mix(np.arange(301, 301 + k, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out += words[j : j + len(out)] * odd[j]
    return mix(out)


def _rolling(x: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of s tokens; equal runs have equal hashes wherever they stand."""
    up, down = np.full(len(x), BASE, np.uint64), np.full(len(x), INVERSE, np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(up, dtype=np.uint64), dtype=np.uint64)))
    n = len(x) - s + 1
    return (sums[s:] - sums[:n]) * np.cumprod(down, dtype=np.uint64)[:n]


def tiling(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles (length, start in item, start in doc): the longest matches of unmarked tokens are marked first, down to `least` tokens; no token is in two tiles."""
    tiles: list[tuple[int, int, int]] = []
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    s = max(least, min(len(item), len(doc)) // 2)
    while min(len(item), len(doc)) >= s >= least and not in_item.all():
        # longest first; what is left of a match that marked tokens cut goes back to its place in the order
        heap = [(-n, i, j) for n, i, j in _matches(item, doc, in_item, in_doc, s)]
        while heap and not in_item.all():
            n, i, j = heapq.heappop(heap)
            taken = in_item[i : i - n] | in_doc[j : j - n]
            if not taken.any():
                in_item[i : i - n] = in_doc[j : j - n] = True
                tiles.append((-n, i, j))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for at, end in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - at >= s:
                    heapq.heappush(heap, (at - end, i + at, j + at))
        s = s // 2 if s > 2 * least else least if s > least else 0
    return tiles


#: Pairs of equal seeds that are looked at together.
PAIRS = 1 << 20


def _matches(item, doc, in_item, in_doc, s: int) -> list[tuple[int, int, int]]:
    """Maximal matches of s unmarked tokens or more, longest first.

    Where a match goes on, its seeds stand next to one another on a diagonal, so a match is a run of pairs of equal seeds. Pairs are made for some places of the text at a time; a run that reaches the last of them is joined with what goes on after it.
    """
    free_i = np.convolve(in_item, np.ones(s, int), "valid") == 0
    free_j = np.convolve(in_doc, np.ones(s, int), "valid") == 0
    hi, hj = _rolling(item, s), _rolling(doc, s)
    starts_i, starts_j = np.flatnonzero(free_i), np.flatnonzero(free_j)
    starts_i = starts_i[np.argsort(hi[starts_i], kind="stable")]
    seeds = hi[starts_i]
    lo, hi_end = np.searchsorted(seeds, hj[starts_j]), np.searchsorted(seeds, hj[starts_j], "right")
    met = hi_end > lo
    starts_j, lo, many = starts_j[met], lo[met], (hi_end - lo)[met]
    runs: list[np.ndarray] = []  # (diagonal, first place in the text, seeds)
    part = np.cumsum(many) // PAIRS if len(many) else many
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(many)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = many[a:b]
        if not n.sum():
            continue
        j = np.repeat(starts_j[a:b], n)
        i = starts_i[np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((j, i - j))
        diagonal, place = (i - j)[order], j[order]
        first = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1))))
        runs.append(np.stack((diagonal[first], place[first], np.diff(np.append(first, len(place))))))
    if not runs:
        return []
    diagonal, place, seeds = np.concatenate(runs, axis=1)
    if len(runs) > 1:
        order = np.lexsort((place, diagonal))
        diagonal, place, seeds = diagonal[order], place[order], seeds[order]
        first = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + seeds[:-1]))))
        diagonal, place, seeds = diagonal[first], place[first], np.add.reduceat(seeds, first)
    length = seeds + s - 1
    order = np.lexsort((place, place + diagonal, -length))
    found = zip(length[order].tolist(), (place + diagonal)[order].tolist(), place[order].tolist(), strict=True)
    # equal hashes are held against the tokens
    return [(n, i, j) for n, i, j in found if np.array_equal(item[i : i + n], doc[j : j + n])]


def coverage(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> float:
    return sum(n for n, _, _ in tiling(item, doc, least)) / max(1, len(item))


class Items:
    """Items' tokens and the sorted table of their seeds; an item shorter than a tile is its own seed and tile."""

    def __init__(self, rows: list[tuple[object, bytes]], least: int):
        self.ids = [i for i, _ in rows]
        words, at = tokens_of([t for _, t in rows])
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.tile = [max(1, min(least, len(w))) for w in self.words]
        self.tables = {}
        for k in sorted(set(self.tile)):
            seeds = [(g, x, p) for x, w in enumerate(self.words) if self.tile[x] == k and len(w) for p, g in enumerate(_grams(w, k).tolist())]
            if seeds:
                seeds.sort()
                self.tables[k] = (np.array([s[0] for s in seeds], np.uint64), np.array([s[1] for s in seeds]), np.array([s[2] for s in seeds]))

    def found_in(self, words: np.ndarray, at: np.ndarray, share: float) -> list[tuple[int, int, float]]:
        """(text, item, coverage) where coverage reaches share. Texts are words[at[i]:at[i + 1]]."""
        pairs: dict[tuple[int, int], list[np.ndarray]] = {}
        for k, (seeds, item, place) in self.tables.items():
            grams = _grams(words, k)
            lo = np.searchsorted(seeds, grams)
            hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == grams)
            of = np.searchsorted(at, hit, "right") - 1
            inside = hit + k <= at[of + 1]
            hit, of = hit[inside], of[inside]
            lo, hi = lo[hit], np.searchsorted(seeds, grams[hit], "right")
            many = hi - lo
            if not len(hit):
                continue
            flat = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            # each (text, item, place) once: what the seeds cover bounds what tiles can
            keys = np.unique(np.stack((np.repeat(of, many), item[flat], place[flat])), axis=1)
            cut = np.flatnonzero(np.concatenate(([True], (keys[:2, 1:] != keys[:2, :-1]).any(axis=0), [True])))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                pairs[int(keys[0, a]), int(keys[1, a])] = keys[2, a:b]
        out = []
        for (d, x), places in pairs.items():
            w, k = self.words[x], self.tile[x]
            covered = np.zeros(len(w) + 1, int)
            np.add.at(covered, places, 1)
            np.add.at(covered, places + k, -1)
            if np.count_nonzero(np.cumsum(covered)[:-1]) >= share * len(w):
                c = coverage(w, words[at[d] : at[d + 1]], k)
                if c >= share:
                    out.append((d, x, c))
        return out


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = LEAST_COVERAGE, least: int = LEAST_TILE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage) for each row of docs and item of which tiles cover `share` of the tokens or more, in any order.

    Items of most_bytes together, at most, are sent to all tasks and each text is read once, where it lies. A larger benchmark is joined by its seeds (see joined_items). Null and empty texts hold nothing; items without a token are in no document.
    """
    items = _prepared(benchmark, item_id, item_text, "item_id").filter("item_id is not null and length(text) > 0")
    if not size_within(items, F.octet_length("text"), most_bytes):
        return joined_items(docs, benchmark, share, least, doc_id, text, item_id, item_text)
    built = Items([(r[0], bytes(r[1])) for r in items.distinct().collect()], least)  # once, not in every task
    held = docs.sparkSession.sparkContext.broadcast(built)

    def tiled(batches):
        known = held.value
        for batch in batches:
            row, item, share_of = [], [], []
            for first, part in text_parts(batch.column(1), lower=False):
                for d, x, c in known.found_in(*tokens_of(part), share):
                    row.append(first + d)
                    item.append(known.ids[x])
                    share_of.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_kind), pa.array(share_of, pa.float64())], names=["doc_id", "item_id", "coverage"])

    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    item_kind = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    return _prepared(docs, doc_id, text, "doc_id").mapInArrow(tiled, f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double")


def joined_items(docs: DataFrame, benchmark: DataFrame, share: float, least: int, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """contained_items for a benchmark too large to send: distinct seeds of both sides are joined, pairs with enough of them are tiled where their texts meet."""

    def seeds(tiles: list[int] | None = None):
        """Distinct seeds of each text and the number of their places in it: an item's are as long as a tile, or as the item if that is shorter; a document has seeds of all the lengths in tiles. The first column and those after the text are kept."""

        def rows(batches):
            for batch in batches:
                kept = [0, *range(2, batch.num_columns)]
                for first, t in enumerate(batch.column(1)):
                    words, _ = tokens_of([t.as_buffer().to_pybytes() if t.is_valid else b""])
                    lengths = tiles or [max(1, min(least, len(words)))]
                    found = [np.unique(_grams(words, k), return_counts=True) for k in lengths] if len(words) else []
                    grams = np.concatenate([np.zeros(0, np.uint64), *[g ^ np.uint64(k) for k, (g, _) in zip(lengths, found, strict=False)]])
                    places = np.concatenate([np.zeros(0, np.int64), *[c for _, c in found]])
                    n = pa.array(np.full(len(grams), first))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(n) for i in kept], pa.array(grams.astype(np.int64)), pa.array(np.full(len(grams), len(words))), pa.array(places)], names=[*[batch.schema.names[i] for i in kept], "seed", "size", "places"])

        return rows

    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    items = _prepared(benchmark, item_id, item_text, "item_id").filter("item_id is not null and length(text) > 0").distinct()
    plain = _prepared(docs, doc_id, text, "doc_id").withColumn("row", F.xxhash64("text"))
    of_items = stored(items.mapInArrow(seeds(), f"item_id {kinds[1]}, seed bigint, size bigint, places bigint"), "seeds")
    # documents have seeds of the lengths that items' tiles have (most often one), and those that no item has go first
    tiles = sorted(r[0] for r in of_items.select(F.least(F.col("size"), F.lit(least)).cast("int")).distinct().collect())
    if not tiles:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double")
    of_docs = plain.mapInArrow(seeds(tiles), f"doc_id {kinds[0]}, row bigint, seed bigint, size bigint, places bigint").select("doc_id", "row", "seed").distinct()
    wanted = stored(of_docs.join(of_items.select("seed").distinct(), "seed", "left_semi"), "wanted")
    # a seed of very many documents is dealt over several tasks
    common, total = wanted.groupBy("seed").agg(F.count("*").alias("_n")), wanted.count()
    counted = salted_join(wanted, common.withColumn("n", F.col("_n")), ["seed"], total)
    met = dealt_join(counted, of_items.join(common, "seed"), ["seed"], F.col("n"), total)
    # a seed covers `least` tokens at most at each of its places in the item, so seeds with fewer places than share * size / least cannot cover enough
    pairs = met.groupBy("doc_id", "row", "item_id").agg(F.sum("places").alias("n"), F.min("size").alias("size")).filter(F.col("n") * least >= F.col("size") * share).select("doc_id", "row", "item_id")
    texts = plain.dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("own"), F.col("row").alias("key"), "text")
    met = pairs.join(texts, (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("own"))).join(items.withColumnRenamed("text", "item"), "item_id")

    @F.pandas_udf("double")
    def covered(doc: pd.Series, item: pd.Series) -> pd.Series:
        out = []
        for d, i in zip(doc, item, strict=True):
            words, at = tokens_of([bytes(d), bytes(i)])
            w = words[at[1] : at[2]]
            out.append(coverage(w, words[at[0] : at[1]], max(1, min(least, len(w)))))
        return pd.Series(out, dtype=float)

    return met.select("doc_id", "item_id", covered("text", "item").alias("coverage")).filter(F.col("coverage") >= share)


def decontamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """A row for each row of docs: doc_id, contaminated, n_items, worst_item (largest coverage, then smallest id) and coverage (0 without an item)."""
    found = contained_items(docs, benchmark, doc_id=doc_id, **options).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.max("coverage").alias("coverage"), F.min_by("item_id", F.struct(-F.col("coverage"), F.col("item_id"))).alias("worst_item"))
    rows = docs.select(F.col(doc_id).alias("doc_id"))
    found = found.withColumnRenamed("doc_id", "found")
    return rows.join(found, rows["doc_id"] == found["found"], "left").select("doc_id", F.col("found").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "worst_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows with a null doc_id stay. Rows that repeat a doc_id go if one of them holds an item."""
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the list of those found
    found = contained_items(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias("found")).distinct()
    return docs.toDF(*private.values()).join(found, F.col(private[doc_id]) == F.col("found"), "left_anti").select(*[F.col(i).alias(c) for c, i in private.items()])
