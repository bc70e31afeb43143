"""Exact n-gram Jaccard self-join as T-occurrence search with DivideSkip (Li, Lu and Lu, 2008)."""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesignal.llm.common import salted_join, stored
from salesignal.llm.components import connected_components
from salesignal.llm.tokens import mix, shingles_of, text_parts

#: Signatures that a task holds before it hands them on, those that its sets share as one.
FLUSH = 1_000_000
#: Rows of 48 bytes that are sent to all tasks at most.
LISTED = 200_000
#: Shingles searched in one task at most, on average; groups beyond it are searched as pairs of blocks.
BLOCK = 4_000_000
#: Sets that share a signature are told apart by their profiles where a list has LONG rows at most, and a task TOGETHER of them.
LONG, TOGETHER = 512, 32
#: Bytes of lists' rows that are looked at in one task, on average.
LISTS = 4 << 20
#: DivideSkip's weight of a probe against a merge step, as published.
MU = 0.0085


def least_overlap(n: int, m, num: int, den: int):
    """Least intersection of sets of n and m elements whose Jaccard similarity is num / den or more."""
    return -((-num * (n + m)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """So many of n ordered elements that a set sharing none of them cannot reach num / den: the lists that T-occurrence search has to merge when it probes T - 1 others."""
    return n + (-num * n) // den + 1


@functools.cache
def size_bounds(num: int, den: int) -> np.ndarray:
    """Least sizes of the bands 0, 1, 2...: sets that link are of one band or of neighbouring ones."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(at[-1] * den // num + 1 if num < den else 2 * at[-1])
    return np.array(at)


@functools.cache
def window(w: int, num: int, den: int) -> tuple[int, int, int]:
    """For links between a set of band w and one of band w or w + 1: the most elements d in which they differ; the parts into which sets are cut; the least elements of a part that counts.

    Of so many parts, d at most differ, so the sets agree in d + 1 parts or more, if both are cut alike. The spare parts make up for those with too few elements, three standard deviations above what the smallest sets should have.
    """
    low, middle, high = size_bounds(num, den)[w : w + 3].tolist()
    d = (middle + high - 2) * (den - num) // (den + num)
    parts = np.arange(d + 1, d + (d + 1) // 4 + 4)
    rate = low / parts
    for least in (3, 2, 1):
        small = np.exp(-rate) * sum(rate**i / math.factorial(i) for i in range(least))
        enough = np.flatnonzero(parts * (1 - small) - 3 * np.sqrt(parts * small) >= d + 1)
        if len(enough):
            return d, int(parts[enough[0]]), least
    return d, d + 2, 1


def signatures(s: np.ndarray, num: int, den: int):
    """(window, signatures) for the two windows that a set is in. Two different sets that link share a signature of the window that begins with the smaller one's band.

    A set is cut into parts by its elements' hashes; a part's signature is the hash of all its elements. A set with too many small parts also posts its first elements, as many as T-occurrence search must merge: two such sets that link share one of those.
    """
    band = int(np.searchsorted(size_bounds(num, den), len(s), "right")) - 1
    sums = None
    for w in (band, band - 1):
        d, parts, least = window(w, num, den) if w >= 0 else (0, 0, 0)
        if not d:
            continue
        if sums is None:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)))
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges) >= least)
        own = mix(sums[edges[full + 1]] - sums[edges[full]] + mix((full + (w + 1 << 40)).astype(np.uint64)))
        if len(full) <= d:
            own = np.concatenate((own, mix(s[: prefix_length(len(s), num, den)] + np.uint64(w + 1 << 50))))
        yield w, own


@functools.cache
def profile_bits(w: int, num: int, den: int) -> int:
    """A profile of window w has so many bits of buckets: one for four elements of the smallest sets, or for up to eight."""
    return max(4, int(size_bounds(num, den)[max(w, 0)]).bit_length() - 3)


def profile_of(s: np.ndarray, bits: int) -> np.ndarray:
    """How many elements are in each bucket of hashes, 255 at most."""
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(profile: np.ndarray, bits: int) -> np.ndarray:
    """A profile as one of fewer bits."""
    return np.minimum(profile.reshape(1 << bits, -1).sum(axis=1), 255).astype(np.int16)


def near_parts(sizes: np.ndarray, profiles: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set of a list the first one of its part; sets that link are in one part.

    Two sets differ in no fewer elements than their profiles do, so a pair whose profiles differ by more than linked sets of these sizes can is no link. What remains is walked through from each set not reached yet.
    """
    part = np.full(len(sizes), -1, np.int64)
    left = np.arange(len(sizes))
    while len(left):
        first, left = left[0], left[1:]
        part[first], front = first, [first]
        while front and len(left):
            x = front.pop()
            most = sizes[x] + sizes[left] - 2 * least_overlap(sizes[x], sizes[left], num, den)
            near = np.abs(profiles[left] - profiles[x]).sum(axis=1) <= most
            part[left[near]] = first
            front.extend(left[near].tolist())
            left = left[~near]
    return part


def digests_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    sums = np.array([np.sum(mix(s)), np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64) + np.uint64(len(s))
    return tuple(mix(sums).view(np.int64).tolist())


def unseen(own: tuple[int, int], seen: set) -> bool:
    """Whether a task meets a set for the first time, as far as it remembers."""
    if own in seen:
        return False
    if len(seen) >= 200_000:
        seen.clear()
    seen.add(own)
    return True


def _binary(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """For each row doc_id, n, the set's band, digest and profile."""
    bounds = size_bounds(num, den)

    def rows(batches):
        for batch in batches:
            sets, profiles = [], []
            for s in shingles_of((part for _, part in text_parts(batch.column(1))), k):
                band = int(np.searchsorted(bounds, len(s), "right")) - 1
                sets.append((len(s), band, *digests_of(s)))
                profiles.append(profile_of(s, profile_bits(band, num, den)).tobytes() if len(s) else b"")
            n, band, d1, d2 = (np.array(x, np.int64) for x in zip(*sets, strict=True)) if sets else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(band.astype(np.int32)), pa.array(d1), pa.array(d2), pa.array(profiles, pa.binary())], names=["doc_id", "n", "band", "d1", "d2", "profile"])

    return docs.mapInArrow(rows, "doc_id bigint, n int, band int, d1 bigint, d2 bigint, profile binary")


def node_of(d1, w):
    """The node that stands for a set in window w, of columns or arrays alike."""
    if isinstance(d1, Column):
        return d1.bitwiseXOR(F.shiftleft((w + 1).cast("long"), 40))
    return d1 ^ (w + 1 << 40)


def _lists(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The lists of different nodes that share a signature: (list, node, peer). Equal lists of many signatures have one number. A list that is too long to be told apart has none, and its nodes are joined to the smallest of them (peer) as they are.

    Where a task has more than TOGETHER nodes with a signature, it posts that once, with the smallest of them, and the others' edges to that one; so a signature that very many sets share meets few rows of each task. An edge travels as a posting of its own.
    """

    def posted(batches):
        seen: set = set()  # of this task: copies post once
        signature, node, size = [], [], 0

        def grouped():
            s, v = np.concatenate(signature), np.concatenate(node)
            by = np.lexsort((v, s))
            s, v = s[by], v[by]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            firsts = np.flatnonzero(new)
            sizes = np.diff(firsts, append=len(s))
            many = np.repeat(sizes > TOGETHER, sizes)
            least = np.repeat(v[firsts], sizes)
            alone = ~many & (new | np.concatenate(([True], v[1:] != v[:-1])))
            pairs = np.unique(np.stack((v[many], least[many]))[:, v[many] != least[many]], axis=1)
            own = mix((pairs[0].astype(np.uint64) * np.uint64(3)) ^ mix(pairs[1].astype(np.uint64))).astype(np.int64)
            heads = firsts[sizes > TOGETHER]
            columns = (np.concatenate((s[alone].astype(np.int64), s[heads].astype(np.int64), own)), np.concatenate((v[alone], v[heads], pairs[0])))
            peer = pa.concat_arrays([pa.nulls(int(alone.sum()), pa.int64()), pa.array(np.concatenate((v[heads], pairs[1])))])
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), peer], names=["signature", "node", "peer"])

        for batch in batches:
            for s in shingles_of((part for _, part in text_parts(batch.column(1))), k):
                own = digests_of(s)
                if not len(s) or not unseen(own, seen):
                    continue
                for w, x in signatures(s, num, den):
                    signature.append(x)
                    node.append(np.full(len(x), node_of(own[0], w), np.int64))
                    size += len(x)
                if size >= FLUSH:
                    yield grouped()
                    signature, node, size = [], [], 0
        if size:
            yield grouped()

    postings = docs.mapInArrow(posted, "signature bigint, node bigint, peer bigint")
    own = Window.partitionBy("signature")
    peer = F.coalesce("peer", "node")
    rows = postings.select(
        "node", F.min(peer).over(own).alias("peer"), F.max("node").over(own).alias("last"), F.count("*").over(own).alias("rows"), F.max(F.col("peer").isNotNull()).over(own).alias("joined"),
        F.sum(F.shiftrightunsigned(F.xxhash64("node"), 20)).over(own).alias("sum"),
    )
    number = F.when(~F.col("joined") & (F.col("rows") <= LONG), F.xxhash64("rows", "sum"))
    return rows.filter("peer < last").select(number.alias("list"), "node", "peer")


def _candidates(lists: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (node, peer) that join all nodes that may link: those of long lists as they are, those of others in parts that their profiles make (see near_parts). nodes: node, n, w, profile."""
    members = stored(lists.filter("list is not null").select("list", "node").distinct(), "lists")
    held = members.join(nodes.select("node", (F.octet_length("profile") + 48).alias("held")), "node").agg(F.sum("held")).first()[0] or 0
    bins = max(1, -(-held // LISTS))
    bits = {w: profile_bits(w, num, den) for w in range(-1, len(size_bounds(num, den)))}

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "w"], kind="stable")
        number, w, node, n, profile = (pdf[c].to_numpy() for c in ("list", "w", "node", "n", "profile"))
        edges = np.flatnonzero((number[1:] != number[:-1]) | (w[1:] != w[:-1])) + 1
        peer = node.copy()
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(node)], strict=True):
            if b - a > 1:
                own = np.stack([folded(np.frombuffer(x, np.uint8), bits[int(w[a])]) for x in profile[a:b]])
                peer[a:b] = node[a:b][near_parts(n[a:b].astype(np.int64), own, num, den)]
        moved = peer != node
        return pd.DataFrame({"node": node[moved], "peer": peer[moved]}).drop_duplicates()

    looked = members.join(nodes, "node").withColumn("bin", F.pmod("list", F.lit(bins)))
    return looked.groupBy("bin").applyInPandas(parts, "node bigint, peer bigint").unionByName(lists.filter("list is null and node <> peer").select("node", "peer"))


def divide_skip(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, low: np.ndarray | None = None):
    """Every pair (a, b) of positions in sets with Jaccard similarity num / den or more, as arrays for each b. With side, pairs of the same side are left out; with low, which marks the smallest sets, those without any of these.

    The sets are put in order of size and asked one after another against the smaller ones before them. A set's inverted lists are parted: the L longest are set aside, with L = T / (mu * log2(longest) + 1) for the least overlap T that any candidate can have; the short ones are merged by a heap (in bulk where they are long), and what occurs T - L times or more is looked up in the long lists by binary search, shortest first, as long as it can still reach its own T.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order), dtype=np.int32), size)
    by = np.argsort(flat, kind="stable")
    posted, flat = owner[by], flat[by]
    firsts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    lists = np.concatenate((firsts, [len(flat)]))
    length = np.diff(lists)
    of_element = np.empty(len(flat), np.int32)
    of_element[by] = np.repeat(np.arange(len(firsts), dtype=np.int32), length)
    begin = np.concatenate(([0], np.cumsum(size)))
    lows = len(order) if low is None else int(low.sum())
    for q in range(1, len(order)):
        n = int(size[q])
        t = -(-num * n // den)
        first = int(np.searchsorted(size, t))
        if first >= min(q, lows):
            continue
        own = of_element[begin[q] : begin[q + 1]]
        own = own[length[own] > 1]
        if len(own) < t:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        longest = int(length[own[-1]])
        held_out = min(t - 1, len(own), int(t / (MU * math.log2(max(2, longest)) + 1)))
        short, long = own[: len(own) - held_out], own[len(own) - held_out :]
        found, count = _merged([posted[lists[x] : lists[x + 1]] for x in short], first, min(q, lows))
        keep = count >= t - held_out
        if side is not None:
            keep &= side[order[found]] != side[order[q]]
        found, count = found[keep], count[keep]
        need = least_overlap(n, size[found], num, den)
        left = len(long)
        for x in long:
            if not len(found):
                break
            ids = posted[lists[x] : lists[x + 1]]
            at = np.searchsorted(ids, found)
            count = count + (ids[np.minimum(at, len(ids) - 1)] == found)
            left -= 1
            able = count + left >= need
            if not able.all():
                found, count, need = found[able], count[able], need[able]
        found = found[count >= need]
        if len(found):
            yield int(order[q]), order[found]


def _merged(short: list[np.ndarray], first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from first to end - 1 in the sorted lists, and in how many of them each occurs."""
    short = [x[np.searchsorted(x, first) : np.searchsorted(x, end)] for x in short]
    total = sum(map(len, short))
    if total <= 64:
        merged: dict[int, int] = {}
        for x in heapq.merge(*(x.tolist() for x in short if len(x))):
            merged[x] = merged.get(x, 0) + 1
        return np.fromiter(merged, np.int64, len(merged)), np.fromiter(merged.values(), np.int64, len(merged))
    count = np.bincount(np.concatenate(short) - first)
    found = np.flatnonzero(count)
    return found + first, count[found]


def _search(num: int, den: int):
    """One task's search: rows of some groups, of a block or of a pair of blocks of a group, with packed sets. Gives forest edges between linked rows and each row's number of links."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["packed"]]
        ids = pdf["doc_id"].to_numpy(np.int64)
        crossed = pdf["bi"].iloc[0] != pdf["bj"].iloc[0]
        root = list(range(len(sets)))
        links = np.zeros(len(sets), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        side, low, grp = pdf["block"].to_numpy(), pdf["low"].to_numpy(bool), pdf["grp"].to_numpy()
        by = np.argsort(grp, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(grp[by])) + 1):
            for q, found in divide_skip([sets[i] for i in own], num, den, side[own] if crossed else None, low[own]):
                q, found = int(own[q]), own[found]
                links[q] += len(found)
                links[found] += 1
                for c in found.tolist():
                    a, b = find(q), find(c)
                    if a != b:
                        if ids[b] < ids[a]:
                            a, b = b, a
                        root[b] = a
        at = np.array([find(i) for i in range(len(sets))], np.int64)
        linked = links > 0
        return pd.DataFrame({"a": ids[linked], "b": ids[at[linked]], "links": links[linked]})

    return search


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, class_id, component_id, n_links.

    Words are the runs between the six ASCII spaces after lower-casing A-Z; a set holds the distinct shingles of k words, with fewer words the whole sequence as one. Sets link when intersection / union is num / den or more. class_id: the smallest doc_id with the same set; component_id: the smallest reachable by links; n_links: other distinct sets linked with this one. Nothing is approximate: classes are grouped by 128-bit digests, and all links between classes are found.

    1. One pass hashes the texts and groups equal sets. 2. Each set posts signatures of its parts (see signatures) to inverted lists, which a shuffle brings together; sets that share a list and whose profiles (numbers of elements by bucket) leave a link possible are joined into candidate groups, window by window of sizes; so sets that only share passages do not chain into groups that grow faster than the input. 3. Each group's sets meet in one task, many small groups together, very large ones as pairs of blocks, and are searched by divide_skip. Copies are one class throughout.

    Null or empty texts and texts of spaces: n_shingles 0, linked with nothing, component_id their own doc_id. A null doc_id cannot be linked to: such a row gets its class's component, null if it has none. Rows that repeat a doc_id are one node, whatever their texts. Other columns of docs are ignored.
    """
    plain = _binary(docs, doc_id, text)
    rows = stored(_sets(plain, k, num, den), "sets")
    total_rows = rows.count()
    classes = stored(rows.filter("n > 0").groupBy("n", "band", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("_n"), F.first("profile").alias("profile")), "classes")
    nodes = classes.select("d1", "n", "profile", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("w")).select(node_of(F.col("d1"), F.col("w")).alias("node"), "n", "w", "profile")
    groups = connected_components(_candidates(stored(_lists(plain, k, num, den), "shared"), nodes, num, den), "node", "peer").withColumnRenamed("component", "grp")
    windows = classes.filter("class_id is not null").select("class_id", "d1", "n", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("w"))
    windows = windows.select("class_id", "d1", "n", node_of(F.col("d1"), F.col("w")).alias("node"), (F.col("w") == F.col("band")).alias("low"))
    members = stored(windows.join(groups, "node").select("class_id", "d1", "n", "low", "grp"), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // (block // 2)))
    sizes = members.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("_n"))
    blocks = F.when(F.col("total") > block, F.ceil(F.col("total") / (block // 2))).otherwise(1).cast("int")
    cut = salted_join(members, sizes, ["grp"], members.count()).withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.withColumn("other", other).select("class_id", "d1", "low", "grp", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.col("grp")).alias("bin"), (F.col("blocks") > 1).alias("split"))

    def packed(batches):
        for batch in batches:
            digests = batch.column("d1").to_pylist()
            for first, part in text_parts(batch.column("text")):
                sets = list(shingles_of([part], k))
                keep = [i for i, s in enumerate(sets) if len(s) and digests_of(s)[0] == digests[first + i]]
                out = batch.select(["doc_id", "low", "grp", "bin", "bi", "bj", "block", "split"]).take(pa.array([first + i for i in keep], pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=[*out.schema.names, "packed"])

    # few members: their list, of a checked length, goes to the texts; many: both are dealt by doc_id
    cut = stored(cut, "cut")
    shipped = plain.join(F.broadcast(cut) if cut.count() <= LISTED else cut, plain["doc_id"] == cut["class_id"]).select("doc_id", "text", "d1", "low", "grp", "bin", "bi", "bj", "block", "split")
    sets = shipped.mapInArrow(packed, "doc_id bigint, low boolean, grp bigint, bin bigint, bi int, bj int, block int, split boolean, packed binary")
    found = stored(sets.groupBy("bin", "bi", "bj", "split").applyInPandas(_search(num, den), T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "links")])), "links")
    joined = connected_components(found, "a", "b")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    per_class = classes.join(joined, classes["class_id"] == joined["node"], "left").join(links, classes["class_id"] == links["a"], "left")
    per_class = per_class.select("n", "d1", "d2", "_n", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    named = salted_join(rows.filter("n > 0").drop("profile"), per_class, ["n", "d1", "d2"], total_rows)
    columns = [F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "n_links"]
    alone = rows.filter("n = 0").select("doc_id", "n", *[F.lit(None).cast("long").alias(c) for c in ("class_id", "component_id")], F.lit(0).cast("long").alias("n_links"))
    return named.select("doc_id", *columns).unionByName(alone.select("doc_id", *columns))
