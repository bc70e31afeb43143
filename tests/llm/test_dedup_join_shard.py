"""Sharding, exact dedup, n-gram join and line dedup against brute force; nulls, empties, ties, repeats, extra columns."""

import hashlib
import random
import time
from collections import Counter
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from salesignal.llm import common
from salesignal.llm import exact_dedup as ed
from salesignal.llm import line_dedup as ld
from salesignal.llm import ngram_join as nj
from salesignal.llm.components import connected_components
from salesignal.llm.sharding import jump_hash, shard_documents

ROWS = [(1, "Aa b"), (2, "aA B"), (3, None), (4, ""), (5, "x y z w"), (6, "É é"), (7, "é é"), (8, "Aa b"), (8, "Aa b"), (None, "x y z w"), (9, "   ")]


def jump(key: int, n: int) -> int:
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id bigint, text string, shard string, slot int")


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_jump_hash(spark, n):
    keys = [0, 1, 2, 10863919174838991, -1, -(1 << 63), (1 << 63) - 1, *random.Random(n).sample(range(1 << 62), 200)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == jump(r["k"], n) for r in got)


def test_sharding(spark, docs):
    got = shard_documents(docs, 4, rows_per_bucket=1).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["shard"] == (0 if r["doc_id"] is None else jump(r["doc_id"], 4)) and r["grown_shard"] in (r["shard"], 4)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shard_documents(docs.limit(0)).count() == 0


def test_sharding_keeps_clashing_columns_and_long_texts(spark):
    rows = [(i % 7 if i % 3 else None, "x" * (i * 5000), i, "b", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _before int, _bucket string, _rank int, size int")
    out = shard_documents(df, 3, rows_per_bucket=1)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "_before", "_bucket", "_rank", "shard", "grown_shard", "size", "text_crc32", "slot"]
    assert sorted(r["_before"] for r in got) == list(range(60)) and {(r["_bucket"], r["_rank"]) for r in got} == {("b", 1)}
    assert all(r["size"] == len(r["text"]) + 1 for r in got)
    for s in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_exact_dedup(spark, docs):
    for cut in (None, 0, 5, 100):
        got = ed.exact_dedup(docs, history_from=cut, per_bucket=2).collect()
        assert len(got) == len(ROWS)
        norm = {}
        for i, t in ROWS:
            norm.setdefault((t or "").encode().lower(), []).append(i)
        for r in got:
            key = next(k for k in norm if hashlib.sha256(k).hexdigest() == r["text_sha256"])
            ids = [i for i in norm[key] if i is not None]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(norm[key]), r["doc_id"] == max(ids))
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_large_batch_against_small_history(spark):
    """The history has one bucket; the batch's digests are dealt over many parts, each of which looks up in it."""
    rows = [(i, f"text {i % 150}") for i in range(400)] + [(10_000, "Text 7"), (10_001, "only here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ed.exact_dedup(docs, history_from=10_000, per_bucket=4).collect()}
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[t.lower()]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
    assert {i for i, r in got.items() if r["from_history"]} == {10_000, 10_001}


def test_history_is_cut_by_rows(spark):
    """One outlying doc_id does not empty the history."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(1 << 60, "far")], "doc_id bigint, text string")
    assert 45 <= ed.exact_dedup(docs).filter("from_history").count() <= 55


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_perfect_hash(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    seeds, slots = ed.build_bucket(digests)
    assert sorted(slots) == list(range(n))
    held = [d for _, d in sorted(zip(slots, digests, strict=True))]
    assert list(ed.look_up(seeds, n, held, digests)) == list(slots)
    assert (ed.look_up(seeds, n, held, [hashlib.sha256(b"no").digest()]) == -1).all()


def brute(rows, k, num):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []), []).append(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both and 100 * both >= num * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = {}
    for a, s in enumerate(keys):
        ids = [i for b in range(len(keys)) if find(b) == find(a) for i in sets[keys[b]]]
        for i in sets[s]:
            out[i] = (len(s), min(ids) if s else i, links[a])
    return out


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice((4, 11, 30, 90)))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("k, num, block", [(3, 90, 2_000_000), (5, 80, 400)])
def test_ngram_join(spark, k, num, block):
    rows = [*near_copies(k), (500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "a B c"), (506, "A b C")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in nj.ngram_join(df, k, num, 100, block=block).collect()}
    assert got == brute(rows, k, num)


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in nj.ngram_join(df, 3, 90, 100).collect()), key=str)
    assert got == [(7, 7, 2), (7, 7, 2), (None, 7, 2), (None, None, 0)]
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_ngram_join_tells_long_words_apart(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1)}


def test_ngram_join_of_long_texts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(nj, "LISTED", 0)
    monkeypatch.setattr(nj, "FLUSH", 500)
    rng = random.Random(9)
    long = [f"w{rng.randrange(9000)}" for _ in range(20_000)]
    rows = [*near_copies(4, 60), (700, " ".join(long)), (701, " ".join(long[:-40])), (702, " ".join(long[:9000])), (703, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows, 5, 80)


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (None, 2)) for i in range(n)], "k int, i int")
    groups = rows.filter("k <> 3").groupBy("k").agg(F.count("*").alias("_n"), F.max("i").alias("top"))
    got = sorted(map(tuple, common.salted_join(rows, groups, ["k"], 56, "left").collect()), key=str)
    assert got == sorted([(k, i, top) for k, n, top in ((1, 50, 49), (2, 3, 2), (3, 1, None), (None, 2, None)) for i in range(n)], key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def chunks_of(lines):
    """(first, lines) of the chunks of a text, from 0: boundaries where the hash of two lines is less than that before and not more than that after."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64(line.encode(), seed=42).intdigest() for line in lines]
    r = [signed(x ^ (h[i - 1] << 7 & (1 << 64) - 1 if i else 0)) for i, x in enumerate(h)]
    n = len(lines)
    ends = [i + 1 for i in range(n) if i == n - 1 or 0 < i < n - 2 and r[i] < r[i - 1] and r[i] <= r[i + 1]]
    return [(x, y - x) for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def deduplicated(texts):
    """Texts by id without chunks of two lines or more that stand elsewhere before, and without the lines beside them, in chunks that are less common, that are those beside the first one."""
    first, gone = {}, {i: set() for i in texts}
    count = Counter(tuple(t[at : at + n]) for t in texts.values() for at, n in chunks_of(t))
    common = lambda i, at, n: count[tuple(texts[i][at : at + n])] if n > 1 else 0
    for i in sorted(texts):
        cut = chunks_of(texts[i])
        for k, (at, n) in enumerate(cut):
            before, after = sum(x for _, x in cut[max(0, k - 2) : k]), sum(x for _, x in cut[k + 1 : k + 3])
            before = 0 if k and common(i, *cut[k - 1]) >= common(i, at, n) else before
            after = 0 if k + 1 < len(cut) and common(i, *cut[k + 1]) >= common(i, at, n) else after
            beside = texts[i][at - before : at][::-1], texts[i][at + n : at + n + after]
            chunk = tuple(texts[i][at : at + n])
            if n < 2:
                continue
            if chunk not in first:
                first[chunk] = beside
                continue
            gone[i].update(range(at, at + n))
            for own, other, step in zip(beside, first[chunk], (-1, 1), strict=True):
                for d, (x, y) in enumerate(zip(own, other, strict=False)):
                    if x != y:
                        break
                    gone[i].add(at - 1 - d if step < 0 else at + n + d)
    return {i: "\n".join(line for k, line in enumerate(texts[i]) if k not in gone[i]) for i in texts}, sum(map(len, gone.values()))


def test_line_dedup(spark):
    rng = random.Random(1)
    shared = [f"shared line {i}" for i in range(9)]
    texts = {i: [f"own {i} {j}" for j in range(rng.randrange(1, 6))] + (shared if i % 3 == 0 else shared[rng.randrange(4) :] if i % 5 == 0 else []) + [f"tail {i} {j}" for j in range(rng.randrange(4))] for i in range(30)}
    texts[31] = ["same"] * 40 + shared + shared + ["end"] * 7
    texts[32] = ["end", *shared[2:], "same", "same", "same"]
    rows = [(i, "\n".join(t), 5) for i, t in texts.items()] + [(98, None, 0), (99, "", 0), (None, "\n".join(shared), 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    codes = {r["doc_id"]: r["c"] for r in df.filter("doc_id < 90").select("doc_id", ld.chunk_codes(F.split("text", "\n", -1)).alias("c")).collect()}
    assert {i: [((c >> 32) - 1, c & ld.LOW) for c in codes[i]] for i in texts} == {i: chunks_of(t) for i, t in texts.items()}
    want, lost = deduplicated(texts)
    got = {r["doc_id"]: r for r in ld.line_dedup(df).collect()}
    assert {i: got[i]["text"] for i in texts} == want and sum(r["removed_lines"] for r in got.values()) == lost > 60
    assert got[98]["text"] is None and got[99]["text"] == "" and got[None]["text"] == "\n".join(shared)
    assert ld.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_rows_with_one_id_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 2)
    shared, own = "\n".join(f"shared {i}" for i in range(3)), "\n".join(f"own {i}" for i in range(3))
    rows = [(1, shared), (5, shared), (5, own), (5, own), (6, shared), (7, shared), (8, None), (None, shared)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, removed string, _doc string")
    got = sorted(((r["doc_id"], r["text"]) for r in ld.line_dedup(df).collect()), key=str)
    assert got == sorted([(1, shared), (5, ""), (5, own), (5, own), (6, ""), (7, ""), (8, None), (None, shared)], key=str)
    assert ld.line_dedup(df).columns[:4] == ["doc_id", "text", "removed", "_doc"]


def test_line_dedup_of_a_long_text(spark):
    lines = [f"line {i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["start", *lines[5000:], "end"]))], "doc_id bigint, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in ld.line_dedup(df).collect()}
    assert time.monotonic() - began < 60 and got[1]["removed_lines"] == 0 and got[2]["removed_lines"] == 15_000
    assert got[2]["text"].startswith("start\n") and got[2]["text"].endswith("\nend")


def test_line_dedup_removes_planted_passages(spark):
    rng = random.Random(7)
    passages = [[f"passage {b} line {j}" for j in range(12)] for b in range(40)]
    texts = [[f"own {i} {j}" for j in range(rng.randrange(3, 9))] + passages[i % 40] + [f"tail {i} {j}" for j in range(rng.randrange(3, 9))] for i in range(120)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sizes = [c & ld.LOW for r in df.select(ld.chunk_codes(F.split("text", "\n", -1)).alias("c")).collect() for c in r["c"]]
    assert min(sizes) >= 2 and 2.5 < sum(sizes) / len(sizes) < 3.5
    got = ld.line_dedup(df).collect()
    lost = [r["removed_lines"] for r in got if r["doc_id"] >= 40]
    assert sum(lost) > 0.97 * 12 * 80 and min(lost) > 0
    assert all(line in r["text"].split("\n") for r in got for line in texts[r["doc_id"]] if line[:3] in ("own", "tai"))


@pytest.mark.parametrize("num", (60, 80, 90))
def test_linked_sets_share_a_signature(num):
    rng = np.random.default_rng(num)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        own = nj.mix(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        a, b = np.unique(own), np.unique(np.concatenate((own[: max(1, n - int(rng.integers(0, 30)))], nj.mix(rng.integers(0, 1 << 63, int(rng.integers(0, 30)), dtype=np.uint64)))))
        common = len(np.intersect1d(a, b))
        if len(a) == len(b) == common or 100 * common < num * (len(a) + len(b) - common):
            continue
        linked += 1
        w = int(np.searchsorted(nj.size_bounds(num, 100), min(len(a), len(b)), "right")) - 1
        mine, other = dict(nj.signatures(a, num, 100)), dict(nj.signatures(b, num, 100))
        assert len(np.intersect1d(mine[w], other[w]))
    assert linked > 50


def test_shared_passages_do_not_chain(spark, monkeypatch):
    """Texts that share a third with their neighbours only are never searched together (they chained into one group that grew faster than the input)."""
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(61)]
    texts = [f"{passages[i]} {' '.join(f'v{rng.randrange(10**9)}' for _ in range(100))} {passages[i + 1]}" for i in range(60)]
    near = texts[0].rsplit(" ", 3)[0] + " x y z"
    docs = spark.createDataFrame(list(enumerate([*texts, near])), "doc_id long, text string")
    kept, stored = {}, nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in nj.ngram_join(docs, 5, 80, 100).collect()}
    assert got == {i: (0, 1) if i in (0, 60) else (i, 0) for i in range(61)}
    assert {r["class_id"] for r in kept["members"].select("class_id").distinct().collect()} == {0, 60}


@pytest.mark.parametrize(("num", "size"), [(80, 12), (80, 300), (90, 60), (50, 40)])
def test_linked_sets_are_in_one_part_of_a_list(num, size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, (6, 2 * size), dtype=np.uint64)
    sets = [np.unique(np.concatenate((b[: size - cut], b[size : size + cut]))) for b in base for cut in rng.integers(0, size // 2, 12)]
    sizes = np.array([len(s) for s in sets])
    bits = nj.profile_bits(int(np.searchsorted(nj.size_bounds(num, 100), sizes.min(), "right")) - 1, num, 100)
    part = nj.near_parts(sizes, np.stack([nj.folded(nj.profile_of(s, bits + 1), bits) for s in sets]), num, 100)
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))]
    assert linked and all(part[a] == part[b] for a, b in linked)
    assert num < 80 or len(set(part.tolist())) >= 6
