"""Importance resampling, filter audit and language-model scores against plain loops on constructed rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesignal.llm import filter_audit as fa
from salesignal.llm import importance as im
from salesignal.llm import lm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-Z]")


def lowered(text):
    return UPPER.sub(lambda m: m.group().lower(), text or "")


def prose(rng, n, alphabet="abcde"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(60)), "en" if i % 3 else "fr") for i in range(120)]
    rows += [(200, None, None), (201, "", ""), (None, prose(rng, 30), "en"), (202, "Ünï, CÖDE 42 " * 30, "de"), (203, " \n\t ", "en"), (204, "same Text\x0bhere " * 9, "fr"), (205, "same Text\x0bhere " * 9, "fr"), (205, "same Text\x0bhere " * 9, "fr")]
    rows += [(300, prose(rng, 60_000), "en"), (301, "x" * 200_000, "en"), (302, "A# B$ " * 120, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # columns with names that the operators use for themselves
    return rows, frame.select("*", *[F.lit(c).alias(c) for c in ("n_words", "score", "weight", "rank", "digest", "first", "part", "row", "key", "n", "train", "rare", "_n")])


def ngrams_of(words, least, most):
    return [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 2), (2, 3)])
def test_importance_draw(spark, least, most):
    rows, docs = documents(spark)
    targets = [("1", "abc de abc"), ("2", None), ("3", "CÖDE 42 cöde")]
    target = spark.createDataFrame(targets, "item_id string, text string")
    buckets = 97
    words = [WORD.findall(lowered(t)) for _, t, _ in rows]
    features = [[zlib.crc32(g.encode()) % buckets for g in ngrams_of(w, least, most)] for w in words]
    s, t = Counter(b for f in features for b in f), Counter(zlib.crc32(g.encode()) % buckets for _, x in targets for g in ngrams_of(WORD.findall(lowered(x)), least, most))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    want = []
    for (i, _, _), w, f in zip(rows, words, features, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"5:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {k: n for n, k in enumerate(able[: len(able) * 3 // 10], 1)}
    got = im.importance_draw(docs, target, 3, 10, 20, ngrams=(least, most), buckets=buckets, seed="5").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert {tuple(r)[:5]: r["rank"] for r in got if r["rank"]} == drawn
    kept = im.importance_resampled(docs, target, num=3, den=10, ngrams=(least, most), buckets=buckets, seed="5")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k[0] for k in drawn if k[0] is not None}


def test_ranks_over_many_ranges_and_ties(spark, monkeypatch):
    monkeypatch.setattr(im, "RANGE", 7)
    rng = random.Random(3)
    rows = [(i, 1, 1, 5 if i % 3 else rng.randrange(9)) for i in range(100)] + [(3, 1, 1, 5), (None, 1, 1, 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint")
    got = sorted((r["rank"], r["score"], r["doc_id"]) for r in im.ranked(frame, len(rows)).filter("doc_id is not null or rank > 0").collect() if r["doc_id"] is not None)
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0]))
    assert [(n, r[3], r[0]) for n, r in enumerate(want, 1) if r[0] is not None] == got


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    target = spark.createDataFrame([("1", "a b")], "item_id string, text string")
    assert im.importance_draw(none, target).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "c " * 30)], "doc_id bigint, text string")
    got = im.importance_draw(docs, target.limit(0), 1, 2).collect()
    assert sum(r["rank"] is not None for r in got) == 1


def audited(rows, labels):
    """The audit by going through all orders and documents."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(UPPER.findall(t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        parts.setdefault(lang or "", []).append((fails, any(q == 1 for q, _ in labels.get(i, [])), any(x == 1 for _, x in labels.get(i, []))))
    out = {}
    for part, found in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(d[0][f] for d in found) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rows, docs = documents(spark)
    rng = random.Random(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(90)] + [(3, 1, 0), (None, 1, 1), (204, 1, 1), (999, 1, 1)]
    known = {}
    for i, q, x in labels:
        if i is not None:
            known.setdefault(i, []).append((q, x))
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in fa.document_audit(docs, frame).collect()}
    assert got == audited(rows, known) and len(got) == 120 * 5 * len({lang or "" for _, _, lang in rows})
    assert fa.document_audit(docs.limit(0), frame).count() == 0
    unlabelled = fa.document_audit(docs, frame.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert unlabelled[0] == unlabelled[1] == 0 < unlabelled[2]


def test_diagram_shares_nodes_and_swaps_levels():
    masks = {m: (1, 0, 0) for m in range(32)}
    d = fa.Diagram(masks, 5)
    assert len(d.branches) == 5  # equal subdiagrams are one node a level
    for n in range(1, 6):
        order, seen = list(range(n)), []
        for s in fa.adjacent_orders(n):
            if s is not None:
                order[s], order[s + 1] = order[s + 1], order[s]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def tokens(text):
    return [*SPACED.findall(lowered(text)), None]


def test_lm_scores_are_those_of_plain_counts_and_a_normalised_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 1000)
    rows, docs = documents(spark)
    fold = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in rows]
    counts = Counter(t for (_, text, _), own in zip(rows, fold, strict=True) if own for t in tokens(text))
    N, V = sum(counts.values()), len(counts)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    want = []
    for i, text, _ in rows:
        own = tokens(text)
        want.append((i, len(own), sum(counts[t] > 0 for t in own), N, sum(math.log10((counts[t] + 1) / (N + V + 1)) for t in own)))
    # counts sent to all tasks, or most of them joined: the same scores
    results = []
    for head in (1 << 19, 20):
        monkeypatch.setattr(lm, "OWN", 448)
        results.append(lm.lm_scores(docs, train, head=head).collect())
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    for got in results:
        got = sorted((tuple(r) for r in got), key=key)
        for a, b in zip(got, sorted(want, key=key), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and a[5] < 0


def test_score_is_the_product_of_the_models_probabilities(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40, "ab" if i % 2 else "xyz")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = F.col("doc_id") % 5 != 0
    texts = docs.filter(train).select(F.col("text").cast("binary").alias("text"))
    counted = lm.token_counts(texts).cache()
    known, _ = lm.vocabulary(counted)
    model = lm.fit_log_bilinear(lm.training_rows(texts, known), known.noise())
    near, far, bias, total = model.tables()
    every = near[:, None, :] + far[None, :, :] + bias - total.T[:, :, None]
    assert np.abs(np.exp(every[:40, :40]).sum(axis=2) - 1).max() < 1e-9
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, train).collect()}
    counts = dict(zip(known.keys.tolist(), known.counts.tolist(), strict=True))
    for i, text in rows[:20]:
        keys, endings, offsets = lm.token_stream([text.encode()])
        own = known.classes_of(keys, endings)
        want, two, one = 0.0, 0, 0
        for k, c in zip(keys.tolist(), own.tolist(), strict=True):
            want += every[one, two, c] / math.log(10)
            if c >= lm.OWN:
                want += math.log10((counts.get(k, 0) + 1) / (known.class_tokens[c - lm.OWN] + known.class_words[c - lm.OWN] + 1))
            two, one = one, c
        assert got[i]["score"] == pytest.approx(want, rel=1e-4)
    held = [r for r in got.values() if r["doc_id"] % 5 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)


def test_lm_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 50)) for i in range(200)], "doc_id bigint, text string")
    one, many = (sorted(tuple(r) for r in lm.lm_scores(docs.repartition(n), F.col("doc_id") > 30).collect()) for n in (1, 7))
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(one, many, strict=True))


def test_lm_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r) for r in lm.lm_scores(docs, F.lit(False)).collect()}
    assert got[1][:5] == (1, 3, 0, 0, 0.0) and got[2][1] == 1 and got[1][5] < 0
    assert lm.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_token_stream_counts_an_end_for_each_text():
    keys, endings, offsets = lm.token_stream([b"ab  cd\x0bab", b"", b" \t", b"a"])
    assert offsets.tolist() == [0, 4, 5, 6, 8] and keys[0] == keys[2] and (keys[[3, 4, 5, 7]] == lm.END).all() and endings[0] == endings[2]
    assert lm.token_stream([b"x a"])[1][1] == lm.token_stream([b"a"])[1][0] == lm.token_stream([b"\na"])[1][0]


def test_ngram_buckets_of_a_sliced_column():
    texts = pa.array(["zz", "A b a b", None, "b"])[1:]
    found = {n: (of.tolist(), bucket.tolist()) for n, of, bucket in im.ngram_buckets(texts.fill_null(""), 1, 2, 1 << 32)}
    assert found[1] == ([0, 0, 0, 0, 2], [zlib.crc32(w) for w in (b"a", b"b", b"a", b"b", b"b")])
    assert found[2] == ([0, 0, 0], [zlib.crc32(w) for w in (b"a b", b"b a", b"a b")])
