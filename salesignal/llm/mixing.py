"""Mixing by soft membership: posteriors of domains from a classifier learned on the labelled table, then document rates whose expected domain token totals meet target weights."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import stored
from salesignal.llm.tokens import text_parts, words_of

#: Labelled documents that the classifier is fitted on at most: those with the smallest hash of doc_id.
MOST_TRAINED = 20_000
BUCKETS = 1 << 16
DOMAINS = ("high", "low", "toxic")
#: Share of the budget by which a domain may miss its target without a warning.
MISSED = 1e-3


def domain_of(quality: Column, toxic: Column) -> Column:
    """0 high, 1 low, 2 toxic; null where neither label is known."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _features(column):
    """For runs of an Arrow column's texts: index of the first, buckets of all features, the offset of each text's first feature, words of each text. A word is two features: itself, and its last two bytes."""
    for first, part in text_parts(column):
        words, at = words_of(part)
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        ends = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
        tail = raw[np.maximum(ends - 2, 0)].astype(np.int64) * 256 + raw[ends - 1]
        features = np.empty(2 * len(words), np.int64)
        features[0::2] = (words % np.uint64(BUCKETS)).astype(np.int64)
        features[1::2] = BUCKETS + tail
        yield first, features, 2 * at, np.diff(at)


def fit_domains(rows: DataFrame, k: int = len(DOMAINS)) -> tuple[np.ndarray, np.ndarray]:
    """(log P(feature | domain), log prior) from (text binary, domain int) rows, a bounded sample. Tasks count the features they meet, a shuffle adds them up by feature, and 2 * BUCKETS numbers a domain come to the driver, however large the table is."""

    def counted(batches):
        count, docs = np.zeros((k, 2 * BUCKETS)), np.zeros(k)
        for batch in batches:
            domains = np.array(batch.column("domain").to_pylist(), np.int64)
            for first, features, at, _ in _features(batch.column("text")):
                own = np.repeat(domains[first : first + len(at) - 1], np.diff(at))
                count += np.bincount(own * (2 * BUCKETS) + features, minlength=k * 2 * BUCKETS).reshape(k, -1)
            docs += np.bincount(domains, minlength=k)
        domain, feature = np.nonzero(np.column_stack((docs, count)))
        yield pa.RecordBatch.from_arrays([pa.array(domain), pa.array(feature - 1), pa.array(np.column_stack((docs, count))[domain, feature])], names=["domain", "feature", "n"])

    count, docs = np.zeros((k, 2 * BUCKETS)), np.zeros(k)
    summed = rows.mapInArrow(counted, "domain bigint, feature bigint, n double").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    own = summed["feature"] >= 0
    count[summed["domain"][own], summed["feature"][own]] = summed["n"][own]
    docs[summed["domain"][~own]] = summed["n"][~own]
    overall = count.sum(axis=0)
    smooth = 0.5 + 50 * (overall + 0.5) / (overall + 0.5).sum()
    likelihood = np.log(count + smooth) - np.log((count + smooth).sum(axis=1, keepdims=True))
    return likelihood.astype(np.float32), np.log((docs + 1) / (docs.sum() + k))


def domain_posteriors(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_TRAINED, sharpness: float = 24.0) -> DataFrame:
    """(doc_id, tokens, p): words of each row's whole text and the posteriors of DOMAINS.

    Naive Bayes over hashed words and word ends. Features of one text depend on one another, so its mean log likelihood counts as that of min(features, sharpness) independent ones. A text without words gets the prior. Labels join by doc_id; a document labelled twice counts once, with the larger domain number.
    """
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    likelihood, prior = fit_domains(plain.join(F.broadcast(known), "doc_id").select("text", "domain"))
    model = docs.sparkSession.sparkContext.broadcast((likelihood.T.copy(), prior))

    def predicted(batches):
        by_feature, log_prior = model.value
        for batch in batches:
            tokens, posterior = [], []
            for _, features, at, words in _features(batch.column(1)):
                sums = np.concatenate((np.zeros((1, len(log_prior))), np.cumsum(by_feature[features], axis=0, dtype=np.float64)))
                n = np.diff(at)
                mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]
                z = log_prior + mean * np.minimum(n, sharpness)[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                posterior.append(z / z.sum(axis=1, keepdims=True))
                tokens.append(words)
            p = np.concatenate(posterior) if posterior else np.zeros((0, len(log_prior)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(log_prior)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), flat], names=["doc_id", "tokens", "p"])

    return plain.mapInArrow(predicted, f"doc_id {dict(docs.dtypes)[doc_id]}, tokens bigint, p array<double>")


def _dot(p: Column, g: Sequence[Column], k: int) -> Column:
    out = p[0] * g[0]
    for i in range(1, k):
        out = out + p[i] * g[i]
    return out


def _sums(rows: DataFrame, lams: np.ndarray, start: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each multiplier (a row of lams), over all rows, with u = p . multiplier and rate = start - u clipped to 0..most: sums of tokens * rate * p; of tokens * p * p' where the rate is not clipped; of tokens times the integral of the rate; and of tokens * most where u < 0, times -u (the largest that the totals can be in the direction of -multiplier). One pass; a task sends its sums alone."""
    m, k = lams.shape

    def summed(batches):
        z, h, q, reach = np.zeros((m, k)), np.zeros((m, k, k)), np.zeros(m), np.zeros(m)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(t), k)
            u = p @ lams.T
            v = start - u
            rate = np.clip(v, 0.0, most)
            x = rate * t[:, None]
            z += x.T @ p
            q += (x * (v - rate / 2)).sum(axis=0)
            reach += most * (t @ np.maximum(-u, 0.0))
            free = ((v > 0) & (v < most)) * t[:, None]
            for i in range(k):
                h[:, i] += free.T @ (p * p[:, i : i + 1])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((z.ravel(), h.ravel(), q, reach)).tobytes()])], names=["sums"])

    parts = rows.filter("tokens > 0 and p is not null").select(F.col("tokens").cast("double"), "p").mapInArrow(summed, "sums binary").collect()
    total = np.sum([np.frombuffer(bytes(r[0])) for r in parts], axis=0) if parts else np.zeros(m * (k + k * k + 2))
    z, h, q, reach = np.split(total, np.cumsum((m * k, m * k * k, m)))
    return z.reshape(m, k), h.reshape(m, k, k), q, reach


#: Weight of the rates' own change against the missed targets, small enough that missed targets decide; budgets tried in one pass; how near to the largest budget the search comes.
CHANGE, TRIED, NEAR = 1e-6, 8, 5e-3
#: Lengths of a Newton step that are tried in one pass.
LENGTHS = np.array((1.0, 0.5, 0.2, 0.07, 0.02))


def fit_rates(rows: DataFrame, targets: Sequence[float], budget: float | None = None, most: float = 1.0, anchor: int | None = None, close: float = 1e-4, at_most: bool = False) -> tuple[DataFrame, list[float]]:
    """(rows with `rate`, residual of each domain as a share of the budget).

    rows: tokens and p, stored. Minimises the squared distance, whitened by the domains' moments per token, of the expected totals sum(rate * tokens * p) from targets * budget, over rates from 0 to most; of the rates that reach the same totals, those that change fewest tokens (squared change of the rate, weighted by tokens, from 1). Such a rate is 1 - p . multiplier, clipped, with k multipliers for the whole table, so a row's rate does not depend on its length and nothing of a row is kept or sent. The multipliers follow from Newton steps with line search on the dual, each one pass of sums; a step is the last when the rates are the nearest point for targets moved by a tenth of `close` at most. Distance to a convex set changes by no more than the target moves, so this bounds the error.

    budget: tokens to come out. Not given: with anchor, what makes that domain's own expected total exactly its share; else the largest that can be met to `close`, within NEAR of it. It is searched between a budget that was met and one that cannot be: a direction in which all totals within the bounds stay behind the target proves that. If no budget can be met, or the given one cannot, the rates are those of the nearest point and the residual tells by how much.
    """
    k = len(targets)
    w = np.array(targets, float)
    if (w < 0).any() or w.sum() <= 0:
        raise ValueError("targets must be 0 or more, one at least above 0")
    w = w / w.sum()
    start = min(1.0, most)
    t, p = F.col("tokens").cast("double"), F.col("p")
    sums = rows.agg(*[F.sum(t * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    supply = np.array([sums[f"s{i}"] or 0.0 for i in range(k)])
    if supply.sum() <= 0:
        return rows.withColumn("rate", F.lit(1.0)), [0.0] * k
    if at_most and anchor is not None and w[anchor] > 0:
        held = np.minimum(w / w[anchor] * supply[anchor], supply)
        w = held / held.sum() if held.sum() > 0 else w
    fixed = budget is not None or anchor is not None
    if budget is None:
        able = [supply[i] / w[i] for i in range(k) if w[i] > 0]
        budget = supply[anchor] / w[anchor] if anchor is not None and w[anchor] > 0 else most * min(able)
    moments = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    ridge = CHANGE * (moments + 1e-4 * np.trace(moments) * np.eye(k))

    def nearest(budgets: np.ndarray, prove: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """(multipliers, residuals, least budget proved too large) for each budget; with prove, one that is proved too large is left where it stands, with an infinite residual."""
        n, aims = len(budgets), budgets[:, None] * w
        at, step, longest = np.zeros((n, k)), np.zeros((n, k)), np.ones(n)
        value, slope, residual, bound = np.full(n, np.inf), np.zeros(n), np.zeros((n, k)), np.inf
        open_ = np.ones(n, bool)
        while open_.any():
            asked = np.flatnonzero(open_)
            lengths = longest[asked, None] * LENGTHS
            tried = at[asked, None] + lengths[:, :, None] * step[asked, None]
            z, h, q, reach = (v.reshape(len(asked), len(LENGTHS), *v.shape[1:]) for v in _sums(rows, tried.reshape(-1, k), start, most))
            ahead = -(tried @ w) - close * np.abs(tried).sum(axis=2)
            bound = min(bound, np.min(reach[ahead > 0] / ahead[ahead > 0], initial=np.inf))
            values = ((tried @ ridge) * tried).sum(axis=2) / 2 + (tried * aims[asked, None]).sum(axis=2) + q
            for y, x in enumerate(asked):
                best = int(np.argmin(values[y]))
                if not values[y, best] < value[x] + 1e-4 * lengths[y, best] * slope[x] or values[y, best] >= value[x]:
                    longest[x] = lengths[y, -1] / 4
                    open_[x] = longest[x] > 1e-9  # no step lowers the value any more: it is the least to the last digits
                    continue
                lam = at[x] = tried[y, best]
                value[x], residual[x], longest[x] = values[y, best], z[y, best] - aims[x], 1.0
                gradient = ridge @ lam - residual[x]
                if np.abs(gradient).max() <= 0.1 * close * budgets[x]:
                    open_[x] = False
                    continue
                step[x] = -np.linalg.solve(ridge + h[y, best], gradient)
                slope[x] = gradient @ step[x]
            if prove:
                lost = open_ & (budgets > bound)
                residual[lost], open_[lost] = np.inf, False
        return at, residual / budgets[:, None], bound

    found = None
    if not fixed:
        low, high = 0.0, budget
        shares = np.arange(1, TRIED + 1) / TRIED
        while found is None and high > NEAR * budget or found is not None and low < (1 - NEAR) * high:
            budgets = low + (high - low) * shares
            at, residual, bound = nearest(budgets, True)
            met = np.flatnonzero(np.abs(residual).max(axis=1) <= close)
            best = met[-1] if len(met) else -1
            if best >= 0:
                low, found = budgets[best], (at[best], residual[best])
            if low == budget:
                break
            high = max(low, min(bound, budgets[best + 1] if best + 1 < TRIED else high))
            shares = np.arange(1, TRIED + 1) / (TRIED + 1)
    if found is None:
        at, residual, _ = nearest(np.array([budget]), False)
        found = at[0], residual[0]
    lam, residual = found
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.lit(start) - _dot(p, [F.lit(float(x)) for x in lam], k)))
    return rows.withColumn("rate", F.when((t > 0) & p.isNotNull(), clipped).otherwise(F.lit(start))), residual.tolist()


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = (0.85, 0.13, 0.02), doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each row of docs: doc_id, tokens, p (posteriors of DOMAINS), domain (the likeliest), rate and residual.

    residual, the same in each row, is what the domains' expected totals miss of their targets, as shares of the budget; a warning tells of more than MISSED. Null and empty texts have no tokens and keep the starting rate: they change no total. Null ids, repeated rows and other columns are carried like any. An empty table gives an empty result.
    """
    rows = stored(domain_posteriors(docs, labels, doc_id, text), "posteriors")
    rated, residual = fit_rates(rows, targets, **options)
    if max(map(abs, residual)) > MISSED:
        warnings.warn(f"targets of mixing are missed by {residual} of the budget", stacklevel=2)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return rated.select("doc_id", "tokens", "p", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("domain"), "rate", F.array(*[F.lit(float(x)) for x in residual]).alias("residual"))


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float], seed: int = 0, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs drawn at their rates (at most 1): a row stays when the hash of its doc_id, a fixed number from 0 to 1, is below its rate, so the draw is the same on every run. Rows without doc_id stay; rows that repeat one are drawn together, at the largest of their rates."""
    rates = mixed_rates(docs, labels, targets, doc_id, text, **options).filter("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate")).withColumnRenamed("doc_id", "key")
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the rates
    own = F.col(private[doc_id])
    draw = F.shiftrightunsigned(F.xxhash64(own, F.lit(seed)), 11).cast("double") / float(1 << 53)
    return docs.toDF(*private.values()).join(rates, own == F.col("key"), "left").filter(F.coalesce(draw < F.col("rate"), own.isNull())).select(*[F.col(i).alias(c) for c, i in private.items()])
