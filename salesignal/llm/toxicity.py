"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases and a score that allows for length."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import doc_key_crc, stored
from salesignal.llm.folding import fold, folded

#: Labelled documents that the lexicon is learned from at most: those with the smallest hash of doc_id.
MOST_TRAINED = 20_000
#: Lengths of the word beginnings that are terms beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
FEWEST_DOCS = 3


@dataclass
class Lexicon:
    """terms: " word " for whole words, " beginning" for words that begin so, with weights; exceptions: " phrase " in which no term counts; coefficients of the logistic score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.0)


def _terms_of(text: str) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


def _gain(a: Column, b: Column, na: int, nb: int) -> Column:
    """Log-likelihood ratio of a term in a of na documents and b of nb, 0 where it is no more frequent in the first."""
    p = (a + b) / float(na + nb)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)

    out = part(a, p * na) + part(na - a, (1 - p) * na) + part(b, p * nb) + part(nb - b, (1 - p) * nb)
    return F.when(a * nb > b * na, out * 2).otherwise(0.0)


def training_rows(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: int = MOST_TRAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label): one row for each distinct text among at most `most` labelled documents of the training fold, a bounded sample in the order of the id's hash."""
    # a document labelled twice counts as the larger label
    picked = labels.filter(train & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked), "doc_id")
    return stored(rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min_by("text", "doc_id").alias("text"), F.max("label").alias("label")).select("text", "label"), "training")


def learn_lexicon(rows: DataFrame, least_gain: float | None = None) -> Lexicon:
    """A lexicon from (text, label) rows, at most MOST_TRAINED. Every term of FEWEST_DOCS toxic documents or more that passes a likelihood-ratio test, which allows for how many were tried, is kept; weights are log odds. No label of either kind: an empty lexicon."""
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    if not na or not nb:
        return Lexicon()

    def terms(batches):
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                count[label].update(_terms_of(t))
        for label, found in enumerate(count):
            yield _counted(list(found), list(found.values()), [label] * len(found), "term")

    n = F.col("n").cast("double")
    counts = rows.select("text", "label").mapInArrow(terms, "term string, n bigint, label int").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, n).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("label") == 0, n).otherwise(0.0)).alias("b"))
    counts = stored(counts.filter(F.col("a") >= FEWEST_DOCS), "terms")
    least = 2 * math.log(20 * (counts.count() + 1)) if least_gain is None else least_gain
    weight = F.ln((F.col("a") + 0.5) / (na + 1)) - F.ln((F.col("b") + 0.5) / (nb + 1))
    kept = counts.select("term", weight.alias("weight"), _gain(F.col("a"), F.col("b"), na, nb).alias("gain")).filter((F.col("gain") > least) & (F.col("weight") > 1))
    lexicon = Lexicon({r["term"]: round(min(r["weight"], 8.0), 4) for r in sorted(kept.collect())})
    lexicon.exceptions = _exceptions(rows, lexicon, na, nb)
    lexicon.coefficients = _calibrated(rows, lexicon)
    return lexicon


def _counted(names: list[str], n: list[int], labels: list[int], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(labels, pa.int32())], names=[name, "n", "label"])


def _exceptions(rows: DataFrame, lexicon: Lexicon, na: int, nb: int) -> tuple[str, ...]:
    """Phrases of a matched word and a neighbour that benign documents use and toxic ones do not."""
    found = rows.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(batches):
        matcher = Matcher(found.value)
        count: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                count.update({(p, label) for p in matcher.phrases(text)})
        yield _counted([p for p, _ in count], list(count.values()), [label for _, label in count], "phrase")

    if not lexicon.terms:
        return ()
    counts = rows.select("text", "label").mapInArrow(phrases, "phrase string, n bigint, label int").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("benign"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    least = F.lit(FEWEST_DOCS)
    return tuple(sorted(r["phrase"] for r in counts.filter((F.col("benign") >= least) & (F.col("toxic") * (4 * nb) < F.col("benign") * na)).collect()))


def _calibrated(rows: DataFrame, lexicon: Lexicon) -> tuple[float, ...]:
    """Logistic coefficients by Newton's method on the training rows' two figures (at most MOST_TRAINED rows of 24 bytes come to the driver)."""
    got = rows.select(measured(F.col("text"), lexicon).alias("m"), "label").select("m.weight", "m.density", "label").toPandas()
    x = np.column_stack([np.ones(len(got)), np.log1p(got["weight"]), np.log1p(100 * got["density"])])
    y = got["label"].to_numpy(float)
    w = np.array([-2.0, 0.5, 0.0])
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 6) for v in w)


class Matcher:
    """An Aho-Corasick automaton of a lexicon, built once in a task."""

    def __init__(self, lexicon: Lexicon):
        self.auto = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.auto.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        self.empty = not lexicon.terms
        if not self.empty:
            self.auto.make_automaton()

    def matches(self, text: str) -> tuple[dict[int, float], int, str]:
        """Weight of the heaviest term at each word's start outside exception phrases, the number of words, and the folded text between two spaces."""
        codes = fold(text)
        space = np.concatenate(([True], codes == 32))
        words = int(np.count_nonzero(space[:-1] & ~space[1:])) if len(codes) else 0
        spread = f" {codes.tobytes().decode('utf-32-le')} "
        hits: dict[int, float] = {}
        edges = np.zeros(len(spread) + 1, np.int32)  # +1 where an exception phrase begins, -1 where it ends
        excused = False
        if not self.empty:
            for end, (n, weight) in self.auto.iter(spread):
                at = end - n + 1
                if weight is None:
                    edges[at] += 1
                    edges[end] -= 1
                    excused = True
                else:
                    hits[at] = max(weight, hits.get(at, 0.0))
        if excused:
            inside = np.cumsum(edges) > 0
            hits = {at: weight for at, weight in hits.items() if not inside[at]}
        return hits, words, spread

    def measure(self, text: str | None) -> tuple[float, float, int]:
        hits, words, _ = self.matches(text or "")
        total = sum(hits.values())
        return total, total / (words + 1), len(hits)

    def phrases(self, text: str) -> set[str]:
        hits, _, spread = self.matches(text)
        out = set()
        for at in hits:  # at is the space before a word, whose neighbours may be any number of spaces away
            end = spread.index(" ", at + 1)
            own = spread[at + 1 : end]
            before = _word(spread, at - 1, -1)
            after = _word(spread, end + 1, 1)
            if before:
                out.add(f" {before} {own} ")
            if after:
                out.add(f" {own} {after} ")
        return out


def _word(spread: str, at: int, step: int) -> str:
    """The whole word nearest to `at` in the direction of step; empty where there is none. spread begins and ends with a space."""
    while 0 <= at < len(spread) and spread[at] == " ":
        at += step
    if not 0 <= at < len(spread):
        return ""
    return spread[spread.rindex(" ", 0, at) + 1 : spread.index(" ", at)]


def measured(text: Column, lexicon: Lexicon) -> Column:
    """struct(weight, density, hits) of a text: the sum of its matches' weights, that sum over its words, their number. Null counts as empty."""

    @F.pandas_udf("weight double, density double, hits int")
    def measure(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Matcher(lexicon))
        return pd.DataFrame([held[0].measure(t) for t in texts], columns=["weight", "density", "hits"])

    held: list[Matcher] = []
    return measure.asNondeterministic()(text)


def score_column(m: Column, lexicon: Lexicon) -> Column:
    c0, c1, c2 = lexicon.coefficients
    z = F.lit(c0) + F.lit(c1) * F.log1p(m["weight"]) + F.lit(c2) * F.log1p(m["density"] * 100)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None, most: int = MOST_TRAINED) -> DataFrame:
    """docs with `toxicity` (0 to 1, higher: likelier toxic) and `toxic_hits`.

    The lexicon is learned from labels.toxic of training documents (train: a condition on labels' doc_id) unless one is given; scores depend on the text alone. Null and empty texts score as texts without a match; texts of any length are read whole. Without labels all score the prior. Columns of docs with those two names are replaced.
    """
    lexicon = lexicon or learn_lexicon(training_rows(docs, labels, "toxic", F.lit(True) if train is None else train, most, doc_id, text))
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the measures
    m = F.col("measured")
    out = docs.toDF(*private.values()).withColumn("measured", measured(F.col(private[text]).cast("string"), lexicon))
    new = {"toxicity": score_column(m, lexicon), "toxic_hits": m["hits"]}
    return out.select(*[F.col(i).alias(c) for c, i in private.items() if c not in new], *[v.alias(k) for k, v in new.items()])


def in_training(doc_id: str = "doc_id", folds: int = 5, held: int = 0) -> Column:
    return doc_key_crc(F.col(doc_id)) % folds != held
