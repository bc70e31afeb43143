"""Language-model scores: counts of all training tokens, and a log-bilinear model (Mnih and Hinton, 2007) trained by noise-contrastive estimation (Gutmann and Hyvarinen; Mnih and Teh, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import stored
from salesignal.llm.tokens import mix, text_parts, words_of

#: Classes of the model: the most frequent words are one each, all other words (unknown ones too) share those of their last two bytes.
OWN, ENDINGS = 448, 64
K = OWN + ENDINGS
#: Numbers of a word's vector, and noise classes a batch of training rows is told apart from.
WIDTH, NOISE, BATCH = 16, 256, 1024
#: Passes over the training rows, rows that one task trains on, and the step of the gradient in the first pass; in the n-th it is an n-th of that.
ROUNDS, SHARD, STEP = 2, 1 << 21, 0.15
#: Words, at most, whose counts are sent to all tasks; counts of others are joined.
HEAD = 1 << 19
#: Tokens that a task adds up before it sends them on.
HELD = 1 << 22
END = int(mix(np.array([77], np.uint64))[0].astype(np.int64))


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, endings, offsets) of lower-cased texts' tokens: 64-bit hashes of the words and END after each text, the class of each word's last two bytes, and each text's first token, with an end.

    Two words share a key with odds of 2**-64.
    """
    hashes, at = words_of(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.flatnonzero(gap[1:] & ~gap[:-1])
    before = np.where((last > 0) & ~gap[last - 1], raw[last - 1], 0).astype(np.uint64)
    ending = (mix(before * np.uint64(256) + raw[last]) % np.uint64(ENDINGS)).astype(np.int64)
    offsets = at + np.arange(len(at))
    ends = offsets[1:] - 1
    keys, endings = np.full(offsets[-1], END, np.int64), np.zeros(offsets[-1], np.int64)
    word = np.ones(len(keys), bool)
    word[ends] = False
    keys[word], endings[word] = hashes.astype(np.int64), ending
    return keys, endings, offsets


def _summed(values: Iterator[np.ndarray], held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct numbers and how often they occur, for every `held` numbers or so."""
    parts, n = [], 0
    for v in values:
        parts.append(v)
        n += len(v)
        if n >= held:
            yield np.unique(np.concatenate(parts), return_counts=True)
            parts, n = [], 0
    if parts:
        yield np.unique(np.concatenate(parts), return_counts=True)


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, ending, n) of all tokens of texts (a binary column), one row for each distinct token."""

    def counted(batches):
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def keys():
            for batch in batches:
                for _, part in text_parts(batch.column(0)):
                    key, ending, _ = token_stream(part)
                    seen.append((key, ending))
                    yield key

        for distinct, n in _summed(keys()):
            key, ending = (np.concatenate(x) for x in zip(*seen, strict=True))
            seen.clear()
            of = np.empty(len(distinct), np.int64)
            of[np.searchsorted(distinct, key)] = ending
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(of), pa.array(n)], names=["key", "ending", "n"])

    return texts.mapInArrow(counted, "key bigint, ending bigint, n bigint").groupBy("key").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the counts: the most frequent words (sorted keys, counts, classes), the total and number of distinct tokens, and for each class of endings the tokens and distinct words in it."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    own: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes_of(self, keys: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Class of each token: that of END is 0, the most frequent words have one each, others that of their ending."""
        place = np.minimum(np.searchsorted(self.own[:, 0], keys), len(self.own) - 1)
        return np.where(self.own[place, 0] == keys, self.own[place, 1], OWN + endings)

    def noise(self) -> np.ndarray:
        """Probability of each class among the training tokens, none of them 0."""
        n = np.ones(K)
        n[self.own[:, 1]] += self.own[:, 2]
        n[OWN:] += self.class_tokens
        return n / n.sum()

    def share_in_class(self) -> np.ndarray:
        """log10 of what a class's word counts, plus 1, are divided by: 0 for the classes of one word. One place of a class is that of its unknown words."""
        out = np.zeros(K)
        out[OWN:] = np.log10(self.class_tokens + self.class_words + 1)
        return out


def _grade(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 16)


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary of stored counts, and the least grade of its words: grades are sixteenths of a power of two, the lowest such that at most `head` words reach it. About a thousand grades, ENDINGS sums and `head` words come to the driver, however many words there are."""
    by_grade = sorted((int(r["g"]), r["words"], r["tokens"]) for r in counts.groupBy(_grade(F.col("n")).alias("g")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect())
    least, words = (by_grade[-1][0] + 1 if by_grade else 0), 0
    for g, n, _ in reversed(by_grade):
        if words + n > head:
            break
        least, words = g, words + n
    known = counts.filter((_grade(F.col("n")) >= least) | (F.col("key") == END)).toArrow()
    key, ending, n = (known.column(c).to_numpy() for c in ("key", "ending", "n"))
    order = np.lexsort((key, -n))
    order = np.concatenate((order[key[order] == END], order[key[order] != END]))[:OWN]
    own = np.column_stack((key[order], np.arange(len(order)), n[order]))
    if not len(own):
        own = np.array([[END, 0, 0]])
    class_tokens, class_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        class_tokens[r["ending"]], class_words[r["ending"]] = r["n"], r["words"]
    np.subtract.at(class_tokens, ending[order], n[order])
    np.subtract.at(class_words, ending[order], 1)
    own = own[np.argsort(own[:, 0])]
    found = Vocabulary(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), own, sum(x[2] for x in by_grade), sum(x[1] for x in by_grade), class_tokens, class_words)
    order = np.argsort(key)
    found.keys, found.counts, found.classes = key[order], n[order].astype(float), found.classes_of(key[order], ending[order])
    return found, least


def contexts(keys: np.ndarray, endings: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of each token, of the token before it and of the one before that; before a text stand ends."""
    own = vocabulary.classes_of(keys, endings)
    one, two = np.zeros_like(own), np.zeros_like(own)
    one[1:], two[2:] = own[:-1], own[:-2]
    first = offsets[:-1]
    one[first] = two[first] = 0
    second = first + 1
    two[second[second < offsets[1:]]] = 0
    return own, one, two


def training_rows(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """(code, n) of all training tokens: the classes of a token and of the two before it as one number, and how often they occur."""
    held = texts.sparkSession.sparkContext.broadcast(known)

    def gathered(batches):
        def codes():
            for batch in batches:
                for _, part in text_parts(batch.column(0)):
                    own, one, two = contexts(*token_stream(part), held.value)
                    yield (two * K + one) * K + own

        for code, n in _summed(codes()):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(gathered, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """The vector that two tokens predict is that of the one before through `near` plus that of the one before that through `far`; a class scores by its product with the class's own vector, plus the class's bias."""

    seen: np.ndarray
    near: np.ndarray
    far: np.ndarray
    made: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.seen, self.near, self.far, self.made, self.bias]

    @staticmethod
    def start(noise: np.ndarray, width: int = WIDTH) -> LogBilinear:
        """Scores near the noise's own probabilities."""
        rng = np.random.default_rng(2024)
        k = len(noise)
        return LogBilinear(rng.normal(0, 0.3, (k, width)), np.eye(width), np.eye(width) / 2, rng.normal(0, 0.3, (k, width)) / 2, np.log(noise))

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64).tobytes()

    def unpacked(self, numbers: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return LogBilinear(*[x.reshape(p.shape) for x, p in zip(np.split(numbers, cuts), self.parts(), strict=True)])

    def trained(self, own: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray, noise: np.ndarray, seed: int, step: float) -> LogBilinear:
        """One pass of Adagrad over weighted rows in the order given. Each batch is told apart from NOISE classes drawn from `noise`, the same for all its rows, so all scores are matrix products."""
        rng = np.random.default_rng(seed)
        k, width = self.seen.shape
        seen, near, far, made, bias = (p.astype(np.float32) for p in self.parts())
        grown = [np.full(p.shape, 1e-6, np.float32) for p in (seen, near, far, made, bias)]
        offset = np.log(NOISE * noise).astype(np.float32)
        cells = np.arange(width)

        def spread(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.bincount((rows[:, None] * width + cells).ravel(), values.ravel(), k * width).reshape(k, width)

        for a in range(0, len(own), BATCH):
            w, c1, c2 = own[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            weight = n[a : a + BATCH].astype(np.float32)
            weight = (weight / weight.sum())[:, None]
            drawn = rng.choice(k, NOISE, p=noise)
            r1, r2, q, qn = seen[c1], seen[c2], made[w], made[drawn]
            h = r1 @ near + r2 @ far
            true = 1 / (1 + np.exp((h * q).sum(axis=1) + bias[w] - offset[w]))  # one less the odds that the row is real
            false = 1 / (1 + np.exp(offset[drawn] - bias[drawn] - h @ qn.T))
            up = weight * true[:, None]
            down = weight * false
            dh = up * q - down @ qn
            made_by = spread(w, up * h)
            np.subtract.at(made_by, drawn, down.T @ h)
            bias_by = np.bincount(w, up[:, 0], k) - np.bincount(drawn, down.sum(axis=0), k)
            seen_by = spread(c1, dh @ near.T) + spread(c2, dh @ far.T)
            for p, g, own_grown in zip((seen, near, far, made, bias), (seen_by, r1.T @ dh, r2.T @ dh, made_by, bias_by), grown, strict=True):
                own_grown += g * g
                p += (step * g / np.sqrt(own_grown)).astype(np.float32)
        return LogBilinear(*[p.astype(np.float64) for p in (seen, near, far, made, bias)])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, bias, log of the sum over all classes by far and near token), in natural logarithms. A score is a sum of a near and a far part, so the sums for all pairs of tokens are one product of two matrices of exponentials."""
        near, far = self.seen @ self.near @ self.made.T, self.seen @ self.far @ self.made.T
        a, b = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        c = self.bias.max()
        total = (np.exp(far - b) * np.exp(self.bias - c)) @ np.exp(near - a).T
        return near, far, self.bias, np.log(total) + a.T + b + c


def fit_log_bilinear(rows: DataFrame, noise: np.ndarray, rounds: int = ROUNDS, shard: int = SHARD) -> LogBilinear:
    """The model of stored (code, n) rows, all of them. In each round tasks train from the same start on a shard each, and the mean of their parameters, weighted by tokens, is the next start.

    Rows are dealt into shards by a hash of their code, a row of many tokens in several parts of a few mean weights, so no batch is ruled by one; order within a shard is that of the hash. So the result depends neither on partitions nor on which executor ran a task. A shard sends its parameters alone; as codes are K**3 at most, shards are 2 * K**3 / shard at most.
    """
    model = LogBilinear.start(noise)
    sums = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if not sums["rows"]:
        return model
    most = max(1, 4 * sums["n"] // sums["rows"])
    shards = -(-2 * sums["rows"] // shard)
    dealt = rows.withColumns({"_parts": F.ceil(F.col("n") / most)}).select("code", (F.col("n") / F.col("_parts")).alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))).alias("part"))
    dealt = stored(dealt.withColumn("place", F.xxhash64("code", "part")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")), "shards")

    def trainer(start: LogBilinear, seed: int):
        def trained(group: pa.Table) -> pa.Table:
            order = np.lexsort((group.column("code").to_numpy(), group.column("place").to_numpy()))
            code, n = group.column("code").to_numpy()[order], group.column("n").to_numpy()[order]
            context, own = np.divmod(code, K)
            two, one = np.divmod(context, K)
            after = start.trained(own, one, two, n, noise, seed, STEP / (seed + 1))
            return pa.table({"shard": group.column("shard")[:1].combine_chunks(), "n": [float(n.sum())], "numbers": [after.packed()]})

        return trained

    for i in range(rounds):
        parts = dealt.groupBy("shard").applyInArrow(trainer(model, i), "shard int, n double, numbers binary").collect()
        parts.sort(key=lambda r: r["shard"])
        model = model.unpacked(np.average([np.frombuffer(bytes(r["numbers"])) for r in parts], axis=0, weights=[r["n"] for r in parts]))
    return model


def lm_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of the whole text.

    train: a condition on docs; tokens of rows that meet it are counted and trained on, all of them. A token's probability is that of its class after the two tokens before it, by the log-bilinear model normalised over all classes, times (count + 1) / (tokens + words of the class + 1) where the class is shared; each shared class holds one place for unknown words, and base_score one for all of them. Counts of the most frequent words are sent to all tasks; counts of others come by a join of each text's distinct rare words.

    A null text is an empty one, whose one token is its end. Without training rows every token counts 0. Rows that repeat a doc_id, or have none, are scored each. docs may have any other columns.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = plain.filter("train").select("text")
    counts = stored(token_counts(texts), "counts")
    known, least = vocabulary(counts, head)
    model = fit_log_bilinear(stored(training_rows(texts, known), "contexts"), known.noise(), rounds)
    near, far, bias, total = (t / np.log(10) for t in model.tables())
    held = spark.sparkContext.broadcast((known, near.astype(np.float32), (far + bias).astype(np.float32), total.astype(np.float32)))

    def scored(batches):
        vocab, near, far, total = held.value
        share = vocab.share_in_class()
        log_count = np.append(np.log10(vocab.counts + 1), 0.0)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            tails: list[tuple[np.ndarray, np.ndarray]] = []
            for _, part in text_parts(batch.column(1)):
                keys, endings, offsets = token_stream(part)
                own, one, two = contexts(keys, endings, offsets, vocab)
                classed = near[one, own].astype(float) + far[two, own] - total[two, one] - share[own]
                distinct, back = np.unique(keys, return_inverse=True)
                place = np.searchsorted(vocab.keys, distinct)
                found = np.append(vocab.keys, 0)[place] == distinct
                found &= place < len(vocab.keys)
                counted = np.where(found, log_count[place], 0.0)[back]
                frequent = found[back]
                first = offsets[:-1]
                for column, values in zip(out, (np.ones(len(keys)), frequent, counted, classed, np.where(own >= OWN, counted, 0.0)), strict=True):
                    column.append(np.add.reduceat(values.astype(float), first))
                rare = np.flatnonzero(~frequent)
                of = np.searchsorted(offsets, rare, "right") - 1
                pairs = np.stack((of, keys[rare]))
                for i in range(len(first)):
                    tails.append(np.unique(pairs[1, np.searchsorted(of, i) : np.searchsorted(of, i, "right")], return_counts=True))
            numbers = [np.concatenate(c) if c else np.zeros(0) for c in out]
            sizes = np.cumsum([0, *[len(k) for k, _ in tails]]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([t[x] for t in tails]) if tails else np.zeros(0, np.int64))) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.astype(np.int64)) for x in numbers[:2]], *[pa.array(x) for x in numbers[2:]], *lists], names=["doc_id", "n_tokens", "n_known", "log_count", "classed", "log_in_class", "rare", "times"])

    kind = dict(docs.dtypes)[doc_id]
    rows = plain.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_tokens bigint, n_known bigint, log_count double, classed double, log_in_class double, rare array<bigint>, times array<bigint>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # written once, so the numbers stay
    # a rare word that was counted: all of them have a class of their ending, unless they are ends
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("_r")).select("row", F.col("_r.rare").alias("key"), F.col("_r.times").alias("times"))
    rare = counts.filter((_grade(F.col("n")) < least) & (F.col("key") != END)).select("key", "n")
    met = asked.join(rare, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_log"), F.sum("times").alias("_known"))
    more = F.coalesce("_log", F.lit(0.0))
    return rows.join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * float(np.log10(known.tokens + known.distinct + 1))).alias("base_score"), (F.col("classed") + F.col("log_in_class") + more).alias("score"),
    )
