"""Language identification by compression: the language whose text, as a zstandard dictionary, makes a text smallest."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of training text in a language's dictionary, and documents drawn for it, at most on average.
DICTIONARY, DOCS = 1 << 17, 400
#: Bytes of all dictionaries: beyond 256 languages each gets an equal part, down to LEAST_DICTIONARY.
ALL_DICTIONARIES, LEAST_DICTIONARY = 1 << 25, 1 << 12
LEVEL = 6
#: Smallest lead over the second language, as a share of the smallest size, that is not rejected.
MARGIN = 0.01
NO_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's letter classes (signs such as a half or a circled digit are not)."""
    return any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    """Lower case, with one space for each run of signs and digits: they say nothing about the language."""
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


#: Languages whose counts are sent to all tasks; beyond these, which no table of documents holds, counts and texts meet by shuffle.
MOST_SENT = 100_000


def learn_dictionaries(rows: DataFrame, per_language: int = DOCS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw-content dictionaries by language from (doc_id, text, lang) rows: a bounded sample of labelled rows, drawn by the hash of doc_id at a rate that gives each language per_language documents. Every language of the rows gets one.

    Of a drawn text longer than a 32nd of a dictionary, a piece of that length is taken at a place that the hash of doc_id chooses, so that a dictionary holds many documents and not their beginnings alone. What a dictionary can't hold never comes to the driver.
    """
    rows = rows.filter("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return {}
    size = min(size, max(LEAST_DICTIONARY, ALL_DICTIONARIES // languages))
    piece = max(1, size // 32)
    key = F.xxhash64("doc_id")
    draw = F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)
    at = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.length("text") - (piece - 1))).cast("int") + 1
    # counts go to the texts: a join by language would bring a language's texts into one task
    drawn = rows.join(F.broadcast(counts) if languages <= MOST_SENT else counts, "lang").filter(draw * F.col("n") < per_language).select("lang", F.substring("text", at, F.lit(piece)).alias("text"), draw.alias("draw"))
    drawn = drawn.groupBy("lang", "text").agg(F.min("draw").alias("draw"))
    before = Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1)
    kept = drawn.withColumn("held", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))).filter(F.col("held") < size)
    parts: dict[str, list[tuple[float, str]]] = defaultdict(list)
    for r in kept.select("lang", "draw", "text").toLocalIterator():
        parts[r["lang"]].append((r["draw"], r["text"]))
    return {lang: b"\n".join(prepared(t) for _, t in sorted(own))[:size] for lang, own in parts.items()}


class Compressors:
    """A compressor for each language, made once in a task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.each = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score, rejected)."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        raw = prepared(text)
        sizes = sorted((len(c.compress(raw)), i) for i, c in enumerate(self.each))
        best = sizes[0][0]
        lead = sizes[1][0] - best if len(sizes) > 1 else best
        return self.langs[sizes[0][1]], lead / (lead + 4.0), lead < max(1, MARGIN * best)


def identified(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", level: int = LEVEL) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs.

    Whole texts are compressed with each language's dictionary; the smallest wins, the alphabetically first of equals. score grows from 0 to 1 with the bytes by which the second is larger; rejected marks a lead below MARGIN. Null texts and texts without a letter, or no dictionaries: und, 0, rejected. Other columns are ignored, repeated rows each get a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predicted(batches):
        known = Compressors(held.value, level)
        for batch in batches:
            langs, scores, rejected = [], [], []
            for t in batch.column(1):
                a, b, c = known.predict(t.as_py())
                langs.append(a)
                scores.append(b)
                rejected.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(predicted, f"doc_id {dict(docs.dtypes)[doc_id]}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, train: Column) -> DataFrame:
    """identified() with dictionaries learned from the rows of docs (doc_id, text, lang) that train selects."""
    return identified(docs, learn_dictionaries(docs.filter(train).select("doc_id", "text", "lang")))
