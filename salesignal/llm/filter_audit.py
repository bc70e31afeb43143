"""Audit of filters that overlap: what each removes in every order they can be applied in, from count-weighted decision diagrams of failure masks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import LOWER, UPPER, let, salted_join, stored

#: Figures that a diagram counts: documents, those of good quality, those that are toxic.
COUNTED = ("n", "good", "toxic")
MOST_FILTERS = 8


class Diagram:
    """An ordered decision diagram over filters: at each level a node asks whether one filter fails; terminals hold counts, and a node weighs what both its branches weigh.

    Equal subdiagrams are one node. Levels are never left out, so every path asks all filters, and the weight of a branch is the count of the masks behind it.
    """

    def __init__(self, masks: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.zero = (0,) * len(next(iter(masks.values()), COUNTED))
        self.ids, self.known = count(), {}
        self.weight: dict[int, tuple[int, ...]] = {}
        self.branches: dict[int, tuple[int, int]] = {}
        level = {m: self._terminal(masks.get(m, self.zero)) for m in range(1 << filters)}
        # bit i of a mask is filter i's; the last filter's level is built first, the first one's is the root
        for bit in reversed(range(filters)):
            level = {m: self._node(bit, level[m], level[m | 1 << bit]) for m in range(1 << bit)}
        self.root = level[0]

    def _terminal(self, counts: tuple[int, ...]) -> int:
        key = ("counts", counts)
        if key not in self.known:
            self.known[key] = x = next(self.ids)
            self.weight[x] = counts
        return self.known[key]

    def _node(self, level: int, passes: int, fails: int) -> int:
        key = (level, passes, fails)
        if key not in self.known:
            self.known[key] = x = next(self.ids)
            self.branches[x] = passes, fails
            self.weight[x] = tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails], strict=True))
        return self.known[key]

    def swap(self, at: int) -> None:
        """Exchanges the filters of levels `at` and at + 1. Only nodes of these two levels change: of the four subdiagrams below, the two in the middle change places."""
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
        new: dict[int, int] = {}

        def lower(x: int, level: int) -> int:
            if x not in new:
                passes, fails = self.branches[x]
                if level < at:
                    new[x] = self._node(level, lower(passes, level + 1), lower(fails, level + 1))
                else:
                    (a, b), (c, d) = self.branches[passes], self.branches[fails]
                    new[x] = self._node(at, self._node(at + 1, a, c), self._node(at + 1, b, d))
            return new[x]

        self.root = lower(self.root, 0)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight that stays, weight that goes) along the path on which all filters pass."""
        x = self.root
        for f in self.order:
            passes, fails = self.branches[x]
            yield f, self.weight[passes], self.weight[fails]
            x = passes


def adjacent_orders(n: int) -> Iterator[int | None]:
    """Levels to swap so that all orders of n filters come up once each, the first without a swap (Steinhaus, Johnson and Trotter: the n-th item sweeps through every order of the others)."""
    if n < 2:
        yield None
        return
    down = True
    for inner in adjacent_orders(n - 1):
        yield inner if inner is None or down else inner + 1  # the sweeping item stands last before it goes down, and first after
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        down = not down


def audit(masks: dict[int, tuple[int, ...]], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters, from the counts of a part's failure masks."""
    k = len(names)
    diagram = Diagram(masks, k)
    failing = [sum(c[0] for m, c in masks.items() if m >> f & 1) for f in range(k)]
    unique = [masks.get(1 << f, diagram.zero)[0] for f in range(k)]
    rows, shapley = [], [0] * k
    for swap in adjacent_orders(k):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(names[f] for f in diagram.order)
        for step, (f, kept, gone) in enumerate(diagram.steps(), 1):
            shapley[f] += gone[0]
            rows.append((f, order, step, kept[0], gone[0], failing[f] - gone[0], unique[f], gone[1], gone[2]))
    return [(*r[1:], shapley[r[0]]) for r in rows]


SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def filter_audit(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """SCHEMA rows for each part and order of the filters (named by one letter each, MOST_FILTERS at most) and each step of it: what is kept after the step, removed by it, removed before though its filter fails too, failing that filter alone, good and toxic documents among the removed, and what the filter removes summed over all orders.

    filters: conditions under which a row fails; one that is null doesn't fail. Rows are counted by part and mask before they meet, so a group holds one row a mask, however large a part is. Conditions good and toxic that are null don't count. An empty table gives an empty result.
    """
    if not 0 < len(filters) <= MOST_FILTERS or any(len(n) != 1 for n in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, named by one letter each")
    names = "".join(filters)
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    counts = rows.select(part.alias("part"), mask.alias("mask"), good.alias("good"), toxic.alias("toxic")).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    def audited(group: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): tuple(map(int, c)) for m, c in zip(group["mask"], group[list(COUNTED)].to_numpy(), strict=True)}
        out = pd.DataFrame(audit(masks, names), columns=[c.split()[0] for c in SCHEMA.split(", ")[1:]])
        out.insert(0, "part", group["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(audited, SCHEMA)


def document_filters(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: A few words, B few distinct words, C many capitals, D signs of markup. Null counts as empty. Words are what stands between the six ASCII spaces."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # struct(words, distinct words), with the words bound once
    sizes = let(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": sizes["all"] < 100, "B": 100 * sizes["distinct"] < 80 * sizes["all"], "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def document_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """filter_audit of document_filters and E: the text is that of a smaller doc_id, removed or not.

    Texts are read once; what is kept of a document is its id, part, mask and the SHA-256 of its text, by which equal texts meet. Rows of a text that very many documents share are dealt over several tasks. A null text is an empty one. A row without doc_id is no later copy, and none of it; rows that repeat a doc_id are no copies of one another. A null part is the empty one. A document labelled twice is good, or toxic, if one label says so.
    """
    found = document_filters(F.col("_text"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    read = stored(plain.select("doc_id", "part", *[fails.alias(n) for n, fails in found.items()], F.unhex(F.sha2(F.col("_text"), 256)).alias("digest")), "masks")
    groups = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n"))
    rows = salted_join(read, groups, ["digest"], read.count())
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("_id"), "left")
    filters = {n: F.col(n) for n in found} | {"E": F.col("doc_id") > F.col("first")}
    return filter_audit(rows, filters, F.col("part"), F.col("_good") == 1, F.col("_toxic") == 1)
