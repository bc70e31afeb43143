"""Matches by rule: houses, fragments, perceptual hashes, greedy clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.functions.keys import houses_match
from salesignal.session import checkpointed


def matched_houses(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (a_key, b_key) of houses that match. Candidates share the first word of one name among the words of the other, so nothing is crossed; the rule is then checked.

    a: a_key. b: b_key.
    """
    left = a.select("a_key").filter("a_key <> ''").distinct().withColumns({"first": F.split("a_key", " ")[0], "words": F.array_distinct(F.split("a_key", " "))})
    right = b.select("b_key").filter("b_key <> ''").distinct().withColumns({"first": F.split("b_key", " ")[0], "words": F.array_distinct(F.split("b_key", " "))})
    one = left.select("a_key", F.explode("words").alias("w")).join(right.select("b_key", F.col("first").alias("w")), "w")
    two = left.select("a_key", F.col("first").alias("w")).join(right.select("b_key", F.explode("words").alias("w")), "w")
    return one.unionByName(two).select("a_key", "b_key").distinct().filter(houses_match(F.col("a_key"), F.col("b_key")))


def exclusive_houses(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose a_key is not blank and matches no b_key."""
    hit = matched_houses(a, b).select("a_key").distinct()
    return a.filter("a_key <> ''").join(hit, "a_key", "left_anti")


def first_fragment(names: DataFrame, fragments: list[str], name: str = "name") -> DataFrame:
    """names with `fragment`, the first in the list that the name contains in lower case, null without one. The list is configuration, not data."""
    found = F.lit(None).cast("string")
    for f in reversed(fragments):
        found = F.when(F.lower(F.col(name)).contains(f.lower()), f).otherwise(found)
    return names.withColumn("fragment", found)


def fragment_matches(names: DataFrame, fragments: DataFrame, name: str = "name", q: int = 4) -> DataFrame:
    """names with `fragment`, of a table's fragments the first by pos that the name contains in lower case, null without one.

    A name that contains a fragment contains each run of q letters of it, so names and fragments meet by an equi-join on the one run of each fragment that fewest names have (a fragment of fewer letters is its own run), and what meets is checked. Distinct names are looked at once. fragments: pos, fragment; empty ones are in no name. Null names contain nothing.
    """
    parts = fragments.select("pos", F.lower("fragment").alias("fragment")).filter("fragment <> ''").groupBy("fragment").agg(F.min("pos").alias("pos"))
    own = names.select(F.col(name).alias("_name")).filter("_name is not null").distinct().withColumn("_lower", F.lower("_name"))

    def runs(text: Column, n: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, n)))

    sizes = F.array(*[F.lit(n) for n in range(1, q + 1)])
    used = parts.select(F.least(F.length("fragment"), F.lit(q)).alias("n")).distinct()
    spread = own.select("_name", "_lower", F.explode(sizes).alias("n")).join(F.broadcast(used), "n").select("_name", "_lower", F.explode(runs(F.col("_lower"), F.col("n"))).alias("run"))
    asked = parts.select("pos", "fragment", F.explode(runs(F.col("fragment"), F.least(F.length("fragment"), F.lit(q)))).alias("run"))
    common = spread.join(asked.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    chosen = asked.join(common, "run", "left").groupBy("pos", "fragment").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), F.col("run"))).alias("run"))
    met = spread.join(chosen, "run").filter(F.col("_lower").contains(F.col("fragment"))).groupBy("_name").agg(F.min_by("fragment", "pos").alias("fragment"))
    return names.join(met, F.col(name) == F.col("_name"), "left").drop("_name")


def sign_hash(vector: Column) -> Column:
    """The signs of 64 numbers as one whole number."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def hex_hash(text: Column) -> Column:
    """16 hexadecimal digits as a whole number."""
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(rows: DataFrame, most: int, group: str = "group", key: str = "id", code: str = "hash") -> DataFrame:
    """(group, a, b, distance) of all pairs of a group at most `most` bits apart, a < b. Codes are cut in most + 1 bands; two that near agree in one band at least, so pairs meet by an equi-join on (group, band, bits)."""
    bands = most + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(code), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
    spread = rows.select(F.col(group).alias("group"), F.col(key).alias("id"), F.col(code).alias("hash"), F.explode(parts).alias("p")).select("group", "id", "hash", "p.band", "p.bits")
    a, b = spread.alias("a"), spread.alias("b")
    met = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.id") < F.col("b.id")))
    near = met.filter(hamming(F.col("a.hash"), F.col("b.hash")) <= most)
    return near.select(F.col("a.group").alias("group"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming(F.col("a.hash"), F.col("b.hash")).alias("distance")).distinct()


def greedy_clusters(rows: DataFrame, most: int, group: str = "group", key: str = "id", code: str = "hash", size: str = "size") -> DataFrame:
    """(group, id, cluster): rows of a group, largest first, each join the earliest cluster that has any member at most `most` bits away, else open one; clusters never merge. cluster is the id that opened it, its largest row.

    A row's cluster is thus opened by the first in order of all rows that lead to it along near pairs, each from the earlier to the later row. That is found by joins, without a walk through a group: in each round a row takes the first opener known to its earlier near rows, until no row changes. Rounds are as many as the longest of these ways has steps; each round's openers are checkpointed. An id that repeats in a group counts once, at its largest size. A row without code or group is near no other, one without size comes last.
    """
    place = F.struct(F.col(size).isNull().alias("unknown"), (-F.col(size)).alias("size"), F.col(key).alias("id"))
    own = rows.groupBy(F.col(group).alias("group"), F.col(key).alias("id")).agg(F.min(place).alias("place"))
    pairs = hamming_pairs(rows, most, group, key, code).select("group", "a", "b").distinct()
    first, second = (own.select("group", F.col("id").alias(x), F.col("place").alias(f"{x}_place")) for x in "ab")
    forward = F.col("a_place") < F.col("b_place")
    near = pairs.join(first, ["group", "a"]).join(second, ["group", "b"]).select("group", F.when(forward, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(forward, F.col("a")).otherwise(F.col("b")).alias("earlier"))
    near = checkpointed(near)
    now = checkpointed(own.withColumns({"opener": F.col("place"), "moved": F.lit(True)}))
    while not now.filter("moved").isEmpty():
        told = near.join(now.filter("moved").select("group", F.col("id").alias("earlier"), F.col("opener").alias("told")), ["group", "earlier"])
        told = told.groupBy("group", "id").agg(F.min("told").alias("told"))
        moved = F.coalesce(F.col("told") < F.col("opener"), F.lit(False))
        now = now.join(told, ["group", "id"], "left").select("group", "id", "place", F.when(moved, F.col("told")).otherwise(F.col("opener")).alias("opener"), moved.alias("moved"))
        now = checkpointed(now)
    return now.select("group", "id", F.col("opener.id").alias("cluster"))
