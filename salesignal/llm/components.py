"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import salted_join, stored


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges, component being the smallest node reachable.

    Minima are pre-aggregated before each shuffle, so a node with very many edges costs its tasks one row each, and its edges are dealt over several tasks when its minimum is joined back. Rounds grow with the logarithm of the nodes; each round's edges are a table in the shared folder. Edges with a null end are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, mark = _marked(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = salted_join(both.filter(F.col("v") > F.col("u")), least, ["u"], mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = salted_join(large, least, ["u"], mark[0]).select(F.greatest("v", "m").alias("x"), F.col("m"), F.col("u"))
        pairs = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now, seen = _marked(pairs.filter(F.col("u") != F.col("v")).distinct())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    ends = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stored table, and their number and a digest."""
    now = stored(edges, "edges")
    return now, tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
