"""Upserts as rewrites: (old, new, key) -> all rows afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What is there stays; of new rows with one key the first in order is added."""
    return old.unionByName(_first(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti"))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of a key wins; new rows are later than old ones."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return _first(both, keys, [F.col("_age"), *order]).drop("_age")


def _outer(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    joined = old.alias("o").join(new.alias("n"), reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "full_outer")
    return joined, [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Named columns take the new value where there is one; others keep the old. new has one row a key."""
    joined, key = _outer(old, new, keys)
    rest = [c for c in old.columns if c not in keys]
    return joined.select(*key, *[(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in columns else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in rest])


def upsert_unless(old: DataFrame, new: DataFrame, keys: list[str], protected: Column) -> DataFrame:
    """New rows replace old ones except where protected (of o.*) holds."""
    joined, key = _outer(old, new, keys)
    kept = F.col(f"n.{keys[0]}").isNull() | F.coalesce(protected, F.lit(False))
    return joined.select(*key, *[F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c not in keys])


def upsert_fill(old: DataFrame, new: DataFrame, keys: list[str], greatest: tuple[str, ...] = (), sets: tuple[str, ...] = ()) -> DataFrame:
    """Only gaps are filled; columns in greatest rise, comma lists in sets are united, in order."""
    joined, key = _outer(old, new, keys)

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in greatest:
            return F.greatest(o, n)
        if c in sets:
            return F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(F.split(F.coalesce(o, F.lit("")), ","), F.split(F.coalesce(n, F.lit("")), ",")), lambda x: x != ""))), ",")
        return F.coalesce(o, n)

    return joined.select(*key, *[merged(c).alias(c) for c in old.columns if c not in keys])


def upsert_add(old: DataFrame, new: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in amounts])


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")
