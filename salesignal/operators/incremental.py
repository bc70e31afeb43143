"""Incremental rules over tables of state: look-back, settling, quotas, caches, notices, pending counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_sightings(rows: DataFrame, key: list[str], at: str, order: list[str], hours: int) -> DataFrame:
    """A key's rows that come more than `hours` after its previous row, its first one included."""
    before = F.lag(at).over(Window.partitionBy(*key).orderBy(at, *order))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return rows.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > hours * 3_600_000_000)).drop("_gap")


def settled(rows: DataFrame, ends: str, now: Column, hours: int) -> DataFrame:
    return rows.filter(F.col(ends) <= now - F.expr(f"INTERVAL {hours} HOURS"))


def within(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return rows.filter(F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS"))


def cache_misses(asked: DataFrame, cache: DataFrame, key: list[str], at: str, now: Column, days: int) -> DataFrame:
    """Keys without an entry younger than `days`; an entry of a failed lookup counts like any."""
    fresh = cache.filter(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS")).select(*key).distinct()
    return asked.select(*key).distinct().join(fresh, key, "left_anti")


def daily_quota(rows: DataFrame, key: list[str], at: str, order: list[str], quota: int) -> DataFrame:
    """rows with `taken`: whether a row is among the first `quota` of its key and day."""
    w = Window.partitionBy(*key, F.to_date(at)).orderBy(at, *order)
    return rows.withColumn("taken", F.row_number().over(w) <= quota)


def news(rows: DataFrame, key: str, at: str, verdict: str, order: list[str]) -> DataFrame:
    """rows with `notice`: first for a key's first row, changed where the verdict differs from the last row's, else null."""
    w = Window.partitionBy(key).orderBy(at, *order)
    last, n = F.lag(verdict).over(w), F.row_number().over(w)
    return rows.withColumn("notice", F.when(n == 1, "first").when(~F.col(verdict).eqNullSafe(last), "changed"))


def pending_step(first: float | None, held: int, count: int, now: float, fewest: int = 12, growth: int = 5, days: int = 14) -> tuple[float | None, int, bool]:
    """One poll of a sale with few pictures: (first seen or None once it is done, pictures held, emitted). It enters below `fewest`, is emitted at `fewest` with `growth` more than before, and is forgotten after `days`."""
    if first is None:
        return (now, count, False) if count < fewest else (None, count, True)
    if now - first > days * 86400:
        return None, held, False
    if count >= fewest and count >= held + growth:
        return None, count, True
    return first, count, False


def current_state(log: DataFrame, key: str, state: str, at: str, order: str) -> DataFrame:
    """The latest state of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(at, order)).alias(state), F.max(at).alias(at))
