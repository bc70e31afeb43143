"""Selection under budgets, priors, densities, mills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.functions.classify import BLUE_CHIP, skip_lot, strong_art

FEWEST_EVENTS, MOST_BOOST = 8, 1.0
MILL_NAMES, MILL_CLAIMS = 3, 8
SATURATION = 400


def admit(rows: DataFrame, budget: str, order: list[Column], cost: str, cap: Column) -> DataFrame:
    """Best first while the spend is below the cap: attempted where what came before is below it, completed where the row itself still ends below it. Costs are added as decimals, in any order the same."""
    before = F.sum(F.col(cost).cast("decimal(18,4)")).over(Window.partitionBy(budget).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    spent = before.cast("double")
    return rows.withColumn("spent", spent).withColumns({"attempted": (F.col("spent") - F.col(cost).cast("decimal(18,4)").cast("double")) < cap, "completed": F.col("spent") < cap})


def judged(events: DataFrame) -> DataFrame:
    """(category, good, bad) of each reaction. A dismissal because the object is a reproduction is none of the category's fault. events: category, kind, reason."""
    good = F.col("kind").isin("save", "promote")
    bad = (F.col("kind") == "dismiss") & (F.coalesce("reason", F.lit("")) != "print/repro")
    return events.select(F.coalesce(F.lower("category"), F.lit("other")).alias("category"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(bad, F.lit(False)).alias("bad"))


def boosted(counts: DataFrame) -> DataFrame:
    """(category, positive, negative, boost) of the categories with enough events: half the log odds, from -1 to 1. counts: category, positive, negative."""
    boost = F.ln((F.col("positive") + 1) / (F.col("negative") + 1)) / 2
    enough = counts.select("category", "positive", "negative").filter(F.col("positive") + F.col("negative") >= FEWEST_EVENTS)
    return enough.withColumn("boost", F.round(F.greatest(F.lit(-MOST_BOOST), F.least(F.lit(MOST_BOOST), boost)), 6))


def taste_prior(events: DataFrame) -> DataFrame:
    """(category, positive, negative, boost) of a ledger's reactions; see judged and boosted."""
    return boosted(judged(events).groupBy("category").agg(F.count_if("good").alias("positive"), F.count_if("bad").alias("negative")))


def art_density(lots: DataFrame) -> DataFrame:
    """(auction, lots, density): the share of lots with an unambiguous art signal. lots: auction, title, detail."""
    return lots.groupBy("auction").agg(F.count("*").alias("lots"), F.avg(strong_art(F.col("title"), F.col("detail")).cast("double")).alias("density"))


def mills(lots: DataFrame, names: int = MILL_NAMES, claims: int = MILL_CLAIMS) -> DataFrame:
    """(auction, masters, claims, mill): famous names claimed as originals; honest prints and copies don't count. A sale's equal titles are read once."""
    name = F.lower(F.regexp_extract("title", BLUE_CHIP, 1))
    titles = lots.groupBy("auction", "title").agg(F.count("*").alias("_n"))
    own = titles.withColumn("_name", F.when((name != "") & ~skip_lot(F.col("title")), name))
    claimed = F.sum(F.when(F.col("_name").isNotNull(), F.col("_n")).otherwise(F.lit(0)))
    out = own.groupBy("auction").agg(F.array_sort(F.collect_set("_name")).alias("masters"), claimed.alias("claims"))
    return out.withColumn("mill", (F.size("masters") >= names) | (F.col("claims") >= claims))


def ranked_sales(sales: DataFrame, known: DataFrame, watched: DataFrame, fewest: int, preferred: list[int]) -> DataFrame:
    """Sales of watched places with enough pictures that are not known, ranked: preferred types, then more pictures up to a saturation, beyond it fewer. sales: id, place, pictures, type."""
    rows = sales.filter(F.col("pictures") >= fewest).join(watched.select("place").distinct(), "place", "left_semi").join(known.select("id").distinct(), "id", "left_anti")
    # ranks come from counts of the few distinct sort keys, so no task orders all rows; ids order only within one of them
    key = F.struct(F.when(F.col("type").isin(*preferred), 0).otherwise(1).alias("a"), (-F.least("pictures", F.lit(SATURATION))).alias("b"), F.col("pictures").alias("c"))
    keyed = rows.withColumn("_k", key)
    counts = keyed.groupBy("_k").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("_k").orderBy("id"))
    return keyed.withColumn("_in", inner).join(counts.drop("_c"), "_k").withColumn("rank", F.col("_before") + F.col("_in")).drop("_k", "_in", "_before")


def evenly_spaced(rows: DataFrame, group: str, order: list[str], k: int = 3) -> DataFrame:
    """Up to k rows of each group, every n/k-th in order."""
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / k))
    return rows.withColumns({"_at": at, "_step": step}).filter((F.col("_at") % F.col("_step") == 0) & (F.col("_at") < F.col("_step") * k)).drop("_at", "_step")


def best_first(works: DataFrame) -> DataFrame:
    """works with `score` by signature, label, prominence and type. works: sig_visible, label_visible, prominence, coarse_type."""
    kind = F.col("coarse_type")
    base = F.when(kind == "painting", 2.0).when(kind == "drawing", 1.5).when(kind.isin("sculpture", "ceramic"), 1.0).when(kind == "unknown", 0.75).otherwise(0.5)
    return works.withColumn("score", F.col("sig_visible") * 3.0 + F.col("label_visible") * 2.0 + F.when(F.col("prominence") == "background", 1.0).otherwise(0.0) + base)
