"""Valuation: comparable-sales estimates, market summaries, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.session import checkpointed

# Widths, half-life and boosts of the weights, and the clamp of the yearly trend.
SIZE_SIGMA, YEAR_SIGMA, HALF_LIFE, SERIES_BOOST = 0.55, 9.0, 6.0, 1.7
MISSING_SIZE, MISSING_YEAR, MISSING_SALE, MOST_TREND, FEWEST_POINTS = 0.6, 0.7, 0.7, 0.30, 6


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, ties: list[str], at: dict[str, float]) -> DataFrame:
    """For each group the smallest value at which the running weight reaches each share of the total. Weights of 0 or less don't count.

    Rows of equal value reach a share together, so weights are added by value before anything is ordered: a task orders a group's different values, without the columns that tell rows apart. ties: those columns; no result depends on them.
    """
    by_value = rows.filter(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_weight"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    # one window gives the running sum; the total is its last value, so no second pass over the group
    run = by_value.withColumn("_run", F.sum("_weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("_run").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    run = run.withColumn("_total", total)
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_run") >= F.lit(q) * F.col("_total"), F.col(value))).alias(name) for name, q in at.items()])


def trend(year: Column, price: Column) -> Column:
    """Aggregate: yearly growth by a log-linear fit, from -0.30 to 0.30; null with fewer than six points or a single year."""
    able = year.isNotNull() & (price > 0)
    slope = F.regr_slope(F.when(able, F.ln(price)), F.when(able, year.cast("double")))
    spread = F.max(F.when(able, year)) > F.min(F.when(able, year))
    return F.when((F.count_if(able) >= FEWEST_POINTS) & spread, F.greatest(F.lit(-MOST_TREND), F.least(F.lit(MOST_TREND), F.exp(slope) - 1)))


def size_weight(subject: Column, comp: Column) -> Column:
    r = F.ln(comp / subject)
    return F.when((subject > 0) & (comp > 0), F.exp(-(r * r) / (2 * SIZE_SIGMA * SIZE_SIGMA))).otherwise(MISSING_SIZE)


def year_weight(subject: Column, comp: Column) -> Column:
    d = (comp - subject).cast("double")
    return F.when((subject > 0) & (comp > 0), F.exp(-(d * d) / (2 * YEAR_SIGMA * YEAR_SIGMA))).otherwise(MISSING_YEAR)


def recency_weight(sale_year: Column, now_year: int) -> Column:
    return F.when(sale_year > 0, F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_year) - sale_year).cast("double") / HALF_LIFE)).otherwise(MISSING_SALE)


def series_match(tokens: Column, title: Column) -> Column:
    return F.coalesce(F.exists(tokens, lambda t: (t != "") & F.lower(title).contains(F.lower(t))), F.lit(False))


def weighted_comps(subjects: DataFrame, comps: DataFrame, now_year: int, named: bool = True) -> DataFrame:
    """A row for each subject, stratum (all, big3, mid) and comparable of its artist and medium, with sold, growth, adjusted price and weight; without comp_id if not named.

    subjects: subject_id, artist_key, medium_category, area_sqin, work_year, series_tokens. comps: comp_id, artist_key, medium_category, title, area_sqin, work_year, price_usd, outcome, sale_year, venue.
    """
    keys = ["artist_key", "medium_category"]
    sold = F.coalesce(F.col("outcome").isin("sold", "final_bid") & (F.col("price_usd") > 0), F.lit(False))
    ids = ["comp_id"] if named else []
    own = comps.select(*ids, *keys, "title", "area_sqin", "work_year", "sale_year", "price_usd", sold.alias("sold"), "venue")
    # the comparables are most often a join of many tables, and are needed for growth and for prices: kept once
    own = checkpointed(own.join(subjects.select(*keys).distinct(), keys, "left_semi")).withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("venue")))).drop("venue")
    # growth is that of the artist and medium, whatever work is valued, so it is found before subjects multiply the rows
    growth = own.filter("sold").groupBy(*keys, "stratum").agg(trend(F.col("sale_year"), F.col("price_usd")).alias("growth"))
    factor = F.pow(F.lit(1.0) + F.coalesce("growth", F.lit(0.0)), (F.lit(now_year) - F.col("sale_year")).cast("double"))
    priced = own.join(growth, [*keys, "stratum"], "left").withColumn("price", F.round(F.col("price_usd") * F.coalesce(factor, F.lit(1.0)), 6))
    pairs = priced.alias("c").join(subjects.alias("s"), (F.col("c.artist_key") == F.col("s.artist_key")) & (F.col("c.medium_category") == F.col("s.medium_category")))
    weight = size_weight(F.col("s.area_sqin"), F.col("c.area_sqin")) * year_weight(F.col("s.work_year"), F.col("c.work_year")) * recency_weight(F.col("c.sale_year"), now_year)
    weight = weight * F.when(series_match(F.col("s.series_tokens"), F.col("c.title")), SERIES_BOOST).otherwise(1.0)
    return pairs.select("s.subject_id", "s.medium_category", *[f"c.{c}" for c in ids], "c.title", "c.sale_year", "c.price_usd", "c.sold", F.round(weight, 12).alias("weight"), "c.stratum", "c.growth", "c.price")


def comp_estimates(subjects: DataFrame, comps: DataFrame, now_year: int) -> DataFrame:
    """A row for each subject and stratum that has a sold comparable: low, mid, high, n, unsold, n_effective, confidence, growth."""
    rows = weighted_comps(subjects, comps, now_year, named=False)
    keys = ["subject_id", "stratum"]
    sold = rows.filter("sold and weight > 0")
    quantiles = weighted_quantiles(sold, keys, "price", "weight", [], {"low": 0.25, "mid": 0.5, "high": 0.75})
    stats = rows.groupBy(*keys).agg(F.count_if(F.col("sold") & (F.col("weight") > 0)).alias("n"), F.count_if(~F.col("sold")).alias("unsold"), F.sum(F.when(F.col("sold"), F.col("weight").cast("decimal(18,12)"))).cast("double").alias("n_effective"), F.max("growth").alias("growth"))
    out = stats.join(quantiles, keys)
    spread = (F.col("high") - F.col("low")) / F.col("mid")
    confidence = F.when((F.col("n_effective") >= 4) & (F.col("n") >= 5) & (spread <= 1.2), "high").when((F.col("n_effective") >= 1.5) & (F.col("n") >= 2), "medium").otherwise("low")
    return out.select(*keys, *[F.bround(c, 0).alias(c) for c in ("low", "mid", "high")], "n", "unsold", F.bround("n_effective", 2).alias("n_effective"), confidence.alias("confidence"), F.round("growth", 6).alias("growth"))


def comp_estimate(subjects: DataFrame, comps: DataFrame, now_year: int) -> DataFrame:
    """A row for each subject: the estimate over all comparables, and those of the big three and of all others where any big-three sale exists. Without sold comparables: n 0, confidence none."""
    by = checkpointed(comp_estimates(subjects, comps, now_year))  # a row or two a subject, read for both strata
    overall = by.filter("stratum = 'all'").drop("stratum")
    split = by.filter("stratum <> 'all'").groupBy("subject_id").agg(
        *[F.max(F.when(F.col("stratum") == s, F.col(c))).alias(f"{s}_{c}") for s in ("big3", "mid") for c in ("low", "mid", "high", "n", "confidence")]
    )
    seen = comps.groupBy("artist_key").agg(F.count_if(F.col("venue") == "big3").alias("big3_count"))
    out = subjects.select("subject_id", "artist_key", "medium_category").join(overall, "subject_id", "left").join(seen, "artist_key", "left").join(split, "subject_id", "left")
    shown = F.coalesce(F.col("big3_count") > 0, F.lit(False)) & F.col("n").isNotNull()
    return out.select(
        "subject_id", "artist_key", "medium_category", "low", "mid", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("unsold", F.lit(0)).alias("unsold"),
        F.coalesce("n_effective", F.lit(0.0)).alias("n_effective"), F.coalesce("confidence", F.lit("none")).alias("confidence"), "growth",
        F.when(F.col("n").isNotNull(), F.col("big3_count")).alias("big3_count"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("big3_low", "big3_mid", "big3_high", "mid_low", "mid_mid", "mid_high")],
    )


def top_comps(subjects: DataFrame, comps: DataFrame, now_year: int, k: int = 6) -> DataFrame:
    """The k heaviest sold comparables of each subject, ranked; a top-k report."""
    rows = weighted_comps(subjects, comps, now_year).filter("stratum = 'all' and sold and weight > 0")
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("weight"), "price", "comp_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("subject_id", "rank", "comp_id", "title", F.bround("price", 0).alias("price"), F.round("weight", 3).alias("weight"), "sale_year")


def artist_summary(prices: DataFrame, firewall: bool = False) -> DataFrame:
    """Each artist's sold and unsold counts, medians, high, latest sale and suspect count; suspect rows count nowhere else. With firewall only tier A."""
    rows = prices.filter("tier = 'A'") if firewall else prices
    clean = ~F.col("suspect")
    sold = clean & F.col("outcome").isin("sold", "final_bid") & (F.col("price_usd") > 0)
    return rows.groupBy("artist_key").agg(
        F.count("*").alias("records"), F.count_if(sold).alias("sold_n"), F.median(F.when(sold, F.col("price_usd"))).alias("median_usd"),
        F.median(F.when(sold & (F.col("work_class") == "unique"), F.col("price_usd"))).alias("median_unique_usd"), F.max(F.when(sold, F.col("price_usd"))).alias("high_usd"),
        F.count_if(clean & (F.col("outcome") == "unsold")).alias("unsold_n"), F.max(F.when(sold, F.col("sale_date"))).alias("latest"), F.count_if(F.col("suspect")).alias("suspect_n"),
    )


def market_line(prices: DataFrame) -> DataFrame:
    """Sold count and the upper middle price of each artist, which differs from the median for even counts. Prices are counted before they are ordered, so a task orders an artist's different prices only."""
    sold = prices.filter(F.col("outcome").isin("sold", "final_bid") & (F.col("price_usd") > 0))
    counts = sold.groupBy("artist_key", "price_usd").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("artist_key")
    placed = counts.withColumns({"_to": F.sum("_n").over(own.orderBy("price_usd")), "sold_n": F.sum("_n").over(own)})
    return placed.filter(F.expr("_to >= sold_n div 2 + 1")).groupBy("artist_key").agg(F.max("sold_n").alias("sold_n"), F.min("price_usd").alias("middle_usd"))


def market_detail(prices: DataFrame) -> DataFrame:
    """The vetted high where there is one, else the unvetted, with its source."""
    sold = F.col("outcome").isin("sold", "final_bid")
    best = prices.groupBy("artist_key").agg(F.max(F.when(sold & (F.col("tier") == "A"), F.col("price_usd"))).alias("a"), F.max(F.when(sold & (F.col("tier") != "A"), F.col("price_usd"))).alias("b"), F.count_if(sold).alias("n"))
    return best.select("artist_key", F.coalesce("a", "b", F.lit(0.0)).alias("high_usd"), F.when(F.col("a").isNotNull(), "vetted").when(F.col("b").isNotNull(), "unvetted").otherwise("").alias("source"), "n")


def house_report(prices: DataFrame, least: int) -> DataFrame:
    """Houses by their number of suspect records, `least` at least."""
    return prices.groupBy("house").agg(F.sum(F.col("suspect").cast("int")).alias("suspects"), F.count("*").alias("records")).filter(F.col("suspects") >= least)
