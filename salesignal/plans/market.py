"""Queries on prices and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.operators import market as m
from salesignal.plans.registry import query
from salesignal.plans.views import NOW_YEAR, PRICES, SUBJECTS, prices, read, subjects

_WEIGHTED = f"""
pairs AS (
  SELECT s.subject_id, s.medium_category, c.comp_id, c.title, c.sale_year, c.price_usd, c.venue, c.outcome IN ('sold', 'final_bid') AND c.price_usd > 0 AS sold,
    round(CASE WHEN s.area_sqin > 0 AND c.area_sqin > 0 THEN exp(-(ln(c.area_sqin / s.area_sqin) * ln(c.area_sqin / s.area_sqin)) / (2 * 0.55::DOUBLE * 0.55::DOUBLE)) ELSE 0.6 END
      * exp(-((c.work_year - s.work_year) * (c.work_year - s.work_year))::DOUBLE / (2 * 9.0::DOUBLE * 9.0::DOUBLE))
      * pow(0.5::DOUBLE, greatest(0, {NOW_YEAR} - c.sale_year)::DOUBLE / 6.0::DOUBLE)
      * CASE WHEN contains(lower(c.title), lower(s.token)) THEN 1.7::DOUBLE ELSE 1.0::DOUBLE END, 12) AS weight
  FROM prices c JOIN subjects s ON c.artist_key = s.artist_key AND c.medium_category = s.medium_category
), strata AS (
  SELECT *, 'all' AS stratum FROM pairs UNION ALL SELECT *, venue AS stratum FROM pairs
), growth AS (
  SELECT subject_id, stratum, CASE WHEN count(*) >= 6 THEN greatest(-0.30, least(0.30, exp(regr_slope(ln(price_usd), sale_year)) - 1)) END AS growth FROM strata WHERE sold GROUP BY ALL
), priced AS (
  SELECT t.*, g.growth, round(price_usd * coalesce(pow(1.0::DOUBLE + coalesce(g.growth, 0.0), ({NOW_YEAR} - sale_year)::DOUBLE), 1.0), 6) AS price FROM strata t LEFT JOIN growth g USING (subject_id, stratum)
), running AS (
  SELECT *, sum(weight) OVER (PARTITION BY subject_id, stratum ORDER BY price, weight, comp_id ROWS UNBOUNDED PRECEDING) AS run FROM priced WHERE sold AND weight > 0
), totals AS (SELECT *, max(run) OVER (PARTITION BY subject_id, stratum) AS total FROM running),
quantiles AS (
  SELECT subject_id, stratum, min(price) FILTER (run >= 0.25 * total) AS low, min(price) FILTER (run >= 0.5 * total) AS mid, min(price) FILTER (run >= 0.75 * total) AS high FROM totals GROUP BY ALL
), stats AS (
  SELECT subject_id, stratum, count(*) FILTER (sold AND weight > 0) AS n, count(*) FILTER (NOT sold) AS unsold,
    CAST(sum(CASE WHEN sold THEN CAST(weight AS DECIMAL(18,12)) END) AS DOUBLE) AS n_effective, max(growth) AS growth FROM priced GROUP BY ALL
), estimates AS (
  SELECT subject_id, stratum, round_even(low, 0) AS low, round_even(mid, 0) AS mid, round_even(high, 0) AS high, n, unsold, round_even(n_effective, 2) AS n_effective,
    CASE WHEN n_effective >= 4 AND n >= 5 AND (high - low) / mid <= 1.2 THEN 'high' WHEN n_effective >= 1.5 AND n >= 2 THEN 'medium' ELSE 'low' END AS confidence, round(growth, 6) AS growth
  FROM stats JOIN quantiles USING (subject_id, stratum)
)"""
_HEAD = f"WITH {PRICES}, {SUBJECTS}, {_WEIGHTED}"


@query(
    f"""{_HEAD}, seen AS (SELECT artist_key, count(*) FILTER (venue = 'big3') AS big3_count FROM prices GROUP BY 1)
SELECT s.subject_id, s.artist_key, s.medium_category, e.low, e.mid, e.high, coalesce(e.n, 0) AS n, coalesce(e.unsold, 0) AS unsold, coalesce(e.n_effective, 0) AS n_effective,
  coalesce(e.confidence, 'none') AS confidence, e.growth, CASE WHEN e.n IS NOT NULL THEN seen.big3_count END AS big3_count,
  CASE WHEN big3_count > 0 THEN b.low END AS big3_low, CASE WHEN big3_count > 0 THEN b.mid END AS big3_mid, CASE WHEN big3_count > 0 THEN b.high END AS big3_high,
  CASE WHEN big3_count > 0 THEN m.low END AS mid_low, CASE WHEN big3_count > 0 THEN m.mid END AS mid_mid, CASE WHEN big3_count > 0 THEN m.high END AS mid_high
FROM subjects s LEFT JOIN estimates e ON e.subject_id = s.subject_id AND e.stratum = 'all' LEFT JOIN seen ON seen.artist_key = s.artist_key
LEFT JOIN estimates b ON b.subject_id = s.subject_id AND b.stratum = 'big3' AND e.n IS NOT NULL LEFT JOIN estimates m ON m.subject_id = s.subject_id AND m.stratum = 'mid' AND e.n IS NOT NULL"""
)
def comp_estimate(spark, d):
    return m.comp_estimate(subjects(spark, d), prices(spark, d), NOW_YEAR)


@query(f"{_HEAD} SELECT subject_id, stratum, low, mid, high, n, unsold, n_effective, confidence, growth FROM estimates")
def venue_split(spark, d):
    return m.comp_estimates(subjects(spark, d), prices(spark, d), NOW_YEAR)


@query(
    f"""{_HEAD} SELECT subject_id, rank, comp_id, title, round_even(price, 0) AS price, round(weight, 3) AS weight, sale_year FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY weight DESC, price, comp_id) AS INTEGER) AS rank FROM totals WHERE stratum = 'all') WHERE rank <= 6"""
)
def top_comps(spark, d):
    return m.top_comps(subjects(spark, d), prices(spark, d), NOW_YEAR)


@query(
    """WITH r AS (SELECT p_type, l_extendedprice AS v, l_quantity AS w, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT *, sum(w) OVER (PARTITION BY p_type ORDER BY v, w, l_orderkey, l_linenumber, l_suppkey, l_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY p_type) AS total FROM r)
SELECT p_type, min(v) FILTER (run >= 0.1 * total) AS q10, min(v) FILTER (run >= 0.5 * total) AS q50, min(v) FILTER (run >= 0.9 * total) AS q90 FROM a GROUP BY 1"""
)
def weighted_quantiles(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return m.weighted_quantiles(rows, ["p_type"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query(f"WITH {PRICES} SELECT artist_key, CASE WHEN count(*) >= 6 THEN round(greatest(-0.30, least(0.30, exp(regr_slope(ln(price_usd), sale_year)) - 1)), 6) END AS growth, count(*) AS points FROM prices WHERE outcome <> 'unsold' GROUP BY 1")
def price_trend(spark, d):
    sold = prices(spark, d).filter("outcome <> 'unsold'")
    return sold.groupBy("artist_key").agg(F.round(m.trend(F.col("sale_year"), F.col("price_usd")), 6).alias("growth"), F.count("*").alias("points"))


def _summary(where: str) -> str:
    sold = "NOT suspect AND outcome IN ('sold', 'final_bid') AND price_usd > 0"
    return f"""WITH {PRICES} SELECT artist_key, count(*) AS records, count(*) FILTER ({sold}) AS sold_n, median(price_usd) FILTER ({sold}) AS median_usd,
median(price_usd) FILTER ({sold} AND work_class = 'unique') AS median_unique_usd, max(price_usd) FILTER ({sold}) AS high_usd, count(*) FILTER (NOT suspect AND outcome = 'unsold') AS unsold_n,
max(sale_date) FILTER ({sold}) AS latest, count(*) FILTER (suspect) AS suspect_n FROM prices {where} GROUP BY 1"""


@query(_summary(""))
def artist_summary(spark, d):
    return m.artist_summary(prices(spark, d))


@query(_summary("WHERE tier = 'A'"))
def artist_summary_firewall(spark, d):
    return m.artist_summary(prices(spark, d), firewall=True)


@query(f"WITH {PRICES} SELECT artist_key, count(*) AS sold_n, list_sort(list(price_usd))[count(*) // 2 + 1] AS middle_usd FROM prices WHERE outcome <> 'unsold' AND price_usd > 0 GROUP BY 1")
def market_line(spark, d):
    return m.market_line(prices(spark, d))


@query(
    f"""WITH {PRICES}, b AS (SELECT artist_key, max(price_usd) FILTER (tier = 'A' AND outcome <> 'unsold') AS a, max(price_usd) FILTER (tier <> 'A' AND outcome <> 'unsold') AS b, count(*) FILTER (outcome <> 'unsold') AS n FROM prices GROUP BY 1)
SELECT artist_key, coalesce(a, b, 0) AS high_usd, CASE WHEN a IS NOT NULL THEN 'vetted' WHEN b IS NOT NULL THEN 'unvetted' ELSE '' END AS source, n FROM b"""
)
def market_detail(spark, d):
    return m.market_detail(prices(spark, d))


@query(f"WITH {PRICES} SELECT house, CAST(sum(suspect::INTEGER) AS BIGINT) AS suspects, count(*) AS records FROM prices GROUP BY 1 HAVING sum(suspect::INTEGER) >= 2")
def house_report(spark, d):
    return m.house_report(prices(spark, d), 2)


@query(f"WITH {PRICES} SELECT comp_id, artist_key, house, price_usd FROM prices WHERE suspect")
def suspect_prices(spark, d):
    return prices(spark, d).filter("suspect").select("comp_id", "artist_key", "house", "price_usd")


@query(f"WITH {PRICES} SELECT tier, outcome, count(*) AS n FROM prices GROUP BY ALL")
def tier_counts(spark, d):
    return prices(spark, d).groupBy("tier", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {PRICES} SELECT artist_key, max(price_usd) AS high_price, max(area_sqin) AS high_area FROM prices GROUP BY 1")
def max_per_key_two(spark, d):
    return prices(spark, d).groupBy("artist_key").agg(F.max("price_usd").alias("high_price"), F.max("area_sqin").alias("high_area"))


@query("SELECT l_suppkey, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS cost FROM lineitem GROUP BY 1")
def cost_totals(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.coalesce(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("cost"))


@query(f"WITH {PRICES} SELECT house, tier, count(*) AS n, CAST(sum(CAST(price_usd AS DECIMAL(18,2))) AS DOUBLE) AS total FROM prices GROUP BY ROLLUP (house, tier)")
def rollup_house_tier(spark, d):
    return prices(spark, d).rollup("house", "tier").agg(F.count("*").alias("n"), F.sum(F.col("price_usd").cast("decimal(18,2)")).cast("double").alias("total"))
