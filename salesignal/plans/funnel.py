"""The whole funnel over stand-ins: parts are lots, brands their sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions import names as n
from salesignal.operators import funnel as fu
from salesignal.plans.feeds import LOTS, _like, _quoted, _SKIP, _STRONG, lots
from salesignal.plans.registry import query

_SIGNATURES = ("Signed lower right: Jo {f} '84", "illegible", "Ann {f} verso", "B. B.")
_BUDGET = 30


def parts(spark, d):
    """Lots with what the models would say of them, all made from the lot's number and texts."""
    rows = lots(spark, d)
    key, size = F.col("lot"), F.col("p_size")
    name = F.concat_ws(" ", F.split("artist", " ")[0], F.char(65 + size % 5), F.split("artist", " ")[1])
    rows = rows.withColumns(
        {
            "title": F.when(size % 13 == 0, F.concat(F.col("title"), F.lit(" 11380/22900"))).when(size % 17 == 0, F.concat(F.col("title"), F.lit(" poster"))).otherwise(F.col("title")),
            "img": F.when(key % 5 != 0, F.concat(F.lit("img"), key.cast("string"))), "said": F.when(key % 4 == 0, F.split("artist", " ")[0]).when(key % 9 == 0, F.lit(None).cast("string")).otherwise(name), "promise": (key % 11).cast("double"),
        }
    )
    return rows.drop("artist")


_NAME = "split_part(artist, ' ', 1) || ' ' || chr(65 + p_size % 5) || ' ' || split_part(artist, ' ', 2)"
_CLEAN = f"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(signature, {_quoted(n.SIGNATURE_NOISE)}, ' ', 'g'), '["“”''`]', ' ', 'g'), '\\(.*?\\)', ' ', 'g'), '[0-9]', ' ', 'g'), '[^A-Za-z.\\-'' ]', ' ', 'g'), '\\s+', ' ', 'g')), '^[ .\\-'']+|[ .\\-'']+$', '', 'g')"""


@query(
    f"""WITH {LOTS}, parts AS (
  SELECT lot, auction, title || CASE WHEN p_size % 13 = 0 THEN ' 11380/22900' WHEN p_size % 17 = 0 THEN ' poster' ELSE '' END AS title, detail, auction_title, auction_house, p_size, CASE WHEN lot % 5 <> 0 THEN 'img' || lot END AS img,
    coalesce(CASE WHEN lot % 4 = 0 THEN split_part(artist, ' ', 1) WHEN lot % 9 = 0 THEN '' ELSE {_NAME} END, '') AS said, (lot % 11)::DOUBLE AS promise FROM lots
), marks AS (SELECT *, {_STRONG} AS strong, {_SKIP} AS skip, lower(regexp_extract(title, {_quoted(c.BLUE_CHIP)}, 1)) AS master FROM parts),
sales AS (SELECT auction, avg(strong::INTEGER::DOUBLE) AS density, count(DISTINCT master) FILTER (master <> '' AND NOT skip) >= 3 OR count(*) FILTER (master <> '' AND NOT skip) >= 8 AS mill FROM marks GROUP BY 1),
first AS (
  SELECT m.*, CASE WHEN mill THEN 'blocked' WHEN trim(title) = '' THEN 'junk' WHEN {_like('lower(title)', c.HARD_NEGATIVE)} THEN 'junk' WHEN strong THEN 's1' WHEN {_like("lower(auction_title || ' ' || auction_house)", c.LIQUIDATION)} THEN 'junk' WHEN density >= 0.02 THEN 's1' ELSE 'junk' END AS s0 FROM marks m JOIN sales USING (auction)
), known AS (SELECT DISTINCT said AS artist FROM parts WHERE p_size % 7 = 0 AND said <> ''),
told AS (SELECT f.*, lot % 19 <> 0 AS replied, said IN (SELECT artist FROM known) AS is_known, contains(said, ' ') AS named, p_size % 8 <> 0 AS is_art FROM first f),
second AS (
  SELECT *, CASE WHEN s0 = 's1' AND replied THEN CASE WHEN is_art AND (promise >= {fu.PROMISE} OR is_known OR named AND promise >= {fu.NAMED_PROMISE}) THEN 's3' ELSE 'done' END ELSE s0 END AS s1, CASE WHEN replied THEN said END AS a1, CASE WHEN replied THEN promise END AS p1 FROM told
), looked AS (SELECT lot FROM second WHERE s1 = 's3' AND NOT contains(coalesce(a1, ''), ' ') AND img IS NOT NULL AND strong ORDER BY p1 DESC, lot LIMIT {_BUDGET}),
signed AS (
  SELECT lot, {_CLEAN} AS cleaned FROM (SELECT lot, replace((['Signed lower right: Jo {{f}} ''84', 'illegible', 'Ann {{f}} verso', 'B. B.'])[lot % 4 + 1], '{{f}}', upper(split_part(title, ' ', 1))) AS signature FROM parts WHERE lot % 6 <> 0) JOIN looked USING (lot)
), words AS (SELECT lot, list_filter(string_split(cleaned, ' '), lambda x: length(x) > 1 OR suffix(x, '.')) AS ws FROM signed),
read AS (SELECT lot, array_to_string(list_transform(ws, lambda x: CASE WHEN length(x) > 2 THEN upper(x[1]) || lower(x[2:]) ELSE upper(x) END), ' ') AS name FROM words WHERE len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda x: length(trim(x, '.')) >= 3)) > 0),
third AS (SELECT s.* EXCLUDE (a1), coalesce(name, a1) AS artist FROM second s LEFT JOIN read USING (lot)),
prof AS (SELECT said AS artist, max(p_size) % 3 <> 0 AS significant, max(p_size) % 10 = 1 AS deferred, CASE WHEN max(p_size) % 2 = 0 THEN 'only ads' ELSE '' END AS pwhy, CASE WHEN max(p_size) % 4 = 0 THEN 'met' ELSE '' END AS museums, CAST(min(p_size) % 6 AS INTEGER) AS tier FROM parts WHERE contains(said, ' ') GROUP BY 1),
gate AS (
  SELECT t.*, p.artist IS NOT NULL AS has, significant, museums, tier, CASE WHEN s1 <> 's3' THEN NULL WHEN NOT contains(coalesce(t.artist, ''), ' ') THEN 'no identifiable artist name' WHEN coalesce(deferred, false) THEN 'deferred' WHEN p.artist IS NOT NULL AND NOT significant THEN 'artist not significant: ' || coalesce(nullif(pwhy, ''), 'no museum, gallery or auction record') END AS g
  FROM third t LEFT JOIN prof p ON p.artist = t.artist
), final AS (
  SELECT *, s1 = 's3' AND (g IS NULL) AND lot % 23 <> 0 AS mine, lot % 3 <> 0 AS yes, CASE WHEN NOT coalesce(significant, true) THEN 'artist not significant' WHEN regexp_matches(title, {_quoted(fu.POSTER)}) AND NOT (coalesce(museums <> '', false) OR coalesce(tier BETWEEN 1 AND 3, false)) THEN 'reproduction'
    WHEN coalesce(TRY_CAST(regexp_extract(title, {_quoted(fu.EDITION)}, 1) AS INTEGER) >= 500, false) THEN 'mass edition' WHEN lot % 7 = 0 THEN 'picture does not match' END AS taken FROM gate
)
SELECT lot, auction, CASE WHEN mine OR g IS NOT NULL AND g <> 'deferred' THEN 'done' ELSE s1 END AS stage, strong::INTEGER AS s1_priority, artist, p1 AS promise, mine AND yes AND taken IS NULL AS flagged,
  CASE WHEN mine AND NOT yes THEN 'judged no' WHEN mine THEN coalesce(taken, 'flagged') WHEN g IS NOT NULL THEN g WHEN s0 = 's1' AND replied AND s1 = 'done' THEN 'screened out' END AS why FROM final"""
)
def every_lot_funnel(spark, d):
    own = parts(spark, d)
    key, size = F.col("lot"), F.col("p_size")
    replies = own.filter(key % 19 != 0).select("lot", (size % 8 != 0).alias("is_art"), F.col("said").alias("artist"), "promise")
    known = own.filter((size % 7 == 0) & (F.col("said") != "")).select(F.col("said").alias("artist"))
    template = F.element_at(F.array(*[F.lit(s) for s in _SIGNATURES]), (key % 4 + 1).cast("int"))
    signatures = own.select("lot", F.replace(template, F.lit("{f}"), F.upper(F.split("title", " ")[0])).alias("signature"), (key % 6 != 0).alias("legible"))
    most = F.max(size)
    profiles = own.filter(F.col("said").contains(" ")).groupBy(F.col("said").alias("artist")).agg((most % 3 != 0).alias("significant"), (most % 10 == 1).alias("deferred"), F.when(most % 2 == 0, "only ads").otherwise("").alias("why"), F.when(most % 4 == 0, "met").otherwise("").alias("museums"), (F.min(size) % 6).alias("gallery_tier"))
    judgements = own.filter(key % 23 != 0).select("lot", F.when(key % 3 != 0, "Yes").otherwise("NO").alias("flag"))
    views = own.filter(key % 2 == 1).select("lot", (key % 7 != 0).alias("matches")).unionByName(own.filter((key % 2 == 0) & (key % 7 == 0)).select("lot", F.lit(False).alias("matches")))
    return fu.funnel(own.drop("said", "promise"), replies, known, signatures, profiles, judgements, views, _BUDGET)
