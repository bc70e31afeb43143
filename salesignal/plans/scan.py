"""Deep scan and harvest over stand-ins: line items are lots with raw titles; the SQL reads the titles itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions import names as n
from salesignal.operators import scan as s
from salesignal.plans.authority import PROFILES, build, profiles
from salesignal.plans.registry import query
from salesignal.plans.views import read
from salesignal.session import checkpointed

SALES = 700
FAVOURITES, BLOCKED = ("house 12",), ("house 31",)
#: Titles of lots; {f} and {l} stand for a first and a last name.
TITLES = (
    "Framed {f} {l} Oil Painting", "pallet of tools", "{l}, {f} watercolor on paper", "{f} {l} giclee", "Lot of Large Antique Vase", '{f} {l} - "Evening" Landscape', "after Monet", "Small Estate Collection Box", '"Still Life" by {f} {l}',
    "Original {f} {l} Nude Photograph", "Unidentified Artist Portrait", "American School Landscape Oil",
)
FAMOUS = ("Pablo Picasso original signed drawing", "Original Salvador Dali Gouache")


def lots(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mixed = F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    first = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(" "), F.char(65 + F.col("p_size") % 6), F.lit("."))
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (mixed % len(TITLES) + 1).cast("int"))
    title = F.when(mixed % 40 == 1, FAMOUS[0]).when(mixed % 40 == 8, FAMOUS[1]).otherwise(F.replace(F.replace(title, F.lit("{f}"), first), F.lit("{l}"), F.initcap(F.split("p_name", " ")[1])))
    lot = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    price = F.col("l_extendedprice")
    return rows.select(
        lot.alias("lot"), (F.col("l_orderkey") % SALES).alias("sale"), title.alias("title"), F.when(F.col("l_quantity") > 10, F.floor(price / 100)).alias("bid"), F.when(F.col("l_returnflag") == "A", F.floor(price / 50)).alias("realized"),
        (F.col("l_quantity") - 20).cast("int").alias("bids"), F.col("l_tax").alias("tax"),
    ).distinct()


def auctions(spark, d):
    sale = F.col("o_orderkey") % SALES
    return read(spark, d, "orders").select(sale.alias("sale")).distinct().select("sale", F.concat(F.lit("House "), (F.col("sale") % 60).cast("string")).alias("house"), F.col("sale").alias("pos"), (F.col("sale") % 19 == 0).alias("failed"))


def market(spark, d):
    """The market store: some people under the names that catalogues have for them, and forms found to be no names."""
    part = read(spark, d, "part")
    first = F.concat(F.split("p_name", " ")[0], F.lit(" "), F.char(65 + F.col("p_size") % 6))
    name = F.concat_ws(" ", first, F.split("p_name", " ")[1])
    rows = part.filter("p_partkey % 3 = 0").groupBy(F.lower(name).alias("artist_key")).agg(F.min(name).alias("artist"), F.max("p_size").alias("size"))
    rows = rows.select("artist_key", "artist", F.when(F.col("size") % 3 == 0, "strong").when(F.col("size") % 3 == 1, "listed").otherwise("none").alias("tier"), F.when(F.col("size") % 4 == 2, s.NO_NAME_SOURCE).otherwise("research").alias("source"), (F.col("size") * 400.0).alias("high"))
    return rows.unionByName(rows.sparkSession.createDataFrame([("pablo picasso", "Pablo Picasso", "strong", "research", 90000.0)], rows.schema))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ",".join(_quoted(x) for x in items) + "]"


_SKIP = f"(regexp_matches(title, {_quoted(c.skip_pattern())}) OR regexp_matches(title, '(^|[^A-Za-z])(LE|L[.]E[.]?)($|[^A-Za-z])'))"
_TRIMMED = f"""list_transform(list_transform(regexp_extract_all(title, {_quoted(n.CAPITALISED)}, 1), lambda p: list_filter(regexp_split_to_array(p, '[\\s,-]+'), lambda w: w <> '')),
    lambda ws: list_transform([list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains({_list(n.GENRE_WORDS)}, lower(ws[i])))], lambda g: CASE WHEN len(g) > 0 THEN ws[list_min(g):list_max(g)] ELSE [] END)[1])"""
LOTS = f"""
m AS (SELECT *, l_partkey * 7 + l_suppkey * 3 + l_linenumber AS mixed, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || chr(65 + p_size % 6) || '.' AS first, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS last FROM lineitem JOIN part ON l_partkey = p_partkey),
lots AS (
  SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS lot, l_orderkey % {SALES} AS sale,
    CASE WHEN mixed % 40 = 1 THEN {_quoted(FAMOUS[0])} WHEN mixed % 40 = 8 THEN {_quoted(FAMOUS[1])} ELSE replace(replace(({_list(TITLES)})[mixed % {len(TITLES)} + 1], '{{f}}', first), '{{l}}', last) END AS title,
    CASE WHEN l_quantity > 10 THEN CAST(floor(l_extendedprice / 100) AS BIGINT) END AS bid, CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice / 50) AS BIGINT) END AS realized, CAST(l_quantity - 20 AS INTEGER) AS bids, l_tax AS tax FROM m
), auctions AS (SELECT DISTINCT o_orderkey % {SALES} AS sale, 'House ' || (o_orderkey % {SALES} % 60) AS house, o_orderkey % {SALES} AS pos, o_orderkey % {SALES} % 19 = 0 AS failed FROM orders),
sized AS (SELECT lower(split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6) || ' ' || split_part(p_name, ' ', 2)) AS artist_key, min(split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6) || ' ' || split_part(p_name, ' ', 2)) AS artist, max(p_size) AS size FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
market AS (
  SELECT artist_key, artist, (['strong', 'listed', 'none'])[size % 3 + 1] AS tier, CASE WHEN size % 4 = 2 THEN {_quoted(s.NO_NAME_SOURCE)} ELSE 'research' END AS source, size * 400.0::DOUBLE AS high FROM sized UNION ALL SELECT 'pablo picasso', 'Pablo Picasso', 'strong', 'research', 90000.0
)"""
_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
#: What the authority says of the names in a table `asked` (name, key).
KNOWN = """
forms AS (SELECT name, 0 AS pos, key AS variant_key FROM asked WHERE contains(key, ' ') UNION SELECT name, 2, array_to_string(list_sort(string_split(key, ' ')), ' ') FROM asked WHERE contains(key, ' ')),
hits AS (SELECT name, artist_id, min(pos) AS pos FROM forms JOIN (SELECT DISTINCT variant_key, artist_id FROM variants) USING (variant_key) GROUP BY ALL),
best AS (SELECT * FROM hits QUALIFY pos = min(pos) OVER (PARTITION BY name)),
known AS (
  SELECT name, canonical, standing, CASE WHEN trim(said) = '' THEN 'documented artist' ELSE trim(said) END AS description FROM best b JOIN profiles p USING (artist_id) QUALIFY row_number() OVER (PARTITION BY name ORDER BY len(museums) DESC, birth_year IS NULL, b.artist_id) = 1
)"""
SCAN = f"""{PROFILES}, {LOTS},
todo AS (SELECT * FROM auctions WHERE sale % 4 <> 0 AND house <> 'House 7' AND NOT failed),
claimed AS (SELECT sale, CASE WHEN NOT {_SKIP} THEN nullif(lower(regexp_extract(title, {_quoted(c.BLUE_CHIP)}, 1)), '') END AS master FROM lots JOIN todo USING (sale)),
mills AS (SELECT sale, list_sort(list(DISTINCT master) FILTER (master IS NOT NULL)) AS masters, count(master) AS claims FROM claimed GROUP BY 1 HAVING count(DISTINCT master) >= 3 OR count(master) >= 8),
found AS (SELECT t.*, masters, claims FROM mills JOIN todo t USING (sale) WHERE NOT contains(lower(house), 'house 12')),
stops AS (SELECT house, min(pos) AS blocked_at FROM found GROUP BY 1),
taken AS (SELECT t.*, blocked_at FROM todo t LEFT JOIN stops USING (house) WHERE blocked_at IS NULL OR pos <= blocked_at),
fresh AS (SELECT l.*, {_TRIMMED} AS phrases FROM lots l JOIN taken t USING (sale) WHERE (blocked_at IS NULL OR pos <> blocked_at) AND NOT {_SKIP} AND tax < 0.08),
new AS (SELECT *, array_to_string(list_filter(phrases, lambda ws: len(ws) >= 2)[1][1:4], ' ') AS name FROM fresh WHERE len(list_filter(phrases, lambda ws: len(ws) >= 2)) > 0),
asked AS (SELECT DISTINCT name, {_KEY.format("name")} AS key FROM new), {KNOWN},
bridged AS (SELECT key, max({_KEY.format("canonical")}) AS canonical_key FROM asked LEFT JOIN known USING (name) GROUP BY 1),
told AS (
  SELECT a.name, k.canonical, {_KEY.format("k.canonical")} AS canonical_key, standing, description, coalesce(x.artist_key, y.artist_key) AS artist_key, coalesce(x.tier, y.tier) AS tier, coalesce(x.high, y.high) AS high
  FROM asked a LEFT JOIN known k USING (name) JOIN bridged b ON b.key = a.key LEFT JOIN market x ON x.artist_key = a.key LEFT JOIN market y ON x.artist_key IS NULL AND y.artist_key = b.canonical_key
)"""


def scanned(spark, d):
    own, sales = checkpointed(lots(spark, d)), auctions(spark, d)  # read several times
    built = build(spark, d)
    done, blocked = sales.filter("sale % 4 = 0").select("sale"), sales.filter("house = 'House 7'").select("house")
    return s.deep_scan(sales, own, done, blocked, own.filter("tax >= 0.08").select("lot"), market(spark, d).select("artist_key", "tier", "high"), built, profiles(spark, d, built), FAVOURITES)


@query(
    f"""WITH RECURSIVE {SCAN}, reasons AS (
  SELECT lot, sale, coalesce(artist_key, canonical_key) AS artist_key, coalesce(canonical, name) AS artist, CASE WHEN coalesce(tier IN ('strong', 'listed') AND high >= 400, false) AND (bid IS NULL OR bid <= 0 OR high >= bid * 8) THEN 'market' WHEN standing = 'strong' AND (bid IS NULL OR bid <= 100) THEN 'institution' END AS reason,
    coalesce(description, '') AS evidence FROM new JOIN told USING (name))
SELECT * FROM reasons WHERE reason IS NOT NULL"""
)
def deep_scan_flags(spark, d):
    return scanned(spark, d).flags


@query(f"WITH RECURSIVE {SCAN} SELECT house, sale, masters, claims FROM found JOIN stops USING (house) WHERE pos = blocked_at")
def deep_scan_blocked(spark, d):
    return scanned(spark, d).blocked


@query(f"WITH RECURSIVE {SCAN} SELECT name, CASE WHEN canonical IS NOT NULL THEN 'research' ELSE 'classify' END AS route FROM told WHERE artist_key IS NULL")
def deep_scan_unknown(spark, d):
    return scanned(spark, d).unknown


@query(
    f"""WITH RECURSIVE {PROFILES}, {LOTS},
open_ AS (SELECT sale FROM auctions WHERE NOT failed AND NOT contains(lower(house), 'house 31') AND sale % 3 <> 0),
own AS (SELECT l.*, regexp_extract(title, {_quoted(n.BY_LINE)}, 1) AS by_line, {_TRIMMED} AS phrases FROM lots l JOIN open_ USING (sale) WHERE tax >= 0.02),
claimed AS (SELECT *, CASE WHEN by_line <> '' THEN by_line ELSE coalesce(array_to_string(list_filter(phrases, lambda ws: len(ws) >= 2)[1][1:4], ' '), '') END AS claim FROM own),
claims AS (SELECT DISTINCT claim, string_split(claim, ' ') AS w FROM claimed WHERE claim <> '' AND NOT regexp_matches(claim, {_quoted(s.GENERIC)})),
cuts AS (SELECT claim, 0 AS cut, claim AS name FROM claims UNION SELECT claim, 1, array_to_string(w[1:3], ' ') FROM claims WHERE len(w) > 3 UNION SELECT claim, 2, array_to_string(w[1:2], ' ') FROM claims WHERE len(w) > 2),
asked AS (SELECT DISTINCT name, {_KEY.format("name")} AS key FROM cuts), {KNOWN},
people AS (
  SELECT claim, arg_min(coalesce(canonical, artist), cut) AS person FROM cuts JOIN asked USING (name) LEFT JOIN known USING (name) LEFT JOIN (SELECT * FROM market WHERE NOT (tier = 'none' AND source = {_quoted(s.NO_NAME_SOURCE)})) m ON m.artist_key = key WHERE coalesce(canonical, artist) IS NOT NULL GROUP BY 1
), priced AS (
  SELECT lot, sale, person, CASE WHEN realized > 0 THEN 'sold' WHEN bid > 0 AND bids > 0 THEN 'final_bid' ELSE 'unsold' END AS outcome, CASE WHEN realized > 0 THEN realized WHEN bid > 0 AND bids > 0 THEN bid END AS price FROM claimed JOIN people USING (claim)
)
SELECT lot, sale, person AS artist, outcome, price, coalesce(outcome <> 'unsold' AND price > 0 AND high >= 10000 AND price < 500 AND price < high * 0.01, false) AS suspect
FROM priced LEFT JOIN (SELECT * FROM market WHERE tier = 'strong') m ON m.artist_key = {_KEY.format("person")}"""
)
def harvest_sales(spark, d):
    own, sales = checkpointed(lots(spark, d)), auctions(spark, d)  # read several times
    built = build(spark, d)
    return s.harvest(sales, own, sales.filter("sale % 3 = 0").select("sale"), own.filter("tax < 0.02").select("lot"), market(spark, d), built, profiles(spark, d, built), BLOCKED)
