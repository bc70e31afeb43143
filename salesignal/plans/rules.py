"""Text rules, resolution, matches, incremental rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions import keys as k
from salesignal.functions import money as mo
from salesignal.operators import incremental as i
from salesignal.operators import match as ma
from salesignal.operators import resolve as r
from salesignal.plans.registry import query
from salesignal.plans.views import HASHES, hashes, read
from salesignal.sources.readers import page_links

_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT s_suppkey, {_KEY.format('s_name')} AS key, array_to_string(list_sort(string_split({_KEY.format('p_name')}, ' ')), ' ') AS sorted, trim(regexp_replace(lower(s_name), '[^a-z ]+', '', 'g')) AS intel FROM supplier JOIN part ON s_suppkey = p_partkey")
def artist_keys(spark, d):
    rows = read(spark, d, "supplier").join(read(spark, d, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return rows.select("s_suppkey", k.artist_key(F.col("s_name")).alias("key"), k.sorted_key(k.artist_key(F.col("p_name"))).alias("sorted"), k.intel_key(F.col("s_name")).alias("intel"))


_SHOWN = ("£{:,}", "US$ {}.50", "€ {}.000,25", "HK$ 1.234.{}", "JPY {}000", "Estimate {} CHF", "{},5 EUR", "A$ {:,}.75 (US$ 3)", "¥ {}1", "CA${:,}", "on request", "lot 0", "$ {}.9 or 12.345,6 £")
_PLAIN, _GROUPED = "CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS VARCHAR)", "format('{:,}', CAST(floor(l_extendedprice) AS BIGINT))"
_SHOWN_SQL = "replace(replace(([" + ",".join("'" + x + "'" for x in _SHOWN) + f"])[(l_partkey + l_suppkey + l_linenumber) % {len(_SHOWN)} + 1], '{{:,}}', {_GROUPED}), '{{}}', {_PLAIN})"
_MARK_LIST = "[" + ",".join("'" + m + "'" for m in mo.RANKED) + "]"
_CODES = "MAP {" + ",".join(f"'{m}': '{code}'" for m, code in mo.MARKS.items()) + "}"
_RATES = "MAP {" + ",".join(f"'{code}': {rate}::DOUBLE" for code, rate in mo.RATES.items()) + "}"
_MONEY_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    f"""WITH t AS (SELECT {_MONEY_KEYS}, {_SHOWN_SQL} AS shown FROM lineitem),
r AS (SELECT *, regexp_extract_all(replace(shown, ' ', ''), '(\\d[\\d.,]*\\d|\\d)', 1) AS runs, list_filter({_MARK_LIST}, lambda m: contains(upper(shown), m)) AS marks FROM t),
l AS (SELECT *, list_filter(runs, lambda x: length(x) = list_max(list_transform(runs, lambda y: length(y))))[1] AS s, CASE WHEN len(marks) > 0 THEN ({_CODES})[marks[1]] ELSE 'USD' END AS code FROM r),
n AS (
  SELECT *, TRY_CAST(CASE WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN length(string_split(s, ',')[-1]) < length(string_split(s, '.')[-1]) THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
    WHEN contains(s, ',') THEN CASE WHEN regexp_full_match(s, '\\d+,\\d{{1,2}}') THEN replace(s, ',', '.') ELSE replace(s, ',', '') END WHEN contains(s, '.') AND NOT regexp_full_match(s, '\\d+[.]\\d{{1,2}}') THEN replace(s, '.', '') ELSE s END AS DOUBLE) AS x FROM l
)
SELECT {_MONEY_KEYS}, shown, CASE WHEN x > 0 THEN x END AS native, CASE WHEN x > 0 THEN code END AS currency, CASE WHEN x > 0 THEN round_even(x * ({_RATES})[code], 2) END AS usd FROM n"""
)
def parse_money(spark, d):
    kind = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % len(_SHOWN)
    template = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), (kind + 1).cast("int"))
    price = F.col("l_extendedprice")
    shown = F.replace(F.replace(template, F.lit("{:,}"), F.format_number(F.floor(price).cast("long"), 0)), F.lit("{}"), F.floor(price / 100).cast("string"))
    rows = read(spark, d, "lineitem").withColumn("shown", shown).withColumn("m", mo.parse_money(F.col("shown")))
    return rows.select(*_MONEY_KEYS.split(", "), "shown", "m.native", "m.currency", "m.usd")


_SIZES = ("{n} {a} x {b} in", "{n} {a} x {b} cm", "{n} {a} by {b}", "{n} {a}.5 × {b}.25 inches", "{n} {a} 1/2 x {b} in.", 'H {a} x {b}" framed', "cm {a} x {b}, and on the other side {b} x {a} in", "no size {a}", "{n} {a}000 x {b} in")
_SIZE_SQL = "replace(replace(replace(([" + ",".join("'" + x + "'" for x in _SIZES) + f"])[p_partkey % {len(_SIZES)} + 1], '{{n}}', p_name), '{{a}}', p_size::VARCHAR), '{{b}}', (p_size + 4)::VARCHAR)"
_ONE = r"(\d+(?:\.\d+)?(?:\s+\d+\s*/\s*\d+)?)\s*(?:x|×|b|y)\s*(\d+(?:\.\d+)?(?:\s+\d+\s*/\s*\d+)?)"
_NUMBER = "CASE WHEN contains({0}, '/') THEN CAST(regexp_extract({0}, '^\\S+') AS DOUBLE) + CAST(regexp_extract({0}, '(\\d+)\\s*/', 1) AS DOUBLE) / CAST(regexp_extract({0}, '/\\s*(\\d+)', 1) AS DOUBLE) ELSE TRY_CAST({0} AS DOUBLE) END"


@query(
    f"""WITH t AS (SELECT p_partkey, {_SIZE_SQL} AS shown FROM part),
f AS (SELECT p_partkey, shown, unnest(regexp_extract_all(shown, '.{{0,4}}?{_ONE}.{{0,12}}')) AS found, generate_subscripts(regexp_extract_all(shown, '.{{0,4}}?{_ONE}.{{0,12}}'), 1) AS pos FROM t),
g AS (SELECT *, regexp_extract(found, '{_ONE}', 1) AS w, regexp_extract(found, '{_ONE}', 2) AS h, regexp_extract(found, '^(.*?){_ONE}', 1) AS head, regexp_extract(found, '{_ONE}(.*)$', 3) AS tail FROM f),
n AS (SELECT p_partkey, shown, pos, {_NUMBER.format("w")} AS w, {_NUMBER.format("h")} AS h, contains(tail, 'cm') OR contains(head, 'cm') AS cm, contains(tail, '"') OR contains(tail, 'in') OR regexp_matches(lower(head), '[hw]$') AS inch FROM g),
b AS (SELECT p_partkey, arg_min(struct_pack(w, h, cm), CASE WHEN inch AND NOT cm THEN pos ELSE 100 + pos END) AS s FROM n GROUP BY 1),
u AS (SELECT t.p_partkey, t.shown, s.w / CASE WHEN s.cm THEN 2.54 ELSE 1 END::DOUBLE AS w, s.h / CASE WHEN s.cm THEN 2.54 ELSE 1 END::DOUBLE AS h FROM t LEFT JOIN b USING (p_partkey))
SELECT p_partkey, shown, CASE WHEN w BETWEEN 0.5 AND 600 AND h BETWEEN 0.5 AND 600 THEN round_even(w, 1) END AS width, CASE WHEN w BETWEEN 0.5 AND 600 AND h BETWEEN 0.5 AND 600 THEN round_even(h, 1) END AS height,
  CASE WHEN w BETWEEN 0.5 AND 600 AND h BETWEEN 0.5 AND 600 THEN round_even(w * h, 1) END AS area FROM u"""
)
def parse_dims(spark, d):
    template = F.element_at(F.array(*[F.lit(x) for x in _SIZES]), (F.col("p_partkey") % len(_SIZES) + 1).cast("int"))
    shown = F.replace(F.replace(F.replace(template, F.lit("{n}"), F.col("p_name")), F.lit("{a}"), F.col("p_size").cast("string")), F.lit("{b}"), (F.col("p_size") + 4).cast("string"))
    return read(spark, d, "part").withColumn("shown", shown).withColumn("m", mo.parse_dimensions(F.col("shown"))).select("p_partkey", "shown", "m.width", "m.height", "m.area")


_DATED = ("untitled (c. {y}) 1999", "signed {y} and 1901", "no 18990 year", "view (circa {y})", "dated 2{y} or 2036, later {y}", "1066 and {y}")
_DATED_SQL = "replace(([" + ",".join("'" + x + "'" for x in _DATED) + f"])[p_partkey % {len(_DATED)} + 1], '{{y}}', CAST(1840 + p_size * 4 AS VARCHAR))"


@query(
    f"""WITH t AS (SELECT p_partkey, {_DATED_SQL} AS shown FROM part),
r AS (SELECT *, TRY_CAST(regexp_extract(shown, '(?i)\\((?:c(?:irca)?\\.?\\s*)?((?:18|19|20)\\d{{2}})\\)', 1) AS INTEGER) AS own, list_filter(list_transform(regexp_extract_all(shown, '\\d+'), lambda x: CASE WHEN regexp_full_match(x, '(18|19|20)\\d\\d') THEN CAST(x AS INTEGER) END), lambda y: y BETWEEN 1850 AND 2035) AS years FROM t)
SELECT p_partkey, shown, coalesce(own, years[1]) AS year FROM r"""
)
def parse_year(spark, d):
    template = F.element_at(F.array(*[F.lit(x) for x in _DATED]), (F.col("p_partkey") % len(_DATED) + 1).cast("int"))
    return read(spark, d, "part").withColumn("shown", F.replace(template, F.lit("{y}"), (F.col("p_size") * 4 + 1840).cast("string"))).select("p_partkey", "shown", mo.parse_work_year(F.col("shown")).alias("year"))


_TITLES = ["lithograph 12/200", "oil on canvas", "bronze figure", "framed LE", "Le Pho oil", "chair", "gelatin silver photograph", "wool tapestry", "ink drawing on paper", "circle of Monet, watercolor", "Gicleed canvas", "A.P. etching 3 / 50", "posters and prints", "acrylic on board"]
_TITLE_SQL = "(['" + "','".join(_TITLES) + "'])[1 + p_partkey % " + str(len(_TITLES)) + "]"
_MEDIA_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{pattern}') THEN '{name}'" for name, pattern in c.MEDIA) + " ELSE 'other' END"
_EDITION_MARK = "(^|[^A-Za-z])(LE|L[.]E[.]?|AP|A[.]P[.]?)($|[^A-Za-z])"


def _titles():
    return F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("p_partkey") % len(_TITLES) + 1).cast("int"))


@query(
    f"""WITH t AS (SELECT p_partkey, {_TITLE_SQL} AS title FROM part), m AS (SELECT *, regexp_matches(title, '{c.EDITION}') AS edition, regexp_matches(title, '{_EDITION_MARK}') AS mark, regexp_matches(title, '{c.UNIQUE}') AS uniq FROM t)
SELECT p_partkey, title, CASE WHEN edition OR mark THEN 'edition' WHEN uniq THEN 'unique' ELSE 'unknown' END AS cls, CASE WHEN edition THEN 'edition' WHEN uniq THEN 'unique' ELSE 'unknown' END AS unmarked, {_MEDIA_SQL} AS medium,
  regexp_matches(title, '{c.skip_pattern()}') OR regexp_matches(title, '(^|[^A-Za-z])(LE|L[.]E[.]?)($|[^A-Za-z])') AS skipped FROM m"""
)
def work_class(spark, d):
    t = _titles()
    return read(spark, d, "part").select("p_partkey", c.work_class(t).alias("cls"), c.work_class(t, marks=False).alias("unmarked"), c.medium_category(t).alias("medium"), c.skip_lot(t).alias("skipped"), t.alias("title"))


@query(
    """SELECT s_suppkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(s_name || ' Galleries, LLC.'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), '(^| )(llc|inc|ltd|co|company|corp)( (llc|inc|ltd|co|company|corp))*$', '') AS house FROM supplier"""
)
def house_keys(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", k.house_key(F.concat("s_name", F.lit(" Galleries, LLC."))).alias("house"))


@query(
    """WITH a AS (SELECT p_partkey, p_name AS a_key FROM part), b AS (SELECT DISTINCT p_name || ' auctions' AS b_key FROM part WHERE p_size > 45 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size = 1 AND p_type = 'PROMO')
SELECT p_partkey, a_key FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a_key = b_key OR least(length(a_key), length(b_key)) >= 4 AND CASE WHEN length(a_key) <= length(b_key) THEN contains(' ' || b_key || ' ', ' ' || a_key || ' ') ELSE contains(' ' || a_key || ' ', ' ' || b_key || ' ') END)"""
)
def exclusive_houses(spark, d):
    part = read(spark, d, "part")
    b = part.filter("p_size > 45").select(F.concat("p_name", F.lit(" auctions")).alias("b_key")).union(part.filter("p_size = 1 and p_type = 'PROMO'").select(F.split("p_name", " ")[0]))
    return ma.exclusive_houses(part.select("p_partkey", F.col("p_name").alias("a_key")), b)


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'widget') THEN 'widget' END AS fragment FROM part")
def blocked_match(spark, d):
    return ma.first_fragment(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), ["ring", "red", "widget"]).select("p_partkey", "fragment")


@query(f"WITH {HASHES} SELECT x.grp AS \"group\", x.id AS a, y.id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM hashes x JOIN hashes y ON x.grp = y.grp AND x.id < y.id AND bit_count(xor(x.hash, y.hash)) <= 20")
def hamming_pairs(spark, d):
    return ma.hamming_pairs(hashes(spark, d), 20)


@query(
    f"""WITH RECURSIVE {HASHES},
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY size DESC, id) AS place FROM hashes),
steps AS (SELECT x.grp, x.place AS earlier, y.place AS later FROM placed x JOIN placed y ON x.grp = y.grp AND x.place < y.place AND bit_count(xor(x.hash, y.hash)) <= 20),
ways AS (SELECT grp, place, place AS opener FROM placed UNION SELECT w.grp, s.later, w.opener FROM ways w JOIN steps s ON s.grp = w.grp AND s.earlier = w.place),
openers AS (SELECT grp, place, min(opener) AS opener FROM ways GROUP BY 1, 2)
SELECT o.grp AS "group", x.id AS id, y.id AS cluster FROM openers o JOIN placed x ON x.grp = o.grp AND x.place = o.place JOIN placed y ON y.grp = o.grp AND y.place = o.opener"""
)
def greedy_cluster(spark, d):
    return ma.greedy_clusters(hashes(spark, d), 20)


@query(
    """WITH variants AS (SELECT DISTINCT p_name AS variant_key, p_brand AS artist_id FROM part),
artists AS (SELECT p_brand AS artist_id, count(DISTINCT p_type) AS institutions, CASE WHEN max(p_size) > 49 THEN 1900 END AS birth_year FROM part GROUP BY 1),
asked AS (SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT upper(p_name) FROM part),
keys AS (SELECT name, 0 AS pos, lower(name) AS variant_key FROM asked UNION ALL SELECT name, 1, array_to_string(list_sort(string_split(lower(name), ' ')), ' ') FROM asked WHERE array_to_string(list_sort(string_split(lower(name), ' ')), ' ') <> lower(name)),
hits AS (SELECT name, artist_id, min(pos) AS pos FROM keys JOIN variants USING (variant_key) GROUP BY ALL),
best AS (SELECT *, min(pos) OVER (PARTITION BY name) AS first FROM hits),
ranked AS (SELECT b.name, b.artist_id, row_number() OVER (PARTITION BY b.name ORDER BY institutions DESC, birth_year IS NULL, b.artist_id) AS n, count(*) OVER (PARTITION BY b.name) AS many FROM best b JOIN artists USING (artist_id) WHERE pos = first)
SELECT name, artist_id, many > 1 AS ambiguous FROM ranked WHERE n = 1"""
)
def authority_lookup(spark, d):
    part = read(spark, d, "part")
    variants = part.select(F.col("p_name").alias("variant_key"), F.col("p_brand").alias("artist_id")).distinct()
    artists = part.groupBy(F.col("p_brand").alias("artist_id")).agg(F.count_distinct("p_type").alias("institutions"), F.when(F.max("p_size") > 49, 1900).alias("birth_year"))
    w = F.split("p_name", " ")
    names = part.select(F.concat_ws(" ", w[1], w[0]).alias("name")).union(part.select(F.upper("p_name"))).distinct()
    return r.authority_lookup(names, variants, artists)


@query(
    """WITH h AS (SELECT l_orderkey AS artist_id, n_name AS institution, count(*) AS works FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT artist_id, list_sort(list(institution)) AS museums, count(*) AS n, CAST(sum(works) AS BIGINT) AS works FROM h GROUP BY 1)
SELECT o_orderkey AS artist_id, coalesce(museums, []) AS museums, coalesce(n, 0) AS museum_count, coalesce(works, 0) AS works, CASE WHEN o_orderkey % 9 = 0 THEN ['Fellow of ' || o_orderstatus] ELSE [] END AS awards,
  CASE WHEN o_orderkey % 10 = 0 OR n >= 3 OR o_orderkey % 9 = 0 THEN 'strong' WHEN n >= 1 THEN 'listed' END AS standing FROM orders LEFT JOIN g ON artist_id = o_orderkey"""
)
def authority_rollup(spark, d):
    places = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    holdings = read(spark, d, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("artist_id"), F.col("n_name").alias("institution")).agg(F.count("*").alias("works"))
    orders, key = read(spark, d, "orders"), F.col("o_orderkey")
    awards = orders.filter(key % 9 == 0).select(key.alias("artist_id"), F.concat(F.lit("Fellow of "), F.col("o_orderstatus")).alias("distinction"))
    return r.authority_rollup(holdings, awards, orders.select(key.alias("artist_id"), (key % 10 == 0).cast("int").alias("papers")))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", c.strip_html(F.col("html")).alias("plain"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 1) AS h FROM pages) SELECT page_id, unnest(h) AS href FROM l")
def page_anchors(spark, d):
    return page_links(read(spark, d, "pages")).select("page_id", "href")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, CAST(nullif(list_filter(string_split_regex(url, '[/?#]'), lambda x: regexp_full_match(x, '\\d+'))[-1], '') AS BIGINT) AS number FROM pages")
def url_parse(spark, d):
    last = F.try_element_at(F.filter(F.split("url", r"[/?#]"), lambda s: s.rlike(r"^\d+$")), F.lit(-1))
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), last.try_cast("bigint").alias("number"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, least(count(*), 10) AS taken FROM events GROUP BY ALL")
def daily_quota(spark, d):
    rows = i.daily_quota(read(spark, d, "events"), ["user_id"], "ts", ["event_id"], 10)
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if("taken").alias("taken"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 72 HOURS")
def dedupe_lookback(spark, d):
    return i.first_sightings(read(spark, d, "events"), ["user_id", "event_type"], "ts", ["event_id"], 72).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 6 HOURS AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 72 HOURS")
def settle_delay(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return i.within(i.settled(read(spark, d, "events"), "ts", now, 6), "ts", now, 72).select("event_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 5 DAYS)")
def ttl_misses(spark, d):
    e = read(spark, d, "events")
    return i.cache_misses(e, e.filter("event_type = 'purchase'"), ["user_id"], "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 5)


@query("SELECT event_id, CASE WHEN n = 1 THEN 'first' WHEN event_type IS DISTINCT FROM last THEN 'changed' END AS notice FROM (SELECT event_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def notify_on_news(spark, d):
    return i.news(read(spark, d, "events"), "user_id", "ts", "event_type", ["event_id"]).select("event_id", "notice")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def stage_states(spark, d):
    return i.current_state(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens, event_id FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_sessions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = read(spark, d, "events").withColumn("opens", F.when(gap <= 1_800_000_000, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("session")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS score, p_size % 3 AS papers, p_partkey % 5 AS museums, CASE WHEN p_partkey % 7 = 0 THEN 1 END AS awards FROM part) SELECT p_partkey, CASE WHEN score >= 7.5 THEN 'A' WHEN score >= 5 THEN 'B' ELSE 'C' END AS tier, CASE WHEN papers = 2 OR museums >= 3 OR awards = 1 THEN 'strong' WHEN museums >= 1 THEN 'listed' END AS standing FROM t")
def standing_tiers(spark, d):
    papers = F.when(F.col("p_size") % 3 == 2, 1).when(F.col("p_size") % 3 == 1, 0)
    return read(spark, d, "part").select("p_partkey", c.score_tier(F.col("p_size") / 5).alias("tier"), c.standing(papers, F.col("p_partkey") % 5, F.when(F.col("p_partkey") % 7 == 0, 1)).alias("standing"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag IN ('A', 'N') AND l_extendedprice >= 400 AND (l_quantity <= 1 OR l_extendedprice >= l_quantity * 1000 * 8) AS flagged FROM lineitem"""
)
def flag_lots(spark, d):
    tier = F.when(F.col("l_returnflag").isin("A", "N"), "listed").otherwise("none")
    bid = F.when(F.col("l_quantity") > 1, F.col("l_quantity") * 1000)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c.flag_lot(tier, F.col("l_extendedprice"), bid).alias("flagged"))
