"""Watched sales over stand-ins: orders are polls of sales, customers the sales. The SQL reads the titles itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import names as n
from salesignal.operators import watch as w
from salesignal.plans.registry import query
from salesignal.plans.views import read

#: Titles of sales; {f} and {l} stand for a first and a last name.
TITLES = (
    "Estate of {f} R. {l} — Fine Art", "{l} Estate Auction", "The {f} {l} Collection", "Online Estate Auction — Tools & More", "Property of the late Mrs. {f} {l} and Sons", "Amazing Estate Sale Finds",
    "Greenville NC Estate Sale", "Collection of Dr. {f} {l} ONLINE Auction", "Lifetime Collection of Coins", "Home of {f} and Ann {l} in Reno, NV", "{f} {l} ABSOLUTE Estate Liquidation", "JULY ESTATE SALE",
)
UNTIL = "2003-01-01 00:00:00"


def _names(key):
    """Two words for a number, as the names of people."""
    first, last = F.array(*[F.lit(x) for x in ("Pfendler", "Mary", "Walter", "Josephine")]), F.array(*[F.lit(x) for x in ("Vogel", "O'Hara", "Smith-Jones", "Woodson", "Large")])
    return F.element_at(first, (key % 4 + 1).cast("int")), F.element_at(last, (key % 5 + 1).cast("int"))


def polls(spark, d):
    rows = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("sale"), F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_orderkey").alias("poll"))
    key = F.col("sale")
    first, last = _names(key)
    title = F.replace(F.replace(F.element_at(F.array(*[F.lit(t) for t in TITLES]), (key % len(TITLES) + 1).cast("int")), F.lit("{f}"), first), F.lit("{l}"), last)
    ends = F.date_add(F.lit("1996-01-01").cast("date"), (key % 2000 + F.col("poll") % 3 * 100).cast("int"))
    return rows.select("sale", "at", title.alias("title"), F.concat(F.lit("House "), (key % 7).cast("string")).alias("house"), F.when(key % 5 == 0, "Troy, NY").alias("location"), ends.alias("ends"))


def identities(spark, d):
    """What was found out about people, by house; later findings replace earlier ones."""
    key = F.col("c_custkey")
    first, last = _names(key)
    person = F.when(key % 2 == 0, F.concat_ws(" ", first, F.lit("R."), last)).otherwise(F.concat_ws(" ", first, last))
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("Collector", "not_notable", "unknown", "artist", "dealer")]), (key % 5 + 1).cast("int"))
    confidence = F.element_at(F.array(*[F.lit(v) for v in ("low", "high", "medium")]), (F.floor(key / 5) % 3 + 1).cast("int"))
    return read(spark, d, "customer").select(person.alias("person"), F.concat(F.lit("House "), (key % 7).cast("string")).alias("house"), verdict.alias("verdict"), confidence.alias("confidence"), F.timestamp_add("DAY", (key % 700).cast("int"), F.lit("1996-06-01 12:00:00").cast("timestamp")).alias("checked_at"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ",".join(_quoted(x) for x in items) + "]"


_F, _L = "(['Pfendler', 'Mary', 'Walter', 'Josephine'])[{k} % 4 + 1]", "(['Vogel', 'O''Hara', 'Smith-Jones', 'Woodson', 'Large'])[{k} % 5 + 1]"
_JUNK = _list(sorted({*n.NO_NAME, *n.TITLE_WORDS}))
_FOUND = " || ".join(f"regexp_extract_all(title, {_quoted(p)}, 1)" for p in (*n.PERSON_PATTERNS, n.NAME_THEN_ESTATE))
POLLS = f"""
read AS (SELECT o_custkey AS sale, CAST(o_orderdate AS TIMESTAMP) AS at_, max(o_orderkey) AS poll FROM orders GROUP BY ALL),
polls AS (
  SELECT sale, at_, replace(replace(({_list(TITLES)})[sale % {len(TITLES)} + 1], '{{f}}', {_F.format(k="sale")}), '{{l}}', {_L.format(k="sale")}) AS title, 'House ' || (sale % 7) AS house, CASE WHEN sale % 5 = 0 THEN 'Troy, NY' END AS location,
    DATE '1996-01-01' + CAST(sale % 2000 + poll % 3 * 100 AS INTEGER) AS ends FROM read
), found AS (
  SELECT title, list_transform({_FOUND}, lambda x: string_split(regexp_replace(regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '^[ .,''&-]+|[ .,''&-]+$', '', 'g'), '^(?:Late|The)\\s+', ''), ' ')) AS raws FROM (SELECT DISTINCT title FROM polls)
), named AS (
  SELECT title, list_filter(list_transform(raws, lambda ws: list_transform([list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains({_JUNK}, lower(ws[i])))], lambda g: CASE WHEN len(g) > 0 THEN ws[list_min(g):list_max(g)] ELSE [] END)[1]),
    lambda ws: len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains({_JUNK}, lower(x)))) = 0 AND length(array_to_string(ws, ' ')) >= 4 AND NOT (len(ws) = 1 AND upper(ws[1]) = ws[1])) AS people FROM found
), titles AS (SELECT title, array_to_string(people[1], ' ') AS person FROM named WHERE len(people) > 0),
identities AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN {_F.format(k="c_custkey")} || ' R. ' || {_L.format(k="c_custkey")} ELSE {_F.format(k="c_custkey")} || ' ' || {_L.format(k="c_custkey")} END AS person, 'House ' || (c_custkey % 7) AS house,
    lower((['Collector', 'not_notable', 'unknown', 'artist', 'dealer'])[c_custkey % 5 + 1]) AS verdict, (['low', 'high', 'medium'])[c_custkey // 5 % 3 + 1] AS confidence, TIMESTAMP '1996-06-01 12:00:00' + INTERVAL 1 DAY * (c_custkey % 700) AS checked_at FROM customer
), kept AS (SELECT person, house, arg_max(struct_pack(verdict, confidence, checked_at), (checked_at, verdict, confidence)) AS known FROM identities WHERE NOT (verdict = 'unknown' AND confidence = 'low') GROUP BY ALL),
sales AS (
  SELECT sale, at_, title, house, ends, person, CASE WHEN location IS NOT NULL THEN location WHEN regexp_matches(title, {_quoted(n.TITLE_PLACE)}) THEN regexp_extract(title, {_quoted(n.TITLE_PLACE)}, 1) || ', ' || regexp_extract(title, {_quoted(n.TITLE_PLACE)}, 2) ELSE 'the United States (exact city unknown)' END AS place,
    contains(person, ' ') AS researchable, CASE WHEN known.checked_at <= at_ THEN known.verdict END AS verdict, coalesce(known.checked_at <= at_ AND list_contains({_list(w.NOTABLE)}, known.verdict) AND list_contains({_list(w.SURE)}, known.confidence), false) AS notable
  FROM polls JOIN titles USING (title) LEFT JOIN kept USING (person, house)
), keyed AS (SELECT *, coalesce(verdict, CASE WHEN NOT researchable THEN 'surname_only' END, 'pending') AS verdict_key FROM sales)"""
NOTICES = f"""{POLLS},
numbered AS (SELECT *, row_number() OVER own AS n, lag(verdict_key) OVER own AS before, lead(at_) OVER own AS next_ FROM keyed WINDOW own AS (PARTITION BY sale ORDER BY at_)),
news AS (
  SELECT *, CASE WHEN n = 1 THEN 'first' WHEN verdict_key <> before THEN 'changed' END AS notice, CAST(ends - {w.CLOSING_DAYS} AS TIMESTAMP) AS due, greatest(CAST(ends - {w.CLOSING_DAYS} AS TIMESTAMP), at_ + INTERVAL {w.RUN_HOURS} HOURS) AS run FROM numbered
), closing AS (
  SELECT sale, c AS at_, 'closing' AS notice, verdict_key FROM (
    SELECT sale, verdict_key, CASE WHEN NOT notable THEN NULL WHEN notice IS NULL AND at_ >= due THEN at_ WHEN run <= TIMESTAMP '{UNTIL}' AND (next_ IS NULL OR run < next_) AND run < CAST(ends + 1 AS TIMESTAMP) THEN run END AS c FROM news)
  WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sale ORDER BY c) = 1
), sent AS (SELECT sale, at_, notice, verdict_key FROM news WHERE notice IS NOT NULL UNION ALL SELECT * FROM closing)"""


@query(f"WITH {POLLS} SELECT sale, at_ AS at, title, person, place, researchable, verdict, notable, verdict_key FROM keyed")
def named_sales(spark, d):
    return w.named_sales(polls(spark, d), identities(spark, d)).select("sale", "at", "title", "person", "place", "researchable", "verdict", "notable", "verdict_key")


@query(f"WITH {NOTICES} SELECT sale, at_ AS at, notice, verdict_key FROM sent")
def estate_notices(spark, d):
    return w.notices(w.named_sales(polls(spark, d), identities(spark, d)), F.lit(UNTIL).cast("timestamp"))


@query(
    f"""WITH {NOTICES}, last AS (SELECT sale, arg_max(notice, at_) AS notice FROM sent GROUP BY 1), latest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY sale ORDER BY at_ DESC) = 1)
SELECT sale, person, ends, notice, CAST(CASE WHEN notable THEN 0 WHEN verdict IS NULL THEN 1 ELSE 2 END AS INTEGER) AS band, notice = 'first' AS new FROM latest JOIN last USING (sale) ORDER BY band, new DESC, ends, sale"""
)
def estate_mail(spark, d):
    rows = w.named_sales(polls(spark, d), identities(spark, d))
    last = w.notices(rows, F.lit(UNTIL).cast("timestamp")).groupBy("sale").agg(F.max_by("notice", "at").alias("notice"))
    latest = rows.groupBy("sale").agg(F.max_by(F.struct("person", "ends", "notable", "verdict"), "at").alias("r")).select("sale", "r.*")
    return w.mail_order(latest.join(last, "sale")).select("sale", "person", "ends", "notice", "band", "new").orderBy("band", F.desc("new"), "ends", "sale")
