"""Pictures, replies, tables of fragments and results of searches over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import replies as rp
from salesignal.operators import match as m
from salesignal.plans.registry import query
from salesignal.plans.views import read
from salesignal.sources import images as im
from salesignal.sources import remote as r


@query(
    """WITH p AS (SELECT vec_id, list_transform(range(0, 72), lambda i: CAST(floor((embedding[i % 64 + 1]::DOUBLE + 1) * 100) AS INTEGER)) AS px FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda k: CASE WHEN px[k // 8 * 9 + k % 8 + 1] > px[k // 8 * 9 + k % 8 + 2] THEN 1 ELSE 0 END) AS bits FROM p)
SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * bits[4 * k + 1] + 4 * bits[4 * k + 2] + 2 * bits[4 * k + 3] + bits[4 * k + 4], 1)), '') AS hash FROM b"""
)
def picture_hashes(spark, d):
    """Vectors as grey pictures of 9 x 8 pixels."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor((F.get("embedding", i % 64).cast("double") + 1) * 100))
    data = F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    rows = read(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(9).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return im.with_hash(rows).select("vec_id", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount * 5 AS x, l_tax * 9 AS y, l_quantity / 50 AS w, (l_quantity % 7) / 7 AS h, CAST(l_orderkey % 900 + 40 AS INTEGER) AS pw, CAST(l_partkey % 700 + 40 AS INTEGER) AS ph FROM lineitem),
c AS (SELECT *, CAST(floor(greatest(0, x - w * 0.05::DOUBLE) * pw) AS INTEGER) AS l, CAST(floor(greatest(0, y - h * 0.05::DOUBLE) * ph) AS INTEGER) AS t, CAST(floor(least(1, x + w * 1.05::DOUBLE) * pw) AS INTEGER) AS r, CAST(floor(least(1, y + h * 1.05::DOUBLE) * ph) AS INTEGER) AS u FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l AS "left", t AS top, greatest(r, l + 8) AS "right", greatest(u, t + 8) AS bottom, (greatest(r, l + 8) - l) * (greatest(u, t + 8) - t) AS area,
  w > 0.005 AND h > 0.005 AND x >= 0 AND y >= 0 AND x + w <= 1.02 AND y + h <= 1.02 AS valid FROM c"""
)
def crop_boxes(spark, d):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    box = F.array(F.col("l_discount") * 5, F.col("l_tax") * 9, F.col("l_quantity") / 50, F.col("l_quantity") % 7 / 7)
    rows = read(spark, d, "lineitem").withColumn("crop", im.crop_box(box, (F.col("l_orderkey") % 900 + 40).cast("int"), (F.col("l_partkey") % 700 + 40).cast("int")))
    return rows.select(*keys, "crop.*", im.crop_area(F.col("crop")).alias("area"), rp.valid_box(box).isNotNull().alias("valid"))


@query(
    """WITH t AS (SELECT event_id, 'Sure ' || event_type || ': ' || CASE WHEN event_id % 3 = 0 THEN 'no {object} first, then ' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN '{"k": "broken' ELSE props END || ' and "so" on }' AS reply FROM events)
SELECT event_id, TRY_CAST(regexp_extract(regexp_extract(reply, '\\{"k": \\d+\\}'), '\\d+') AS INTEGER) AS k FROM t"""
)
def json_replies(spark, d):
    rows = read(spark, d, "events")
    told = F.concat(F.lit("Sure "), F.col("event_type"), F.lit(": "), F.when(F.col("event_id") % 3 == 0, "no {object} first, then ").otherwise(""), F.when(F.col("event_id") % 7 == 0, '{"k": "broken').otherwise(F.col("props")), F.lit(' and "so" on }'))
    return rows.select("event_id", F.from_json(rp.json_from_prose(told), "k int")["k"].alias("k"))


_N = "p_partkey"


@query(
    f"""WITH w AS (SELECT {_N}, unnest(range(0, {_N} % 4)) AS pos FROM part WHERE {_N} % 11 <> 0), b AS (SELECT {_N}, CAST(pos AS INTEGER) AS pos, ({_N} * 7 + pos * 3) % 10 / 10 AS x, ({_N} + pos) % 8 / 10 AS y, 0.5::DOUBLE + pos / 10 AS h FROM w)
SELECT {_N}, pos, (['painting', 'drawing', 'print'])[({_N} + pos) % 3 + 1] AS type, CASE WHEN ({_N} + pos) % 2 = 0 THEN 'True' ELSE 'False' END AS signed FROM b WHERE x + 0.25::DOUBLE <= 1.02 AND y + h <= 1.02"""
)
def detected_works(spark, d):
    photos = read(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("photo"))
    _, works = rp.detected(photos)
    return photos.join(works, "photo").select("p_partkey", "pos", "type", "signed")


@query(f"SELECT {_N}, CASE WHEN {_N} % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM part")
def detection_status(spark, d):
    photos = read(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("photo"))
    return rp.detected(photos)[0].select("p_partkey", "status")


@query(
    """WITH names AS (SELECT p_partkey, upper(p_name) || ' & ' || p_type AS name FROM part), frags AS (SELECT lower(substr(p_name, 1 + p_partkey % 5, 2 + p_size % 6)) AS fragment, min(p_retailprice * 1000 + p_partkey) AS pos FROM part WHERE p_size % 3 = 0 GROUP BY 1)
SELECT p_partkey, name, arg_min(fragment, pos) AS fragment FROM names LEFT JOIN frags ON contains(lower(name), fragment) AND fragment <> '' GROUP BY ALL"""
)
def fragment_matches(spark, d):
    part = read(spark, d, "part")
    names = part.select("p_partkey", F.concat(F.upper("p_name"), F.lit(" & "), F.col("p_type")).alias("name"))
    frags = part.filter("p_size % 3 = 0").select((F.col("p_retailprice") * 1000 + F.col("p_partkey")).alias("pos"), F.substring(F.col("p_name"), (F.col("p_partkey") % 5 + 1).cast("int"), F.col("p_size") % 6 + 2).alias("fragment"))
    return m.fragment_matches(names, frags)


_VALUE = """'{"auction": {"id": ' || o_custkey || ', "eventName": "  Sale ' || o_orderpriority || '", "eventDateEnd": "' || CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END || '", "eventCity": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'Reno' ELSE '' END || '", "auctioneer": {"name": "' || CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'House ' || (o_orderkey % 17) END || '", "city": "Troy", "state": "NY"}}}'"""


@query(
    f"""WITH v AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS page, CAST(o_orderkey % 100 AS INTEGER) AS pos, {_VALUE} AS value FROM orders),
p AS (SELECT page, pos, value, json_extract_string(value, '$.auction.id')::BIGINT AS id, TRY_CAST(json_extract_string(value, '$.auction.eventDateEnd') AS TIMESTAMP) AS ends, trim(json_extract_string(value, '$.auction.auctioneer.name')) AS house FROM v),
first AS (SELECT * FROM p WHERE id <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, pos, value) = 1)
SELECT id, substr(trim(json_extract_string(value, '$.auction.eventName')), 1, 120) AS title, house, 'https://hibid.com/catalog/' || id || '/_' AS url, 'ends ' || strftime(ends, '%m/%d') AS info,
  coalesce(nullif(json_extract_string(value, '$.auction.eventCity'), ''), 'Troy') || ', NY' AS location FROM first WHERE ends >= TIMESTAMP '1997-01-01' - INTERVAL 12 HOURS AND ends <= TIMESTAMP '1997-01-01' + INTERVAL 900 DAYS AND house <> ''"""
)
def auctions_open(spark, d):
    order = F.col("o_orderkey")
    ends = F.when(order % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    value = F.concat(
        F.lit('{"auction": {"id": '), F.col("o_custkey").cast("string"), F.lit(', "eventName": "  Sale '), F.col("o_orderpriority"), F.lit('", "eventDateEnd": "'), ends, F.lit('", "eventCity": "'), F.when(order % 2 == 0, "Reno").otherwise(""),
        F.lit('", "auctioneer": {"name": "'), F.when(order % 9 == 0, " ").otherwise(F.concat(F.lit("House "), (order % 17).cast("string"))), F.lit('", "city": "Troy", "state": "NY"}}}'),
    )
    rows = read(spark, d, "orders").select(F.floor(order / 100).cast("int").alias("page"), (order % 100).cast("int").alias("pos"), value.alias("value"))
    return r.open_auctions(rows, F.lit("1997-01-01 00:00:00").cast("timestamp"), after_days=900).select("id", "title", "house", "url", "info", "location")
