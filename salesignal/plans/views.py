"""The driver's tables seen as the entities of the domain, in Spark and in DuckDB SQL.

A line item is a sale record, a part's brand its artist, a supplier its house, an order its auction, a nation its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.functions.classify import is_suspect

NOW_YEAR = 2002
#: A ceiling and a price that the stand-in prices reach: they start near 900.
CEILING, CHEAP, SHARE = 90_000.0, 1_500.0, 0.015


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Sale records: comp_id, artist_key, medium_category, title, work_class, area_sqin, work_year, price_usd, outcome, tier, sale_year, sale_date, house, venue, suspect."""
    line, part, supplier, orders = (read(spark, d, t) for t in ("lineitem", "part", "supplier", "orders"))
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    outcome = F.when(F.col("l_returnflag") == "R", "unsold").when(F.col("l_returnflag") == "N", "final_bid").otherwise("sold")
    comp = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    out = rows.select(
        comp.alias("comp_id"), F.lower("p_brand").alias("artist_key"), F.col("p_type").alias("medium_category"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 25, "unique").otherwise("edition").alias("work_class"), (F.col("p_size") * F.col("l_quantity")).alias("area_sqin"), F.year("o_orderdate").alias("work_year"),
        F.col("l_extendedprice").alias("price_usd"), outcome.alias("outcome"), F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("tier"), F.year("l_shipdate").alias("sale_year"),
        F.to_date("l_shipdate").alias("sale_date"), F.col("s_name").alias("house"), F.when(F.col("r_name") == "AMERICA", "big3").otherwise("mid").alias("venue"),
    )
    return out.withColumn("suspect", is_suspect(F.col("price_usd"), F.col("outcome"), F.lit(CEILING), 10_000, CHEAP, SHARE + 0.01))


PRICES = f"""
prices AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS comp_id, lower(p_brand) AS artist_key, p_type AS medium_category, p_name AS title,
    CASE WHEN p_size > 25 THEN 'unique' ELSE 'edition' END AS work_class, p_size * l_quantity AS area_sqin, CAST(year(o_orderdate) AS INTEGER) AS work_year, l_extendedprice AS price_usd,
    CASE l_returnflag WHEN 'R' THEN 'unsold' WHEN 'N' THEN 'final_bid' ELSE 'sold' END AS outcome, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS tier,
    CAST(year(l_shipdate) AS INTEGER) AS sale_year, CAST(l_shipdate AS DATE) AS sale_date, s_name AS house, CASE WHEN r_name = 'AMERICA' THEN 'big3' ELSE 'mid' END AS venue,
    l_returnflag <> 'R' AND l_extendedprice > 0 AND l_extendedprice < {CHEAP} AND l_extendedprice < {CEILING} * {SHARE + 0.01} AS suspect
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey
)"""


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """A work to value for each artist and medium."""
    p = read(spark, d, "part").groupBy(F.lower("p_brand").alias("artist_key"), F.col("p_type").alias("medium_category"))
    return p.agg((F.max("p_size") * 25.0).alias("area_sqin"), F.lit(1996).alias("work_year"), F.array(F.min("p_name")).alias("series_tokens")).withColumn("subject_id", F.concat_ws("/", "artist_key", "medium_category"))


SUBJECTS = """
subjects AS (
  SELECT lower(p_brand) AS artist_key, p_type AS medium_category, max(p_size) * 25.0::DOUBLE AS area_sqin, 1996 AS work_year, min(p_name) AS token, lower(p_brand) || '/' || p_type AS subject_id
  FROM part GROUP BY ALL
)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Reactions to works: event_id, ts, user_id, category, kind, reason."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type").isin("purchase"), "save").when(F.col("event_type") == "signup", "promote").when(F.col("event_type").isin("error", "click"), "dismiss")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("c"), F.pmod(k, F.lit(14)).cast("string")).alias("category"), kind.alias("kind"), F.when(F.col("event_type") == "error", "print/repro").alias("reason"), "value")


LEDGER = """
ledger AS (
  SELECT event_id, ts, user_id, 'c' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 14)::VARCHAR AS category,
    CASE WHEN event_type = 'purchase' THEN 'save' WHEN event_type = 'signup' THEN 'promote' WHEN event_type IN ('error', 'click') THEN 'dismiss' END AS kind,
    CASE WHEN event_type = 'error' THEN 'print/repro' END AS reason, value FROM events
)"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Views of works with a 64-bit hash: id, group (the label), hash, size."""
    from salesignal.operators.match import sign_hash

    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), sign_hash(F.col("embedding")).alias("hash"), F.round(F.abs(F.col("embedding")[0]) * 1000).cast("int").alias("size"))


HASHES = """
hashes AS (
  SELECT vec_id AS id, label AS grp, CAST(round(abs(embedding[1]) * 1000) AS INTEGER) AS size, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS hash FROM embeddings
)"""
