"""Joins, sorts, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from salesignal.operators import select as s
from salesignal.operators import upsert as u
from salesignal.operators.feeds import grown
from salesignal.plans.registry import query
from salesignal.plans.views import LEDGER, ledger, read

#: Line items that one part of a bridge holds on average, at most.
BRIDGED = 250_000


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_four_way(spark, d):
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = read(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT DISTINCT o_orderkey, s_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey")
def join_bridge(spark, d):
    line, orders, supplier = (read(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    # parts in proportion to the input, so that none grows with it
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // BRIDGED))
    line = line.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").distinct()
    met = orders.select("o_orderkey").repartition(n, "o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_suppkey")
    named = met.repartition(n, "l_suppkey").join(supplier.select("s_suppkey", "s_name").repartition(n, "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select("o_orderkey", "s_name").repartition(n, "o_orderkey").distinct()


@query("SELECT p_partkey, coalesce(t.total, 0) AS total, coalesce(p_name, p_brand, '?') AS shown FROM part LEFT JOIN (SELECT l_partkey, count(*) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON p_partkey = l_partkey")
def unsent_flags(spark, d):
    flags = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("total"))
    return read(spark, d, "part").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("p_name", "p_brand", F.lit("?")).alias("shown"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def unfinished_exists(spark, d):
    customers, orders = read(spark, d, "customer"), read(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return customers.join(orders.filter("o_orderstatus = 'P'"), on, "left_semi").select("c_custkey").union(customers.join(orders.filter("o_totalprice > 450000"), on, "left_semi").select("c_custkey")).distinct()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unharvested_anti(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unassigned_anti(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer"""
)
def status_correlated(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    zero = F.lit(0).cast("long")
    return read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", zero).alias("n_orders"), F.coalesce("n_open", zero).alias("n_open"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS newest, max(o_orderdate) AS at FROM orders GROUP BY 1")
def latest_row(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), F.max("o_orderdate").alias("at"))


_GROWTH = """WITH held AS (SELECT l_partkey, count(*) AS held FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), feed AS (SELECT l_partkey, count(*) AS seen FROM lineitem GROUP BY 1)
SELECT l_partkey, held, seen FROM feed JOIN held USING (l_partkey) WHERE seen >= held + 5"""


@query(_GROWTH)
def growth_join(spark, d):
    line = read(spark, d, "lineitem")
    held = line.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("l_partkey").agg(F.count("*").alias("held"))
    return grown(line, held, "l_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) = lower('SUPPLIER#000000007') OR lower(s_name) = 'supplier#000000011'")
def equal_nocase(spark, d):
    return read(spark, d, "supplier").filter(F.lower("s_name").isin("supplier#000000007", "supplier#000000011")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, d):
    top = read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query(
    """SELECT p_partkey, (p_size % 2) * 3.0 + (p_size % 3 = 0)::INTEGER * 2.0 + CASE WHEN p_brand = 'Brand#1' THEN 1.0 ELSE 0 END
  + CASE p_type WHEN 'ECONOMY' THEN 2.0 WHEN 'STANDARD' THEN 1.5 WHEN 'PROMO' THEN 1.0 WHEN 'SMALL' THEN 1.0 WHEN 'LARGE' THEN 0.75 ELSE 0.5 END AS score FROM part"""
)
def best_first_queue(spark, d):
    kinds = {"ECONOMY": "painting", "STANDARD": "drawing", "PROMO": "sculpture", "SMALL": "ceramic", "LARGE": "unknown"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("p_type")), F.lit("other"))
    works = read(spark, d, "part").withColumns({"sig_visible": F.col("p_size") % 2, "label_visible": (F.col("p_size") % 3 == 0).cast("int"), "prominence": F.when(F.col("p_brand") == "Brand#1", "background"), "coarse_type": kind})
    return s.best_first(works).select("p_partkey", "score")


@query(
    f"""WITH {LEDGER}, t AS (SELECT coalesce(lower(category), 'other') AS category, count(*) FILTER (kind IN ('save', 'promote')) AS positive, count(*) FILTER (kind = 'dismiss' AND coalesce(reason, '') <> 'print/repro') AS negative FROM ledger GROUP BY 1)
SELECT category, positive, negative, round(greatest(-1, least(1, ln((positive + 1) / (negative + 1)) / 2)), 6) AS boost FROM t WHERE positive + negative >= 8"""
)
def taste_prior(spark, d):
    return s.taste_prior(ledger(spark, d))


@query(
    f"""WITH {LEDGER}, t AS (SELECT category, round(greatest(-1, least(1, ln((count(*) FILTER (kind IN ('save', 'promote')) + 1) / (count(*) FILTER (kind = 'dismiss' AND coalesce(reason, '') <> 'print/repro') + 1)) / 2)), 6) AS boost FROM ledger GROUP BY 1
HAVING count(*) FILTER (kind IN ('save', 'promote') OR kind = 'dismiss' AND coalesce(reason, '') <> 'print/repro') >= 8)
SELECT p_partkey, round(p_size / 10.0::DOUBLE + coalesce(boost, 0), 6) AS score FROM part LEFT JOIN t ON t.category = 'c' || (p_size % 14)::VARCHAR"""
)
def review_queue(spark, d):
    prior = s.taste_prior(ledger(spark, d)).select("category", "boost")
    works = read(spark, d, "part").withColumn("category", F.concat(F.lit("c"), (F.col("p_size") % 14).cast("string")))
    return works.join(prior, "category", "left").select("p_partkey", F.round(F.col("p_size") / 10.0 + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


_SALES = """sales AS (
  SELECT o_orderkey AS id, r_name AS place, CAST(sum(l_quantity) AS BIGINT) AS pictures, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _sales(spark, d):
    pictures = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("pictures"))
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(pictures, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("r_name").alias("place"), "pictures", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("type"))


@query(
    f"""WITH {_SALES} SELECT id, pictures, type, row_number() OVER (ORDER BY CASE WHEN type IN (1, 2) THEN 0 ELSE 1 END, -least(pictures, 400), pictures, id) AS rank FROM sales
WHERE place IN ('AMERICA', 'EUROPE') AND pictures >= 40 AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)"""
)
def pick_sales(spark, d):
    known = read(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_orderkey").alias("id"))
    watched = read(spark, d, "region").filter(F.col("r_name").isin("AMERICA", "EUROPE")).select(F.col("r_name").alias("place"))
    return s.ranked_sales(_sales(spark, d), known, watched, 40, [1, 2]).select("id", "pictures", "type", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_tax + 0.01::DOUBLE AS cost, sum(CAST(l_tax + 0.01::DOUBLE AS DECIMAL(18,4))) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(spent, 4) AS spent, spent - CAST(cost AS DECIMAL(18,4))::DOUBLE < 2.0 AS attempted, spent < 2.0 AS completed FROM r"""
)
def budget_admit(spark, d):
    rows = read(spark, d, "lineitem").withColumn("cost", F.col("l_tax") + 0.01)
    out = s.admit(rows, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], "cost", F.lit(2.0))
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("spent", 4).alias("spent"), "attempted", "completed")


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS "at", greatest(1, count(*) OVER (PARTITION BY o_custkey) // 3) AS step FROM orders) WHERE "at" % step = 0 AND "at" < step * 3"""
)
def evenly_spaced(spark, d):
    return s.evenly_spaced(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    """SELECT o_custkey, o_orderkey, coalesce(CAST(o_orderdate AS DATE) <> lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS header FROM orders"""
)
def day_headers(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(day != F.lag(day).over(w), F.lit(True)).alias("header"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return read(spark, d, "customer").select("c_custkey").subtract(read(spark, d, "orders").select("o_custkey"))


@query("SELECT p_partkey, p_name, 'old' AS origin FROM part WHERE p_size <= 25 UNION ALL SELECT min(p_partkey), p_name, 'new' FROM part WHERE p_size > 25 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 25) GROUP BY p_name")
def merge_ignore(spark, d):
    part = read(spark, d, "part")
    old, new = (part.filter(f"p_size {c} 25").select("p_partkey", "p_name", F.lit(o).alias("origin")) for c, o in (("<=", "old"), (">", "new")))
    return u.insert_ignore(old, new, ["p_name"], [F.col("p_partkey")])


@query("SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY (p_size > 25) DESC, p_partkey DESC) AS n FROM part) WHERE n = 1")
def merge_replace(spark, d):
    part = read(spark, d, "part")
    return u.insert_replace(part.filter("p_size <= 25").select("p_name", "p_partkey"), part.filter("p_size > 25").select("p_name", "p_partkey"), ["p_name"], [F.desc("p_partkey")])


_OLD = "o AS (SELECT p_brand, max(p_size) AS size, min(p_retailprice) AS price, 'b,a' AS sources FROM part WHERE p_type <> 'PROMO' GROUP BY 1)"
_NEW = "n AS (SELECT p_brand, CASE WHEN max(p_size) > 40 THEN max(p_size) END AS size, max(p_retailprice) AS price, 'c,a' AS sources FROM part WHERE p_type = 'PROMO' GROUP BY 1)"


def _old_new(spark, d):
    part = read(spark, d, "part")
    old = part.filter("p_type <> 'PROMO'").groupBy("p_brand").agg(F.max("p_size").alias("size"), F.min("p_retailprice").alias("price"), F.lit("b,a").alias("sources"))
    new = part.filter("p_type = 'PROMO'").groupBy("p_brand").agg(F.when(F.max("p_size") > 40, F.max("p_size")).alias("size"), F.max("p_retailprice").alias("price"), F.lit("c,a").alias("sources"))
    return old, new


@query(f"WITH {_OLD}, {_NEW} SELECT p_brand, coalesce(n.size, o.size) AS size, coalesce(o.price, n.price) AS price, coalesce(o.sources, n.sources) AS sources FROM o FULL JOIN n USING (p_brand)")
def merge_columns(spark, d):
    return u.upsert_columns(*_old_new(spark, d), ["p_brand"], ["size"])


@query(f"WITH {_OLD}, {_NEW} SELECT p_brand, CASE WHEN n.p_brand IS NULL OR o.size >= 50 THEN o.size ELSE n.size END AS size, CASE WHEN n.p_brand IS NULL OR o.size >= 50 THEN o.price ELSE n.price END AS price, CASE WHEN n.p_brand IS NULL OR o.size >= 50 THEN o.sources ELSE n.sources END AS sources FROM o FULL JOIN n USING (p_brand)")
def merge_conditional(spark, d):
    return u.upsert_unless(*_old_new(spark, d), ["p_brand"], F.col("o.size") >= 50)


@query(f"WITH {_OLD}, {_NEW} SELECT p_brand, coalesce(o.size, n.size) AS size, greatest(o.price, n.price) AS price, CASE WHEN o.p_brand IS NULL THEN 'a,c' WHEN n.p_brand IS NULL THEN 'a,b' ELSE 'a,b,c' END AS sources FROM o FULL JOIN n USING (p_brand)")
def merge_fill(spark, d):
    return u.upsert_fill(*_old_new(spark, d), ["p_brand"], greatest=("price",), sets=("sources",))


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS works FROM part GROUP BY 1")
def merge_additive(spark, d):
    part = read(spark, d, "part")
    old, new = (part.filter(c).groupBy("p_brand").agg(F.sum("p_size").alias("works")) for c in ("p_type <> 'PROMO'", "p_type = 'PROMO'"))
    return u.upsert_add(old, new, ["p_brand"], ["works"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_by_key(spark, d):
    gone = read(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return u.delete_keys(read(spark, d, "supplier"), gone, ["s_nationkey"]).select("s_suppkey", "s_name")
