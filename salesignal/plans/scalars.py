"""Rules on single values that no other query applies; the SQL reads the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions import money as mo
from salesignal.functions import names as n
from salesignal.plans.registry import query
from salesignal.plans.views import read


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ",".join(_quoted(x) for x in items) + "]"


SIGNED = ("Signed lower right: {f} {l} '84", "{f} {l}", "illegible", "sgd. J. {l} (1920)", "{f} van der {l} the elder", "B. B.", 'titled "Evening" verso, {l} {f}.', "M {f}")


@query(
    f"""WITH t AS (SELECT p_partkey, replace(replace(({_list(SIGNED)})[p_partkey % {len(SIGNED)} + 1], '{{f}}', split_part(p_name, ' ', 1)), '{{l}}', upper(split_part(p_name, ' ', 2))) AS raw FROM part),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {_quoted(n.SIGNATURE_NOISE)}, ' ', 'g'), '["“”''`]', ' ', 'g'), '\\(.*?\\)', ' ', 'g'), '[0-9]', ' ', 'g'), '[^A-Za-z.\\-'' ]', ' ', 'g') AS s FROM t),
w AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), '^[ .\\-'']+|[ .\\-'']+$', '', 'g'), ' '), lambda x: length(x) > 1 OR suffix(x, '.')) AS ws FROM a)
SELECT p_partkey, raw, CASE WHEN len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda x: length(regexp_replace(x, '^[.]+|[.]+$', '', 'g')) >= 3)) > 0
  THEN array_to_string(list_transform(ws, lambda x: CASE WHEN length(x) > 2 THEN upper(x[1]) || lower(x[2:]) ELSE upper(x) END), ' ') ELSE '' END AS name FROM w"""
)
def clean_signatures(spark, d):
    raw = F.element_at(F.array(*[F.lit(s) for s in SIGNED]), (F.col("p_partkey") % len(SIGNED) + 1).cast("int"))
    raw = F.replace(F.replace(raw, F.lit("{f}"), F.split("p_name", " ")[0]), F.lit("{l}"), F.upper(F.split("p_name", " ")[1]))
    return read(spark, d, "part").withColumn("raw", raw).select("p_partkey", "raw", n.clean_signature(F.col("raw")).alias("name"))


@query(
    """SELECT p_partkey, CASE WHEN amount >= 2000 THEN 'strong' WHEN amount > 0 OR hits THEN 'listed' WHEN results > 0 THEN 'minor' ELSE 'none' END AS checked, uncertain = 1 OR signed = 1 OR coalesce(TRY_CAST(promise AS DOUBLE) >= 5, true) AS escalated,
  CASE WHEN p_retailprice > 0 AND p_retailprice < 100 THEN p_retailprice * 1000 ELSE p_retailprice END AS sane, (p_size * coalesce(CASE WHEN p_size % 2 = 0 THEN 3.0 END, 5.0) + p_partkey * coalesce(CASE WHEN p_size % 2 = 0 THEN 15.0 END, 25.0)) / 1000000::DOUBLE AS cost
FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN p_size * 60 ELSE 0 END AS amount, p_size % 9 = 0 AS hits, p_size % 5 AS results, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS uncertain, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS signed, CASE WHEN p_partkey % 8 = 0 THEN 'high' ELSE CAST(p_partkey % 10 AS VARCHAR) END AS promise FROM part)"""
)
def gates(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    hits = F.when(size % 9 == 0, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    amount = F.when(size % 4 == 0, size * 60).otherwise(0)
    price = F.when(size % 2 == 0, 3.0), F.when(size % 2 == 0, 15.0)
    return read(spark, d, "part").select(
        "p_partkey", c.checker_tier(amount, hits, F.lit(None).cast("array<string>"), size % 5).alias("checked"),
        c.escalates(F.when(key % 10 == 0, 1), F.when(key % 6 == 0, 1).otherwise(0), F.lit(None).cast("int"), F.when(key % 8 == 0, "high").otherwise((key % 10).cast("string"))).alias("escalated"),
        mo.sane_usd(F.col("p_retailprice")).alias("sane"), c.call_cost(size, key, *price).alias("cost"),
    )


GALLERIES = ("Gagosian {l}", "Pace Gallery auction", "Jack Shainman", "Night Gallery ({f})", "PPOW", "County Museum of {l}", "{f} Fine Arts", "Kasmin benefit")


@query(
    f"""WITH t AS (SELECT p_partkey, replace(replace(({_list(GALLERIES)})[p_partkey % {len(GALLERIES)} + 1], '{{f}}', split_part(p_name, ' ', 1)), '{{l}}', split_part(p_name, ' ', 2)) AS name, p_brand || ' ' || (['Christie''s', 'Local House', 'SOTHEBY Online', 'phillipsburg'])[p_size % 4 + 1] AS house FROM part)
SELECT p_partkey, name, house, CASE WHEN regexp_matches(lower(name), {_quoted(c.NO_GALLERY)}) THEN 0 {" ".join(f"WHEN regexp_matches(lower(name), {_quoted(g)}) THEN {i}" for i, g in enumerate(c.GALLERY_TIERS, 1))} ELSE 0 END AS tier,
  CASE WHEN regexp_matches(lower(house), 'christie|sotheby|phillips') THEN 'big3' ELSE 'mid' END AS venue, least(100, 12 * (contains(lower(name), 'gallery')::INTEGER + contains(lower(name), 'pace')::INTEGER + contains(lower(name), 'fine')::INTEGER)) AS score FROM t"""
)
def gallery_tiers(spark, d):
    name = F.element_at(F.array(*[F.lit(g) for g in GALLERIES]), (F.col("p_partkey") % len(GALLERIES) + 1).cast("int"))
    name = F.replace(F.replace(name, F.lit("{f}"), F.split("p_name", " ")[0]), F.lit("{l}"), F.split("p_name", " ")[1])
    house = F.concat("p_brand", F.lit(" "), F.element_at(F.array(*[F.lit(h) for h in ("Christie's", "Local House", "SOTHEBY Online", "phillipsburg")]), F.col("p_size") % 4 + 1))
    rows = read(spark, d, "part").select("p_partkey", name.alias("name"), house.alias("house"))
    return rows.select("*", c.gallery_tier(F.col("name")).alias("tier"), c.venue_tier(F.col("house")).alias("venue"), c.keyword_score(F.col("name"), ("gallery", "pace", "fine")).alias("score"))


@query(
    """WITH t AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) END AS single, CASE WHEN o_orderkey % 3 = 1 THEN floor(o_totalprice / 2) END AS low, floor(o_totalprice) AS high, '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.5 or 7' AS shown, 'b. ' || o_orderpriority || ' -' || CAST(o_orderkey % 3000 AS VARCHAR) AS born FROM orders),
y AS (SELECT *, TRY_CAST(nullif(regexp_extract(born, '(-?\\d{3,4})', 1), '') AS INTEGER) AS year FROM t)
SELECT o_orderkey, CASE WHEN single > 0 THEN '$' || format('{:,}', CAST(single AS BIGINT)) WHEN low > 0 AND high > 0 THEN '$' || format('{:,}', CAST(low AS BIGINT)) || '–' || format('{:,}', CAST(high AS BIGINT)) END AS label,
  TRY_CAST(replace(regexp_extract(replace(shown, '$', ''), '([\\d,]+(?:\\.\\d{1,2})?)', 1), ',', '') AS DOUBLE) AS price, CASE WHEN year BETWEEN 1000 AND 2030 THEN year END AS year FROM y"""
)
def labels_of_value(spark, d):
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    label = mo.fmv_label(F.when(key % 3 == 0, F.floor(total).cast("double")), F.when(key % 3 == 1, F.floor(total / 2).cast("double")), F.floor(total).cast("double"))
    shown = F.concat(F.lit("$"), F.format_number(F.floor(total).cast("long"), 0), F.lit(".5 or 7"))
    born = F.concat(F.lit("b. "), F.col("o_orderpriority"), F.lit(" -"), (key % 3000).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", label.alias("label"), mo.parse_price(shown).alias("price"), mo.year_of(born).alias("year"))


NOTES = ("Estate of Mr. {f} {l} and Family", "The {f} {l} Collection <b>of art</b>", "Property of {l} Antiques", "home of the late {f}, collection of {l} & {f} {l}")


@query(
    f"""WITH t AS (SELECT p_partkey, replace(replace(({_list(NOTES)})[p_partkey % {len(NOTES)} + 1], '{{f}}', upper(p_name[1]) || split_part(p_name, ' ', 1)[2:]), '{{l}}', upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]) AS note FROM part),
x AS (SELECT *, note || chr(10) || substr(regexp_replace(note, '<[^>]+>', ' ', 'g'), 1, 600) AS body FROM t),
f AS (SELECT *, {" || ".join(f"regexp_extract_all(body, {_quoted(p)}, 1)" for p in n.PERSON_PATTERNS)} AS found FROM x),
c AS (SELECT p_partkey, note, list_filter(list_transform(found, lambda r: regexp_replace(trim(regexp_replace(r, '\\s+', ' ', 'g')), '^[ .,''&-]+|[ .,''&-]+$', '', 'g')), lambda s: length(s) >= 4 AND len(list_filter(string_split(s, ' '), lambda w: list_contains({_list(n.NO_NAME)}, lower(w)))) = 0) AS names FROM f)
SELECT p_partkey, note, list_transform(list_filter(range(1, len(names) + 1), lambda i: list_position(names, names[i]) = i), lambda i: names[i])[1:3] AS people FROM c"""
)
def people_in_notes(spark, d):
    note = F.element_at(F.array(*[F.lit(x) for x in NOTES]), (F.col("p_partkey") % len(NOTES) + 1).cast("int"))
    note = F.replace(F.replace(note, F.lit("{f}"), F.initcap(F.split("p_name", " ")[0])), F.lit("{l}"), F.initcap(F.split("p_name", " ")[1]))
    rows = read(spark, d, "part").select("p_partkey", note.alias("note"))
    return rows.select("*", n.extract_names(F.col("note"), F.col("note")).alias("people"))
