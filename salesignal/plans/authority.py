"""The authority built from catalogue records; the SQL reads the same raw names and adds the records one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesignal.functions import names as n
from salesignal.operators import authority as a
from salesignal.plans.registry import query
from salesignal.plans.views import read

SOURCES = ("moma", "whitney", "nga", "met", "aic", "ulan", "county archive")


def records(spark, d):
    """A catalogue record for each part: a name in one of the forms that catalogues use, an outside id that other names share, and what the source holds."""
    part = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    first = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(" "), F.char(65 + size % 6), F.lit("."))
    last = F.initcap(F.split("p_name", " ")[1])
    form = key % 6
    raw = F.when(key % 29 == 0, "Unidentified artist").when(key % 31 == 0, F.concat(first, F.lit(" "), last, F.lit(" Company"))).when(key % 37 == 0, last).when(form == 0, F.concat(last, F.lit(", "), first, F.lit(", 1838-1921")))
    raw = raw.when(form == 1, F.concat(first, F.lit(" "), last, F.lit(" (American, 1844-1926)"))).when(form == 2, F.concat(last, F.lit(", "), first, F.lit(", American"))).when(form == 3, F.concat(first, F.lit("  "), last))
    raw = raw.when(form == 4, F.upper(F.concat(first, F.lit(" "), last))).otherwise(F.concat(last, F.lit(", "), first, F.lit(", II [painter]")))
    rank = F.substring_index("p_brand", "#", -1).cast("int") % len(SOURCES)
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), rank + 1)
    outside = F.when(size % 3 != 0, F.concat(F.lit("500"), F.lpad((key * 7919 % 240).cast("string"), 6, "0")))
    return part.select(
        F.struct(rank.alias("rank"), key.alias("place")).alias("seq"), source.alias("source"), raw.alias("raw_name"), outside.alias("outside_id"), F.when(key % 5 == 0, F.concat(F.lit("Q"), key.cast("string"))).alias("wikidata_qid"),
        F.when(size % 4 == 0, size + 1850).alias("birth_year"), F.when(size % 8 == 0, size + 1900).alias("death_year"), F.when(key % 7 == 0, "American").alias("nationality"), (key % 41 == 0).cast("int").alias("papers"),
        F.when(rank != 5, source).alias("institution"), size.cast("long").alias("works"), F.when(key % 53 == 0, "Guggenheim Fellow").alias("distinction"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FIRST = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || chr(65 + p_size % 6) || '.'"
_LAST = "upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"
RECORDS = f"""
named AS (SELECT *, {_FIRST} AS f, {_LAST} AS l, CAST(split_part(p_brand, '#', 2) AS INTEGER) % {len(SOURCES)} AS rank FROM part),
raws AS (
  SELECT *, ([{",".join(_quoted(s) for s in SOURCES)}])[rank + 1] AS source,
    CASE WHEN p_partkey % 29 = 0 THEN 'Unidentified artist' WHEN p_partkey % 31 = 0 THEN f || ' ' || l || ' Company' WHEN p_partkey % 37 = 0 THEN l WHEN p_partkey % 6 = 0 THEN l || ', ' || f || ', 1838-1921' WHEN p_partkey % 6 = 1 THEN f || ' ' || l || ' (American, 1844-1926)'
      WHEN p_partkey % 6 = 2 THEN l || ', ' || f || ', American' WHEN p_partkey % 6 = 3 THEN f || '  ' || l WHEN p_partkey % 6 = 4 THEN upper(f || ' ' || l) ELSE l || ', ' || f || ', II [painter]' END AS raw,
    CASE WHEN p_size % 3 <> 0 THEN '500' || lpad(CAST(p_partkey * 7919 % 240 AS VARCHAR), 6, '0') END AS u FROM named
), cut AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(raw, '\\(.*?\\)|\\[.*?\\]', ' ', 'g'), '^(.*?)(,\\s*(?:b\\.|d\\.|ca\\.|circa|active|fl\\.|\\d)|$)', 1), '\\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') AS s FROM raws
), parted AS (SELECT *, list_filter(list_transform(string_split(s, ','), lambda p: trim(p)), lambda p: p <> '') AS p0 FROM cut),
kept AS (SELECT *, p0[1:1] || list_filter(p0[2:], lambda p: NOT regexp_matches(p, {_quoted(n.QUALIFIER)})) AS p FROM parted),
cleaned AS (SELECT *, CASE WHEN len(p) >= 2 THEN array_to_string([p[2], p[1]] || p[3:], ' ') ELSE p[1] END AS name FROM kept WHERE s <> '' AND NOT regexp_matches(s, {_quoted(n.NO_PERSON)}) AND NOT regexp_matches(s, '\\d')),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM cleaned WHERE length(name) >= 5 AND contains(name, ' ')),
ordered AS (SELECT *, row_number() OVER (ORDER BY rank, p_partkey) AS n FROM keyed WHERE length(k) >= 4 AND contains(k, ' ')),
steps AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS ks, []::VARCHAR[] AS us, NULL::VARCHAR AS entity_key
  UNION ALL
  SELECT n, CASE WHEN pos > len(ks) THEN list_append(ks, k) ELSE ks END, CASE WHEN pos > len(ks) THEN list_append(us, u) WHEN us[pos] IS NULL AND u IS NOT NULL THEN us[1:pos - 1] || [u] || us[pos + 1:] ELSE us END, CASE WHEN pos > len(ks) THEN k ELSE ks[pos] END
  FROM (SELECT o.n, o.k, o.u, ks, us, coalesce(CASE WHEN o.u IS NOT NULL THEN nullif(list_position(us, o.u), 0) END, nullif(list_position(ks, o.k), 0), len(ks) + 1) AS pos FROM steps s JOIN ordered o ON o.n = s.n + 1)
), owned AS (SELECT unnest(ks) AS entity_key, unnest(us) AS outside_id FROM (SELECT ks, us FROM steps ORDER BY n DESC LIMIT 1)),
landed AS (SELECT o.*, s.entity_key FROM ordered o JOIN steps s USING (n)),
entities AS (
  SELECT entity_key, arg_min(trim(name), n) AS canonical, arg_min(CASE WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey END, n) FILTER (p_partkey % 5 = 0) AS wikidata_qid, CAST(arg_min(p_size + 1850, n) FILTER (p_size % 4 = 0) AS INTEGER) AS birth_year,
    CAST(arg_min(p_size + 1900, n) FILTER (p_size % 8 = 0) AS INTEGER) AS death_year, max(CASE WHEN p_partkey % 7 = 0 THEN 'American' END) AS nationality, CAST(max(CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS papers,
    array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS records FROM landed GROUP BY 1
), holdings AS (SELECT entity_key AS artist_id, source AS institution, CAST(sum(p_size) AS BIGINT) AS works FROM landed WHERE rank <> 5 GROUP BY ALL),
variants AS (
  SELECT variant_key, artist_id, arg_min(source, n) AS source FROM (SELECT k AS variant_key, entity_key AS artist_id, source, n FROM landed UNION SELECT array_to_string(list_sort(string_split(k, ' ')), ' '), entity_key, source, n FROM landed) GROUP BY ALL
)"""
_MAJOR = "[" + ",".join(_quoted(m) for m in a.MAJOR) + "]"
_NAMES = "MAP {" + ",".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in a.MAJOR.items()) + "}"
PROFILES = f"""{RECORDS},
held AS (SELECT artist_id, list(institution ORDER BY works DESC, institution) AS museums, CAST(sum(works) AS BIGINT) AS works_held FROM holdings GROUP BY 1),
awarded AS (SELECT DISTINCT entity_key AS artist_id, 1 AS awards FROM landed WHERE p_partkey % 53 = 0),
sold AS (SELECT entity_key AS artist_id, count(*) AS historic_sales FROM landed JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1),
wide AS (
  SELECT e.entity_key AS artist_id, canonical, outside_id, wikidata_qid, birth_year, death_year, nationality, papers, sources, records, coalesce(museums, []) AS museums, coalesce(works_held, 0) AS works_held, coalesce(awards, 0) AS awards, coalesce(historic_sales, 0) AS historic_sales,
    CAST(len(list_filter(coalesce(museums, []), lambda m: list_contains({_MAJOR}, m))) AS BIGINT) AS museum_count
  FROM entities e JOIN owned USING (entity_key) LEFT JOIN held ON held.artist_id = e.entity_key LEFT JOIN awarded ON awarded.artist_id = e.entity_key LEFT JOIN sold ON sold.artist_id = e.entity_key
), profiles AS (
  SELECT *, CASE WHEN papers > 0 OR museum_count >= 3 OR awards > 0 THEN 'strong' WHEN museum_count >= 1 THEN 'listed' END AS standing,
    concat_ws('; ', CASE WHEN museum_count > 0 THEN 'in ' || array_to_string(list_transform(list_filter(museums, lambda m: list_contains({_MAJOR}, m))[1:4], lambda m: ({_NAMES})[m]), ', ') END, CASE WHEN papers > 0 THEN 'papers at Archives of American Art' END,
      CASE WHEN awards > 0 THEN 'Guggenheim Fellow' END, CASE WHEN historic_sales > 0 THEN historic_sales || ' historic auction records (Getty PI)' END) || CASE WHEN birth_year IS NOT NULL THEN ' (' || birth_year || '-' || coalesce(death_year::VARCHAR, '') || ')' ELSE '' END AS said FROM wide
)"""


def build(spark, d):
    return a.authority_build(records(spark, d))


def profiles(spark, d, built):
    """Historic sales: the sold line items of an artist's records."""
    sold = read(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("place")).agg(F.count("*").alias("records"))
    history = built.landed.select("artist_id", F.col("seq.place").alias("place")).join(sold, "place").select("artist_id", "records")
    return a.described(a.authority_profiles(built, history))


@query(f"WITH RECURSIVE {RECORDS} SELECT entity_key, canonical, outside_id, wikidata_qid, birth_year, death_year, nationality, papers, sources, records FROM entities JOIN owned USING (entity_key)")
def merge_entities(spark, d):
    return build(spark, d).artists.withColumnRenamed("artist_id", "entity_key")


@query(f"WITH RECURSIVE {RECORDS} SELECT variant_key, artist_id, source FROM variants")
def authority_variants(spark, d):
    return build(spark, d).variants


@query(f"WITH RECURSIVE {PROFILES} SELECT artist_id, canonical, outside_id, birth_year, museums, museum_count, works_held, historic_sales, standing, CASE WHEN trim(said) = '' THEN 'documented artist' ELSE trim(said) END AS description FROM profiles")
def authority_build(spark, d):
    return profiles(spark, d, build(spark, d)).select("artist_id", "canonical", "outside_id", "birth_year", "museums", "museum_count", "works_held", "historic_sales", "standing", "description")


@query(
    f"""WITH RECURSIVE {PROFILES},
asked AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) || ', Mr ' || split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6) AS name, lower(split_part(p_name, ' ', 2) || ' mr ' || split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6)) AS key FROM part WHERE p_size % 2 = 0
  UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6), lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || chr(65 + p_size % 6)) FROM part),
forms AS (SELECT name, 0 AS pos, key AS variant_key FROM asked UNION SELECT name, 2, array_to_string(list_sort(string_split(key, ' ')), ' ') FROM asked),
hits AS (SELECT name, artist_id, min(pos) AS pos FROM forms JOIN (SELECT DISTINCT variant_key, artist_id FROM variants) USING (variant_key) GROUP BY ALL),
first AS (SELECT * FROM hits QUALIFY pos = min(pos) OVER (PARTITION BY name)),
ranked AS (
  SELECT name, f.artist_id, count(*) OVER (PARTITION BY name) > 1 AS ambiguous, row_number() OVER (PARTITION BY name ORDER BY len(museums) DESC, birth_year IS NULL, f.artist_id) AS r, canonical, standing, CASE WHEN trim(said) = '' THEN 'documented artist' ELSE trim(said) END AS description
  FROM first f JOIN profiles p USING (artist_id)
)
SELECT name, artist_id, ambiguous, canonical, standing, description FROM ranked WHERE r = 1"""
)
def lookup_standing(spark, d):
    part = read(spark, d, "part")
    first, last, initial = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.char(65 + F.col("p_size") % 6)
    names = part.filter("p_size % 2 = 0").select(F.concat(F.lower(last), F.lit(", Mr "), first, F.lit(" "), initial).alias("name")).unionByName(part.select(F.concat_ws(" ", last, first, initial).alias("name")))
    built = build(spark, d)
    return a.lookup_standing(names, built, profiles(spark, d, built))
