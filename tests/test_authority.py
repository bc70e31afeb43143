"""The merge of catalogue records against a plain loop over rows, and what is told of an artist."""

import random

import pytest
from pyspark.sql import functions as F

from salesignal.operators import authority as a

SCHEMA = "seq bigint, source string, name string, norm_key string, outside_id string, birth_year int"


def one_after_another(rows):
    """Entities as dicts and, for each row, the number of its entity, going through the rows in order: by id, else by key, else new."""
    entities, landed = [], {}
    for seq, source, name, key, outside, born in sorted(rows):
        if key is None or len(key) < 4 or " " not in key:
            continue
        outside = (outside or "").strip() or None
        own = next((n for n, e in enumerate(entities) if outside and e["outside_id"] == outside), None)
        if own is None:
            own = next((n for n, e in enumerate(entities) if e["key"] == key), None)
        if own is None:
            entities.append({"key": key, "name": name.strip(), "outside_id": None, "born": None, "sources": set(), "records": 0})
            own = len(entities) - 1
        e = entities[own]
        e["outside_id"] = e["outside_id"] or outside
        e["born"] = born if e["born"] is None else e["born"]
        e["sources"].add(source)
        e["records"] += 1
        landed[seq] = e["key"]
    return entities, landed


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    landed = a.with_entity(frame)
    entities, want = one_after_another(rows)
    assert {r["seq"]: r["entity_key"] for r in landed.collect()} == want
    got = {r["entity_key"]: (r["canonical"], r["outside_id"], r["birth_year"], r["sources"], r["records"]) for r in a.merged_entities(landed).collect()}
    assert got == {e["key"]: (e["name"], e["outside_id"], e["born"], ",".join(sorted(e["sources"])), e["records"]) for e in entities}


def test_an_id_that_conflicts_is_dropped_and_may_come_later_by_another_key(spark):
    check(spark, [(1, "x", "Ann One", "ann one", "1", None), (2, "x", "Ann One", "ann one", "2", 1900), (3, "y", "A. One", "a one", "2", 1901), (4, "y", "A. One", "a one", None, None), (5, "z", "One", "one", "2", 1), (6, "z", "Al", "a l", None, 2)])


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_merge_is_that_of_a_loop_in_any_partitioning(spark, partitions):
    rng = random.Random(partitions)
    for keys, ids in ((4, 4), (12, 30), (40, 8)):
        rows = [(i, rng.choice("pqr"), f"Name {i} ", f"name {rng.randrange(keys):02d}", rng.choice([None, "", " ", *[str(x) for x in range(ids)]]), rng.choice([None, 1800 + i])) for i in range(150)]
        check(spark, rows, partitions)


def test_chain_of_ids_and_keys_and_a_key_with_very_many_ids(spark):
    chain = [(i, "s", f"N {i}", f"name {i // 2:03d}", str((i + 1) // 2), None) for i in range(24)]
    rng = random.Random(2)
    hot = [(100 + i, "s", "John Smith", "john smith", str(1000 + i), None) for i in range(400)] + [(600 + i, "t", "J Smith", f"j smith {rng.choice('abc')}", str(1000 + rng.randrange(400)), i) for i in range(100)]
    check(spark, chain + hot)
    check(spark, [(-i, s, n, k, u, b) for i, s, n, k, u, b in chain])
    check(spark, [])


def records(spark, rows):
    schema = "seq bigint, source string, raw_name string, outside_id string, wikidata_qid string, birth_year int, death_year int, nationality string, papers int, institution string, works bigint, distinction string"
    return spark.createDataFrame(rows, schema)


def test_build_and_lookup(spark):
    built = a.authority_build(records(spark, [
        (1, "moma", "Hopper, Edward, 1882-1967", None, None, 1882, None, None, 0, "moma", None, None),
        (2, "whitney", "Edward Hopper", "500", None, 1999, 1967, "American", 0, "whitney", 40, None),
        (3, "nga", "HOPPER, EDWARD (American, 1882-1967)", None, "Q1", None, None, None, 0, "nga", 5, None),
        (4, "nga", "Edward Hopper", "500", None, None, None, None, 0, "nga", 2, None),
        (5, "ulan", "Unidentified artist", None, None, None, None, None, 0, None, None, None),
        (6, "ulan", "Walker, William Aiken", None, None, 1838, 1921, None, 1, None, None, None),
        (7, "awards", "Ed Hopper", "500", None, None, None, None, None, None, None, "Guggenheim Fellow"),
    ]))
    crowd = spark.createDataFrame([("edward hopper", "Tate")], "artist_id string, museum string")
    history = spark.createDataFrame([("edward hopper", 7), ("edward hopper", 5)], "artist_id string, records bigint")
    profiles = a.authority_profiles(built, history, crowd).cache()
    hopper = profiles.filter("artist_id = 'edward hopper'").first()
    assert (hopper["museums"], hopper["museum_count"], hopper["works_held"], hopper["standing"], hopper["birth_year"], hopper["wikidata_qid"], hopper["sources"]) == (["whitney", "nga", "moma"], 3, 48, "strong", 1882, "Q1", "awards,moma,nga,whitney")
    names = spark.createDataFrame([("Walker William Aiken",), ("Wm. Aiken Walker",), ("ed hopper",), ("Walker",), ("Someone Else",)], "name string")
    got = {r["name"]: (r["canonical"], r["description"]) for r in a.lookup_standing(names, built, profiles).collect()}
    said = "in the Whitney, National Gallery, MoMA; Guggenheim Fellow; collections per Wikidata: Tate; 12 historic auction records (Getty PI) (1882-1967)"
    assert got == {"Walker William Aiken": ("William Aiken Walker", "papers at Archives of American Art (1838-1921)"), "Wm. Aiken Walker": ("William Aiken Walker", "papers at Archives of American Art (1838-1921)"), "ed hopper": ("Edward Hopper", said)}
    lots = spark.createDataFrame([(1, "ed hopper"), (2, "Nobody Known")], "lot bigint, artist string")
    found = {r["lot"]: r["standing"] for r in a.with_evidence(lots, a.lookup_standing(names, built, profiles)).collect()}
    assert found == {1: "strong", 2: None}
    assert a.new_records(records(spark, []), spark.createDataFrame([("moma",)], "source string")).count() == 0


def test_standing_and_description(spark):
    rows = [(0, 0, 0, []), (0, 1, 0, []), (0, 3, 0, []), (1, 0, 0, []), (0, 0, 1, ["x"])]
    frame = spark.createDataFrame(rows, "papers int, museum_count bigint, n int, awards array<string>")
    assert [r[0] for r in frame.select(a.standing(F.col("papers"), F.col("museum_count"), F.size("awards"))).collect()] == [None, "listed", "strong", "strong", "strong"]
    none = F.expr("cast(array() as array<string>)")
    year = F.lit(None).cast("int")
    said = frame.limit(1).select(a.describe(none, F.lit(0), none, none, F.lit(0), year, year), a.describe(F.array(F.lit("moma"), F.lit("else")), F.lit(0), F.array(F.lit("A Prize")), none, F.lit(12), F.lit(1940), year), a.describe(none, F.lit(0), none, none, F.lit(0), F.lit(1838), F.lit(1909)))
    assert list(said.first()) == ["documented artist", "in MoMA; A Prize; 12 historic auction records (Getty PI) (1940-)", "(1838-1909)"]
