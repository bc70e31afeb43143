"""The deep scan and the harvest on constructed sales."""

import pytest

from salesignal.operators import authority as a
from salesignal.operators import scan as s


@pytest.fixture(scope="module")
def stores(spark):
    schema = "seq bigint, source string, raw_name string, outside_id string, papers int, birth_year int, death_year int, institution string, works bigint, distinction string"
    rows = [(1, "met", "Walker, William Aiken, 1838-1921", "1", 1, 1838, 1921, "met", 3, None), (2, "ulan", "Wm. Aiken Walker", "1", 0, None, None, None, None, None), (3, "moma", "Bob Ray", None, 0, None, None, "moma", 1, None)]
    built = a.authority_build(spark.createDataFrame(rows, schema))
    market = spark.createDataFrame([("william aiken walker", "William Aiken Walker", "strong", "research", 40000.0), ("ann lee", "Ann Lee", "listed", "research", 900.0), ("glass koala", "Glass Koala", "none", s.NO_NAME_SOURCE, None)], "artist_key string, artist string, tier string, source string, high double")
    return built, market, a.authority_profiles(built).cache()


def test_deep_scan(spark, stores):
    built, market, profiles = stores
    sales = [(1, "Good", 1, False), (2, "Mill", 2, False), (3, "Mill", 3, False), (4, "Mill", 1, False), (5, "Down", 5, True), (6, "Old", 6, False), (7, "Barred", 7, False), (8, "My Favourite Mill", 8, False)]
    auctions = spark.createDataFrame(sales, "sale int, house string, pos int, failed boolean")
    famous = ["Picasso oil", "Original Warhol canvas", "Renoir pastel"]
    rows = [(11, 1, "Walker, William Aiken painting", 50), (12, 1, "Ann Lee print, signed", None), (13, 1, "Vase by Ann Lee", 5000), (14, 1, "Large Glass Koala", None), (15, 1, "Bob Ray, sketch", None), (16, 1, "William Aiken Walker view", 39000), (17, 1, "Ann Lee known", None), (18, 1, "after Bob Ray", None), (19, 1, None, None)]
    rows += [(100 * sale + i, sale, t, None) for sale in (2, 3, 8) for i, t in enumerate([*famous, "Ann Lee view"])] + [(401, 4, "Ann Lee early", 10), (501, 5, "Ann Lee gone", 1), (601, 6, "Ann Lee old", 1), (701, 7, "Ann Lee barred", 1)]
    lots = spark.createDataFrame(rows, "lot int, sale int, title string, bid int")
    scan = s.deep_scan(auctions, lots, spark.createDataFrame([(6,)], "sale int"), spark.createDataFrame([("Barred",)], "house string"), spark.createDataFrame([(17,)], "lot int"), market.select("artist_key", "tier", "high"), built, profiles, ("favourite",))
    # the failed sale is not marked, nor the one of the mill's house that comes behind the mill
    assert sorted(r[0] for r in scan.scanned.collect()) == [1, 2, 4, 8]
    assert [(r["house"], r["sale"], r["masters"], r["claims"]) for r in scan.blocked.collect()] == [("Mill", 2, ["picasso", "renoir", "warhol"], 3)]
    flags = {r["lot"]: (r["artist_key"], r["artist"], r["reason"], r["evidence"]) for r in scan.flags.collect()}
    walker = "in the Met; papers at Archives of American Art (1838-1921)"
    assert flags == {11: ("william aiken walker", "William Aiken Walker", "market", walker), 401: ("ann lee", "Ann Lee", "market", ""), 803: ("ann lee", "Ann Lee", "market", "")}
    unknown = {(r["name"], r["route"]) for r in scan.unknown.collect()}
    assert ("Bob Ray", "research") in unknown and ("Glass Koala", "classify") not in unknown and not any(n == "Ann Lee" for n, _ in unknown)


def test_harvest(spark, stores):
    built, market, profiles = stores
    auctions = spark.createDataFrame([(1, "Good", False), (2, "Good", True), (3, "Blocked House", False), (4, "Good", False)], "sale int, house string, failed boolean")
    rows = [
        (1, 1, '"Sunset" by Ann Lee', 300.0, 10.0, 2), (2, 1, "Walker, William Aiken painting", None, 90.0, 3), (3, 1, "Glass Koala Bear", 5.0, None, 0), (4, 1, "Bob Ray Nude Photograph", None, 20.0, 0), (5, 1, "Unidentified Artist Portrait", 9.0, None, None),
        (6, 1, "Ann Lee on record", 7.0, None, 0), (7, 2, "Ann Lee failed", 7.0, None, 0), (8, 3, "Ann Lee barred", 7.0, None, 0), (9, 4, "Ann Lee harvested", 7.0, None, 0), (10, 1, None, 1.0, None, 0),
    ]
    lots = spark.createDataFrame(rows, "lot int, sale int, title string, realized double, bid double, bids int")
    got = s.harvest(auctions, lots, spark.createDataFrame([(4,)], "sale int"), spark.createDataFrame([(6,)], "lot int"), market, built, profiles, ("blocked",))
    assert {r["lot"]: (r["artist"], r["outcome"], r["price"], r["suspect"]) for r in got.collect()} == {1: ("Ann Lee", "sold", 300.0, False), 2: ("William Aiken Walker", "final_bid", 90.0, True), 4: ("Bob Ray", "unsold", None, False)}
