"""What must not grow faster than the input: columns that are shuffled, texts that are read, rows of one task."""

from salesignal.operators import authority as a
from salesignal.operators import feeds as f
from salesignal.operators import market as m
from salesignal.operators import scan as s
from salesignal.operators.select import mills
from salesignal.plans import relational, scan
from salesignal.plans.feeds import harvest_results, token_overlap

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_order_values_without_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, i) for i in range(5)] + [("a", 2.0, 4.0, 9)], "g string, v double, w double, tie int")
    out = m.weighted_quantiles(df, ["g"], "v", "w", ["tie"], {"mid": 0.5, "high": 0.6})
    assert [tuple(r) for r in out.collect()] == [("a", 1.0, 2.0)]
    assert "Aggregate [g" in plan(out).split("Window")[-1]


def test_overlap_is_dealt_out(spark):
    assert token_overlap(spark, D).rdd.getNumPartitions() > 1


def test_bridge_has_parts_by_input(spark, monkeypatch):
    monkeypatch.setattr(relational, "BRIDGED", 100)
    assert relational.join_bridge(spark, D).rdd.getNumPartitions() >= spark.read.parquet(f"{D}/lineitem.parquet").count() // 100


def test_mills_read_equal_titles_once(spark):
    rows = spark.createDataFrame([(1, "Pablo Picasso original signed drawing")] * 8 + [(2, None)], "auction int, title string")
    out = mills(rows)
    assert {r["auction"]: (r["masters"], r["claims"], r["mill"]) for r in out.collect()} == {1: (["picasso"], 8, True), 2: ([], 0, False)}
    assert plan(out).count("Aggregate [") == 2


def test_spellings_are_read_once(spark, monkeypatch):
    kept, checkpointed = [], a.checkpointed
    monkeypatch.setattr(a, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    fields = "seq int, source string, raw_name string, outside_id string, wikidata_qid string, birth_year int, death_year int, nationality string, papers int, institution string, works long, distinction string"
    records = spark.createDataFrame([(i, "met", "Doe, Jane" if i % 2 else None, *[None] * 9) for i in range(8)], fields)
    assert [(r["artist_id"], r["records"]) for r in a.authority_build(records).artists.collect()] == [("jane doe", 4)]
    assert kept[0].count() == 2


def test_lots_of_a_scan_are_kept_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scan.s, "harvest", lambda sales, lots, *rest: seen.append(lots))
    scan.harvest_sales(spark, D)
    assert "Join" not in plan(seen[0])


def test_harvested_lots_are_read_once(spark):
    """Claims are resolved once a part: lots are not read again for them, and they do not meet by claim."""
    out = plan(harvest_results(spark, D))
    assert out.count("Relation [l_orderkey") == 1 and not any("Join" in line and "claim" in line and "l_" in line for line in out.splitlines())


def test_harvest_by_item_and_by_claim(spark):
    rows = [(1, 1, "a b", 7, 5.0), (1, 1, "a b", 7, 5.0), (2, 1, "a b c", 8, None), (3, 9, "a b", 7, 5.0), (4, 1, "x y", 6, 5.0), (5, 1, None, 5, 5.0)]
    lots = spark.createDataFrame(rows, "lot int, sale int, claim string, item int, realized double").selectExpr("*", "1.0D bid", "1 bids")
    done, recorded = spark.createDataFrame([(9,)], "sale int"), lots.select("lot").limit(0)
    store = spark.createDataFrame([("a b",)], "key string")
    names = lots.select("item", "claim")
    by_claim, by_item = f.harvested_prices(lots.drop("item"), done, [store], recorded), f.harvested_prices(lots.drop("claim"), done, [store], recorded, names)
    assert sorted(map(tuple, by_claim.collect())) == sorted(map(tuple, by_item.collect())) == [(1, "a b", "sold", 5.0), (2, "a b", "final_bid", 1.0)]


def test_titles_of_a_harvest_are_read_once(spark, monkeypatch):
    """Claims are read from different titles, not from lots, and are kept, so that no later step reads them again."""
    kept, checkpointed = [], s.checkpointed
    monkeypatch.setattr(s, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    built = a.authority_build(spark.createDataFrame([(1, "met", "Lee, Ann", None, 0, None, None, "met", 1, None)], "seq int, source string, raw_name string, outside_id string, papers int, birth_year int, death_year int, institution string, works long, distinction string"))
    market = spark.createDataFrame([("bob ray", "Bob Ray", "strong", "research", 90000.0)], "artist_key string, artist string, tier string, source string, high double")
    rows = [(i, 1, ("Ann Lee sketch", "Bob Ray sketch", "pallet of tools", None)[i % 4], 300.0, 1.0, 1) for i in range(40)]
    lots = spark.createDataFrame(rows, "lot int, sale int, title string, realized double, bid double, bids int")
    sales = spark.createDataFrame([(1, "Good", False)], "sale int, house string, failed boolean")
    args = (sales, lots, sales.select("sale").limit(0), lots.filter("lot = 1").select("lot"), market, built, a.authority_profiles(built))
    out = [s.harvest(*args)]
    assert kept[0].columns == ["title", "claim"] and kept[0].count() == 4
    monkeypatch.setattr(s, "TOLD", 0)  # the same where lots and titles meet by shuffle
    out.append(s.harvest(*args))
    for df in out:
        assert "regexp_extract" not in plan(df)
        assert sorted((r["lot"], r["artist"], r["suspect"]) for r in df.collect()) == [(i, "Bob Ray", True) if i % 4 else (i, "Ann Lee", False) for i in range(40) if i % 4 < 2 and i != 1]
