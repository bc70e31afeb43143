"""Operators against small brute forces."""

import random

from pyspark.sql import functions as F

from salesignal.operators import authority as au
from salesignal.operators import incremental as inc
from salesignal.operators import market as m
from salesignal.operators import match as ma
from salesignal.operators import resolve as r
from salesignal.operators import select as s
from salesignal.operators import upsert as u


def test_weighted_quantiles(spark):
    rows = [(1, float(v), w, i) for i, (v, w) in enumerate([(10, 1.0), (20, 1.0), (30, 1.0), (40, 1.0), (99, 0.0)])] + [(2, 5.0, 9.0, 0), (2, 1.0, 0.5, 1)]
    df = spark.createDataFrame(rows, "g int, v double, w double, i int")
    got = {x["g"]: (x["lo"], x["mid"]) for x in m.weighted_quantiles(df, ["g"], "v", "w", ["i"], {"lo": 0.25, "mid": 0.5}).collect()}
    assert got == {1: (10.0, 20.0), 2: (5.0, 5.0)}


def test_trend(spark):
    def growth(points):
        return spark.createDataFrame(points, "y int, p double").agg(m.trend(F.col("y"), F.col("p")).alias("t")).first()["t"]

    assert growth([(2000 + i, 100.0 * 1.1**i) for i in range(5)]) is None
    assert abs(growth([(2000 + i, 100.0 * 1.1**i) for i in range(6)]) - 0.1) < 1e-9
    assert growth([(2000, 100.0 + i) for i in range(8)]) is None
    assert growth([(2000 + i, 100.0 * 1.5**i) for i in range(6)]) == 0.3


def test_comp_estimate_without_sales(spark):
    subjects = spark.createDataFrame([("s1", "a", "painting", 100.0, 1950, ["sea"]), ("s2", "b", "painting", None, None, [])], "subject_id string, artist_key string, medium_category string, area_sqin double, work_year int, series_tokens array<string>")
    comps = spark.createDataFrame([("c1", "a", "painting", "sea", 100.0, 1950, 100.0, "sold", 2000, "mid"), ("c2", "b", "painting", "x", 100.0, 1950, 100.0, "unsold", 2000, "mid")], "comp_id string, artist_key string, medium_category string, title string, area_sqin double, work_year int, price_usd double, outcome string, sale_year int, venue string")
    got = {x["subject_id"]: x for x in m.comp_estimate(subjects, comps, 2000).collect()}
    assert (got["s1"]["mid"], got["s1"]["n"], got["s1"]["confidence"], got["s1"]["n_effective"]) == (100.0, 1, "low", 1.7)
    assert (got["s2"]["mid"], got["s2"]["n"], got["s2"]["confidence"]) == (None, 0, "none")


def test_lookup(spark):
    names = spark.createDataFrame([("Walker, William Aiken",), ("Wm. Aiken Walker",), ("Walker",), ("Nobody Known",), ("Ann Lee",)], "name string")
    variants = spark.createDataFrame([("william aiken walker", 1), ("ann lee", 2), ("ann lee", 3), ("aiken walker william", 1)], "variant_key string, artist_id int")
    artists = spark.createDataFrame([(1, 2, 1838), (2, 1, None), (3, 4, None)], "artist_id int, institutions int, birth_year int")
    got = {x["name"]: (x["artist_id"], x["ambiguous"]) for x in r.authority_lookup(names, variants, artists).collect()}
    assert got == {"Walker, William Aiken": (1, False), "Wm. Aiken Walker": (1, False), "Ann Lee": (3, True)}


def test_cascade_and_merge(spark):
    claims = spark.createDataFrame([("ann lee big sea",), ("bo ray",)], "claim string")
    stores = [spark.createDataFrame([(x,)], "key string") for x in ("ann lee", "bo ray")]
    assert sorted(map(tuple, r.resolve_cascade(claims, stores).collect())) == [("ann lee big sea", "ann lee", 0), ("bo ray", "bo ray", 1)]
    rows = spark.createDataFrame([(1, "a", "Ann Lee", "ann lee", "u1", None), (2, "b", "A. Lee", "a lee", "u1", 1900), (3, "b", "Ann Lee", "ann lee", None, 1901), (4, "c", "Bo Ray", "bo ray", None, None)], "seq int, source string, name string, norm_key string, outside_id string, birth_year int")
    got = {x["entity_key"]: (x["canonical"], x["sources"], x["birth_year"], x["records"]) for x in au.merged_entities(au.with_entity(rows)).collect()}
    assert got == {"ann lee": ("Ann Lee", "a,b", 1900, 3), "bo ray": ("Bo Ray", "c", None, 1)}


def test_hamming_and_greedy(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) for b in base for _ in range(6)]
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    rows = [(i % 2, i, c, rng.randrange(5)) for i, c in enumerate(signed)]
    df = spark.createDataFrame(rows, "`group` int, id int, hash bigint, size int")
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {(g, i, j, near(x, y)) for g, i, x, _ in rows for h, j, y, _ in rows if g == h and i < j and near(x, y) <= 8}
    assert {tuple(x) for x in ma.hamming_pairs(df, 8).collect()} == want
    clusters: dict = {}
    of = {}
    for g, i, x, _ in sorted(rows, key=lambda t: (-t[3], t[1])):
        own = clusters.setdefault(g, [])
        hit = next((c for c in own if any(near(x, y) <= 8 for y in c["codes"])), None)
        if hit is None:
            own.append(hit := {"id": i, "codes": []})
        hit["codes"].append(x)
        of[i] = hit["id"]
    assert {x["id"]: x["cluster"] for x in ma.greedy_clusters(df, 8).collect()} == of


def test_exclusives(spark):
    a = spark.createDataFrame([("abell auction",), ("gold",), ("",), ("unmatched house",)], "a_key string")
    b = spark.createDataFrame([("abell",), ("goldberg auctions",)], "b_key string")
    assert sorted(x[0] for x in ma.exclusive_houses(a, b).collect()) == ["gold", "unmatched house"]
    assert spark.createDataFrame([("000000000000000f",), ("ffffffffffffffff",)], "h string").select(ma.hex_hash(F.col("h"))).collect() == [(15,), (-1,)]


def test_budget_and_mills(spark):
    rows = spark.createDataFrame([("b", i, 1.0) for i in range(40)], "budget string, i int, cost double")
    got = s.admit(rows, "budget", [F.col("i")], "cost", F.lit(5.0))
    assert (got.filter("attempted").count(), got.filter("completed").count()) == (5, 4)
    lots = [("m", t, "") for t in ("Picasso oil", "Monet oil", "Dali oil", "Warhol print")] + [("n", "Picasso oil", ""), ("n", "Monet oil", "")] * 2 + [("o", "Picasso oil", "")] * 8
    got = {x["auction"]: (x["masters"], x["claims"], x["mill"]) for x in s.mills(spark.createDataFrame(lots, "auction string, title string, detail string")).collect()}
    assert got == {"m": (["dali", "monet", "picasso"], 3, True), "n": (["monet", "picasso"], 4, False), "o": (["picasso"], 8, True)}


def test_taste(spark):
    rows = [("A", "save", None)] * 10 + [("b", "dismiss", None)] * 3 + [("c", "dismiss", "print/repro")] * 9 + [("d", "dismiss", None)] * 12
    got = {x["category"]: x["boost"] for x in s.taste_prior(spark.createDataFrame(rows, "category string, kind string, reason string")).collect()}
    assert set(got) == {"a", "d"} and got["a"] > 0.5 and got["d"] < -0.5


def test_ranked_sales(spark):
    sales = spark.createDataFrame([(1, "x", 500, 1), (2, "x", 450, 1), (3, "x", 300, 1), (4, "x", 999, 3), (5, "y", 900, 1), (6, "x", 3, 1), (7, "x", 300, 1), (8, "x", 800, 1)], "id int, place string, pictures int, type int")
    got = s.ranked_sales(sales, spark.createDataFrame([(8,)], "id int"), spark.createDataFrame([("x",)], "place string"), 10, [1]).orderBy("rank")
    assert [(x["id"], x["rank"]) for x in got.collect()] == [(2, 1), (1, 2), (3, 3), (7, 4), (4, 5)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 7)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "b", 3), (3, "c", 9), (3, "d", 1)], "k int, v string, n int")
    one = new.filter("v <> 'd'")
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "n").collect()))
    assert rows(u.insert_ignore(old, new, ["k"], [F.col("v")])) == [(1, "a", 5), (2, None, 7), (3, "c", 9)]
    assert rows(u.insert_replace(old, new, ["k"], [F.desc("v")])) == [(1, "a", 5), (2, "b", 3), (3, "d", 1)]
    assert rows(u.upsert_columns(old, one, ["k"], ["n"])) == [(1, "a", 5), (2, "b", 3), (3, "c", 9)]
    assert rows(u.upsert_unless(old, one, ["k"], F.col("o.n") > 6)) == [(1, "a", 5), (2, None, 7), (3, "c", 9)]
    assert rows(u.upsert_fill(old, one, ["k"], greatest=("n",))) == [(1, "a", 5), (2, "b", 7), (3, "c", 9)]
    assert rows(u.delete_keys(old, one, ["k"])) == [(1, "a", 5)]


def test_pending_steps():
    assert inc.pending_step(None, 0, 20, 0.0) == (None, 20, True)
    assert inc.pending_step(None, 0, 3, 0.0) == (0.0, 3, False)
    assert inc.pending_step(0.0, 3, 9, 5.0) == (0.0, 9, False)
    assert inc.pending_step(0.0, 9, 12, 5.0) == (0.0, 12, False)
    assert inc.pending_step(0.0, 9, 14, 5.0) == (None, 14, True)
    assert inc.pending_step(0.0, 3, 30, 15 * 86400.0) == (None, 3, False)


def test_news_and_quota(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (2, 1, None), (2, 2, None)], "k int, t int, v string")
    assert [x["notice"] for x in inc.news(rows, "k", "t", "v", []).orderBy("k", "t").collect()] == ["first", None, "changed", "first", None]
