"""Boundary rows of the column rules."""

import pytest
from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions import keys as k
from salesignal.functions import money as m
from salesignal.functions import names as n
from salesignal.functions.scorers import indexed_verdicts, scored


def ask(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_keys(spark):
    assert ask(spark, k.artist_key, ["O'Keeffe, G.", " Paul Cézanne ", None, ""]) == ["o keeffe g", "paul c zanne", "", ""]
    assert ask(spark, k.intel_key, ["O'Keeffe"]) == ["okeeffe"]
    assert ask(spark, k.charity_key, ["John Smith Jr.", "Ann Lee III"]) == ["john smith", "ann lee"]
    assert ask(spark, k.slug, ["John Smith Jr. 2"]) == ["john-smith-2"]
    assert ask(spark, lambda x: k.sorted_key(k.artist_key(x)), ["Walker, William Aiken"]) == ["aiken walker william"]
    assert ask(spark, lambda x: k.expanded_key(k.artist_key(x)), ["Wm. Walker"]) == ["william walker"]
    assert ask(spark, k.house_key, ["Abell Auction Co., LLC", "Company Inc", None]) == ["abell auction", "", ""]
    assert ask(spark, k.lookup_keys, ["Wm Walker", "Walker"]) == [["wm walker", "william walker", "walker wm", "walker william"], []]


@pytest.mark.parametrize("a, b, same", [("abell", "abell auction", True), ("gold", "goldberg auctions", False), ("abell", "abell", True), ("abc", "abc def", False), ("", "x", False)])
def test_houses_match(spark, a, b, same):
    assert spark.range(1).select(k.houses_match(F.lit(a), F.lit(b))).first()[0] is same


def test_clean_person_name(spark):
    given = ["Walker, William Aiken, 1838-1921 (painter)", "Floyd Newsum, American", "King, Martin, II", "Museum of Art", "Rembrandt", "", None, "Ann Lee 3"]
    assert ask(spark, n.clean_person_name, given) == ["William Aiken Walker", "Floyd Newsum", "Martin King II", None, None, None, None, None]


def test_claims(spark):
    assert ask(spark, n.listing_artist_claim, ["Roberts Clyde- Watercolor", "Framed Wall Art", "chair", None]) == ["Roberts Clyde", None, None, None]
    assert ask(spark, n.claim_from_title, ['"Sunset" by Ann Lee', "Clyde Roberts oil"]) == ["Ann Lee", "Clyde Roberts"]


def test_people_and_places(spark):
    given = ["Pfendler Estate Auction", "Estate of the Late Jan Duggins", "5 STAR ESTATE", "Luxury Estate Sale", "The Rivera Collection", None]
    assert ask(spark, n.named_estate_person, given) == ["Pfendler", "Jan Duggins", None, None, "Rivera", None]
    assert spark.range(1).select(n.location_for(F.lit(None).cast("string"), F.lit("Estate in Greenville NC"))).first()[0] == "Greenville, NC"
    assert spark.range(1).select(n.extract_names(F.lit("Collection of Ann Lee"), F.lit("<b>the Rivera collection</b>"))).first()[0] == ["Ann Lee", "Rivera"]
    assert ask(spark, n.clean_signature, ["signed J. SMITH 1923 lower right", "xx", None]) == ["J. Smith", "", ""]


def test_money(spark):
    assert ask(spark, m.parse_price, ["1,234.56 USD", "text", None, "0", "$180"]) == [1234.56, None, None, None, 180.0]
    got = ask(spark, m.parse_money, ["£180,000", "€45.000", "1.234,56", "HK$1,200,000", "none", None])
    assert [(r["native"], r["currency"]) for r in got] == [(180000.0, "GBP"), (45000.0, "EUR"), (1234.56, "USD"), (1200000.0, "HKD"), (None, None), (None, None)]
    assert got[0]["usd"] == 228600.0
    assert ask(spark, m.mixed_number, ["24", "24.5", "24 1/2", "24½", "x"]) == [24.0, 24.5, 24.5, 24.5, None]
    assert ask(spark, m.sane_usd, ["12", "2500", "x", None]) == [12000.0, 2500.0, 0.0, 0.0]


def test_dimensions(spark):
    got = ask(spark, m.parse_dimensions, ['24 x 36 in', "60 x 90 cm", "24 by 36", "700 x 20 in", None, '24 1/2 x 30"'])
    assert [g and (g["width"], g["height"]) for g in got] == [(24.0, 36.0), (23.6, 35.4), None, None, None, (24.5, 30.0)]


def test_years(spark):
    assert ask(spark, lambda x: m.parse_work_year(x), ["sold 1999 (c. 1950)", "in 1890", "18990", "1840", None]) == [1950, 1890, None, None, None]
    assert ask(spark, m.year_of, ["b. 1838", "12", "-50", None]) == [1838, None, None, None]


def test_classes(spark):
    assert ask(spark, c.work_class, ["litho 12/200", "signed LE", "Le Pho oil", "chair", None]) == ["edition", "edition", "unique", "unknown", "unknown"]
    assert ask(spark, lambda x: c.work_class(x, marks=False), ["signed LE"]) == ["unknown"]
    assert ask(spark, c.medium_category, ["oil print", "bronze cast", "oil on canvas", "ink drawing", "quilt", "chair"]) == ["print", "sculpture", "painting", "work_on_paper", "textile", "other"]
    assert ask(spark, c.skip_lot, ["prints", "after Homer", "afternoon", "LE", "Le Pho", "Lemon", "monolith", None]) == [True, True, False, True, False, False, False, False]
    assert ask(spark, c.venue_tier, ["Christie's", "Abell", None]) == ["big3", "mid", "mid"]
    assert ask(spark, c.score_tier, [9.0, 7.5, 7.4, 5.0, 4.9], "double") == ["A", "A", "B", "B", "C"]
    assert ask(spark, c.is_firm, ["Lenox China", "Ann Lee"]) == [True, False]
    assert ask(spark, c.gallery_tier, ["Gagosian", "Lisson", "Night Gallery", "Swann Auction", "Corner"]) == [1, 2, 3, 0, 0]
    assert ask(spark, c.mass_edition, ["12/500", "12/499", None]) == [True, False, False]
    assert ask(spark, c.sale_id, ["https://www.estatesales.net/WA/Mercer/98040/4984500?x", "77", "https://other.com/5", None]) == [4984500, 77, None, None]


@pytest.mark.parametrize("price, outcome, ceiling, bad", [(180, "sold", 500000, True), (6000, "sold", 500000, False), (180, "sold", 4000, False), (180, "unsold", 500000, False), (None, "sold", 500000, False), (180, "sold", None, False)])
def test_suspect(spark, price, outcome, ceiling, bad):
    got = spark.range(1).select(c.is_suspect(F.lit(price).cast("double"), F.lit(outcome), F.lit(ceiling).cast("double"))).first()[0]
    assert got is bad


@pytest.mark.parametrize("tier, high, bid, flag", [("strong", 4000, None, True), ("listed", 800, 100, True), ("listed", 799, 100, False), ("strong", 399, None, False), ("minor", 4000, None, False), (None, 4000, None, False)])
def test_flags(spark, tier, high, bid, flag):
    got = spark.range(1).select(c.flag_lot(F.lit(tier).cast("string"), F.lit(high).cast("double"), F.lit(bid).cast("double"))).first()[0]
    assert got is flag


def test_standing_tiers(spark):
    rows = [(0, 0, 0, None), (0, 1, 0, "listed"), (0, 3, 0, "strong"), (1, 0, 0, "strong"), (0, 0, 1, "strong")]
    for papers, museums, awards, want in rows:
        assert spark.range(1).select(c.standing(F.lit(papers), F.lit(museums), F.lit(awards))).first()[0] == want


def test_tiles_and_replies(spark):
    got = ask(spark, c.parse_tile, ["High Bid: 1,200 USD 3 Bids 100 - 200 USD", ""])
    assert (got[0]["high_bid"], got[0]["bids"], got[0]["estimate"], got[1]["bids"]) == (1200.0, 3, "100 - 200 USD", None)
    assert ask(spark, lambda x: indexed_verdicts(x, F.lit(3)), ["1:X 3:Y", "", None]) == [["X", "P", "Y"], ["P", "P", "P"], ["P", "P", "P"]]
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    assert [r["promise"] for r in scored(df, "t").orderBy("t").collect()] == [scored(df, "t").orderBy("t").collect()[i]["promise"] for i in (0, 1)]
