"""One cycle of the funnel, lot by lot."""

from salesignal.operators import funnel as fu


def test_funnel(spark):
    lots = spark.createDataFrame(
        [
            (1, "a", "Oil on canvas by Ann Lee", None, "img", 0), (2, "a", "Lithograph 12/900 by Ann Lee", None, "img", 0), (3, "a", "Framed poster, fine art", None, "img", 0), (4, "a", "Watercolor, signed lower left", None, "img", 0), (5, "a", "Chair", None, None, 0),
            (6, "a", "Oil painting by Low Man", None, None, 0), (7, "a", "Oil painting by Later One", None, None, 0), (8, "a", "Bronze sculpture", None, "img", 0), (9, "a", "Etching by New Name", None, None, 0), (10, "a", "Oil on board", None, None, 0),
            (11, "m", "Picasso oil", None, None, 0), (12, "m", "Warhol canvas", None, None, 0), (13, "m", "Renoir pastel", None, None, 0), (14, "l", "Vase", None, None, 0), (15, "a", "Gouache by Ann Lee", None, "img", 0), (16, "a", "Pastel on paper", None, None, 0),
        ],
        "lot int, auction string, title string, detail string, img string, x int",
    ).selectExpr("*", "if(auction = 'l', 'Overstock liquidation', 'Fine art') as auction_title", "'House' as auction_house")
    replies = spark.createDataFrame([(1, True, "Ann Lee", 2.0), (2, True, "Ann Lee", 9.0), (3, None, "Pat Poster", 9.0), (4, True, "", 8.0), (6, True, "Low Man", 3.5), (7, True, "Later One", 3.0), (8, True, "", 5.0), (9, True, "New Name", 4.0), (10, False, "Big Name", 9.0), (15, True, "Ann Lee", 9.0), (16, True, "Weak One", 2.9)], "lot int, is_art boolean, artist string, promise double")
    known = spark.createDataFrame([("Ann Lee",)], "artist string")
    signatures = spark.createDataFrame([(4, "signed Jo Marin '84", True), (8, "Bo Ray Two", True)], "lot int, signature string, legible boolean")
    profiles = spark.createDataFrame([("Ann Lee", True, False, "museum", "met", 0), ("Low Man", False, False, "", "", 0), ("Later One", None, True, None, None, None), ("Pat Poster", True, False, "auction", "", 0)], "artist string, significant boolean, deferred boolean, why string, museums string, gallery_tier int")
    judgements = spark.createDataFrame([(i, "YES") for i in (1, 2, 3, 4, 7, 15)] + [(9, "no")], "lot int, flag string")
    views = spark.createDataFrame([(15, False), (1, True)], "lot int, matches boolean")
    got = {r["lot"]: (r["stage"], r["flagged"], r["why"]) for r in fu.funnel(lots, replies, known, signatures, profiles, judgements, views, rescue_budget=1).collect()}
    assert got == {
        1: ("done", True, "flagged"), 2: ("done", False, "mass edition"), 3: ("done", False, "reproduction"), 4: ("done", True, "flagged"), 5: ("s1", False, None), 6: ("done", False, "artist not significant: no museum, gallery or auction record"),
        7: ("s3", False, "deferred"), 8: ("done", False, "no identifiable artist name"), 9: ("done", False, "judged no"), 10: ("done", False, "screened out"), 11: ("blocked", False, None), 12: ("blocked", False, None), 13: ("blocked", False, None),
        14: ("junk", False, None), 15: ("done", False, "picture does not match"), 16: ("done", False, "screened out"),
    }
    names = {r["lot"]: r["artist"] for r in fu.funnel(lots, replies, known, signatures, profiles, judgements, views, rescue_budget=9).collect()}
    assert names[4] == "JO Marin" and names[8] == "BO Ray Two"
    assert {r["lot"]: r["s1_priority"] for r in fu.entered(lots).collect()}[5] == 0
