"""Steps of the feeds on constructed rows."""

from pyspark.sql import functions as F

from salesignal.functions import money as mo
from salesignal.operators import feeds as f


def test_currency_of_two_marks(spark):
    shown = {"USD 100 (EUR 90)": "USD", "GBP 500 / EUR 600": "GBP", "EUR 5 HK$ 9": "HKD", "€ 5 or £ 4": "GBP", "US$ 3": "USD", "A$ 3": "AUD", "12": "USD"}
    got = {r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in shown], "t string").select("t", mo.detect_currency(F.col("t")).alias("c")).collect()}
    assert got == shown
    money = spark.createDataFrame([("GBP 1,000",), ("€ 2.000,50",), ("none",)], "t string").select(mo.parse_money(F.col("t")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in money] == [(1000.0, "GBP", 1270.0), (2000.5, "EUR", 2160.54), (None, None, None)]


def test_funnel_stages(spark):
    rows = [(1, "a", "oil on canvas", "", "", "", "Known Artist"), (2, "a", "print 4/900 oil painting", "", "", "", "Known Artist"), (3, "b", "chair", "", "Pallet closeout", "", "Known Artist"), (4, "a", "oil painting 7/900", "", "", "", "Known Artist"), (5, "a", "oil on board", "", "", "", "Nobody Here"), (6, None, "chair", None, None, None, None)]
    rows += [(10 + i, "m", f"{n} oil painting", "", "", "", "Known Artist") for i, n in enumerate(("Picasso", "Monet", "Warhol"))]
    lots = spark.createDataFrame(rows, "lot int, auction string, title string, detail string, auction_title string, auction_house string, artist string")
    profiles = spark.createDataFrame([("Known Artist", "strong", 0, 0, 0.0)], "artist string, standing string, collections int, tier int, ceiling double")
    got = {r["lot"]: (r["stage"], r["why"]) for r in f.screen_lots(lots, profiles).collect()}
    assert got == {1: ("candidate", "museum"), 2: ("skipped", ""), 3: ("density", ""), 4: ("edition", ""), 5: ("insignificant", ""), **{10 + i: ("mill", "") for i in range(3)}}
    assert f.screen_lots(lots.limit(0), profiles).count() == 0


def test_outcomes_and_bands(spark):
    rows = spark.createDataFrame([(100.0, 90.0, 3), (None, 90.0, 3), (None, 90.0, 0), (None, None, None), (0.0, 5.0, 1)], "realized double, bid double, bids int")
    got = [tuple(r) for r in rows.select(f.outcome(F.col("realized"), F.col("bid"), F.col("bids")).alias("o")).select("o.*").collect()]
    assert got == [("sold", 100.0), ("final_bid", 90.0), ("unsold", None), ("unsold", None), ("final_bid", 5.0)]
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    dates = spark.createDataFrame([("2024-01-14 12:00:00",), ("2024-01-14 11:00:00",), ("2024-01-29 00:00:00",), ("soon",), (None,)], "ends string")
    assert [tuple(r) for r in dates.select(f.in_band(F.col("ends"), now), f.in_band(F.col("ends"), now, keep_unreadable=True)).collect()] == [(True, True), (False, False), (True, True), (False, True), (False, True)]


def test_ledger_and_run_log(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id int, ts string")
    f.append_ledger(events, str(tmp_path / "ledger"))
    f.append_ledger(events.filter("id = 1"), str(tmp_path / "ledger"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [1, 1, 2]
    runs = spark.createDataFrame([(1, 10, "started", None), (1, 20, "finished", "ok"), (2, 30, "started", None)], "run_id int, at int, kind string, stats string")
    assert sorted(map(tuple, f.run_log(runs).collect())) == [(1, 10, 20, "ok"), (2, 30, None, None)]


def test_significance_queue_defers(spark):
    rows = [("Jane Painter", None, False, 9000.0), ("Some Company", None, True, 9e9), ("Anna Known", "strong", False, None), ("Late One", None, True, 10.0), ("Early One", None, True, 20.0), ("No Hint", None, None, None)]
    names = spark.createDataFrame([(n, s, 0, 0, 0.0, k, h) for n, s, k, h in rows], "name string, standing string, collections int, tier int, ceiling double, known boolean, heard double")
    queue = f.significance_queue(names, 2)
    assert {r["name"]: r["state"] for r in queue.collect()} == {"Jane Painter": "deferred", "Some Company": "firm", "Anna Known": "significant", "Late One": "ask", "Early One": "ask", "No Hint": "deferred"}
    answers = spark.createDataFrame([("Early One", "museum"), ("Early One", None), ("Anna Known", "")], "name string, why string")
    assert {r["name"]: (r["state"], r["why"]) for r in f.significance_answers(queue, answers).collect() if r["name"] in ("Early One", "Late One", "Anna Known")} == {"Early One": ("significant", "museum"), "Late One": ("deferred", ""), "Anna Known": ("significant", "museum")}


def test_grown(spark):
    feed = spark.createDataFrame([(1,)] * 9 + [(2,)] * 3 + [(3,)] * 9, "sale int")
    held = spark.createDataFrame([(1, 4), (2, 1), (4, 0)], "sale int, held int")
    assert [tuple(r) for r in f.grown(feed, held, "sale").collect()] == [(1, 4, 9)]
