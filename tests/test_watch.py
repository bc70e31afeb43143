"""Named sales and their notices: a plain replay of runs, the batch rule and the stream agree."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from salesignal.operators import watch as w
from salesignal.streaming import events as st
from salesignal.streaming.notices import estate_notices

START = datetime(2024, 1, 1)
UNTIL = datetime(2024, 3, 1)
SCHEMA = "sale bigint, at timestamp, verdict_key string, notable boolean, ends date"


def made(rng, sales=40):
    rows = []
    for sale in range(sales):
        at, verdict, notable = START + timedelta(hours=rng.randrange(200)), "pending", False
        ends = (START + timedelta(days=rng.randrange(25))).date()
        for _ in range(rng.randrange(1, 9)):
            rows.append((sale, at, verdict, notable, ends if rng.random() > 0.1 else None))
            at += timedelta(hours=rng.choice([3, 12, 24, 70, 200]))
            if rng.random() < 0.4:
                verdict, notable = rng.choice([("collector", True), ("not_notable", False), ("artist", True)])
            if rng.random() < 0.1:
                ends += timedelta(days=3)
    return rows


def replayed(rows):
    """Hour by hour: a sale's poll, or else the daily run that finds a reminder due."""
    out = []
    for sale in {r[0] for r in rows}:
        polls = {r[1]: r for r in rows if r[0] == sale}
        sent, last, reminded = None, None, False
        hour = START
        while hour <= UNTIL:
            if hour in polls:
                _, _, verdict, notable, ends = polls[hour]
                soon = notable and ends is not None and hour.date() >= ends - timedelta(days=2)
                if last is None:
                    out.append((sale, hour, "first", verdict))
                elif verdict != sent:
                    out.append((sale, hour, "changed", verdict))
                elif soon and not reminded:
                    out.append((sale, hour, "closing", verdict))
                    reminded = True
                sent, last = verdict, polls[hour]
            elif last is not None and last[3] and last[4] is not None and not reminded and last[4] - timedelta(days=2) <= hour.date() <= last[4] and hour - last[1] >= timedelta(hours=24):
                out.append((sale, hour, "closing", sent))
                reminded = True
            hour += timedelta(hours=1)
    return sorted(out)


def test_batch_notices_are_those_of_the_replay(spark):
    rng = random.Random(8)
    for _ in range(3):
        rows = made(rng)
        got = w.notices(spark.createDataFrame(rows, SCHEMA), F.lit(UNTIL)).collect()
        assert sorted(tuple(r) for r in got) == replayed(rows)
    assert w.notices(spark.createDataFrame([], SCHEMA), F.lit(UNTIL)).count() == 0


def test_stream_notices_are_those_of_the_batch(spark, tmp_path):
    rows = made(random.Random(11), 12)
    batch = sorted(tuple(r) for r in w.notices(spark.createDataFrame(rows, SCHEMA), F.lit(UNTIL)).collect())
    assert {n for _, _, n, _ in batch} == {"first", "changed", "closing"}
    # five drops of polls in order of time, then one that moves the watermark past all reminders
    rows.sort(key=lambda r: r[1])
    cuts = [0, *[len(rows) * i // 5 for i in range(1, 6)]]
    parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [[(10_000, UNTIL + timedelta(hours=2), "pending", False, date(2024, 9, 1))], [(10_001, UNTIL + timedelta(hours=3), "pending", False, date(2024, 9, 1))]]
    got = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
        feed = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "polls"))
        # each drain starts from what the checkpoint kept
        st.run_available(estate_notices(feed), str(tmp_path / "checkpoint"), lambda df, _: got.extend(tuple(r) for r in df.collect()))
    assert sorted(r for r in got if r[0] < 10_000) == batch


def test_named_sales(spark):
    polls = spark.createDataFrame([(1, START, "Estate of John R. Smith — Fine Art", "A", None, date(2024, 1, 9)), (2, START, "Pfendler Estate Auction", "B", "Troy", None), (3, START, "Online Estate Auction — Tools & More", "B", None, None), (4, START, "The Vogel Collection, Reno NV", None, None, None), (5, START, None, "B", None, None)], "sale bigint, at timestamp, title string, house string, location string, ends date")
    known = spark.createDataFrame([("John R. Smith", "A", "Collector", "high", START), ("John R. Smith", "A", "unknown", "low", START + timedelta(days=1)), ("Vogel", "", "artist", "low", START - timedelta(days=9))], "person string, house string, verdict string, confidence string, checked_at timestamp")
    got = {r["sale"]: (r["person"], r["place"], r["verdict"], r["notable"], r["verdict_key"]) for r in w.named_sales(polls, known).collect()}
    nowhere = "the United States (exact city unknown)"
    assert got == {1: ("John R. Smith", nowhere, "collector", True, "collector"), 2: ("Pfendler", "Troy", None, False, "surname_only"), 4: ("Vogel", "Reno, NV", "artist", False, "artist")}


def test_mail_order(spark):
    rows = spark.createDataFrame([(1, "first", False, "unknown", date(2024, 1, 2)), (2, "changed", False, None, date(2024, 1, 9)), (3, "closing", True, "artist", None), (4, "first", False, None, date(2024, 1, 30))], "sale bigint, notice string, notable boolean, verdict string, ends date")
    assert [r["sale"] for r in w.mail_order(rows).orderBy("band", F.desc("new"), F.asc_nulls_last("ends"), "sale").collect()] == [3, 4, 2, 1]
