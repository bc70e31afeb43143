"""Readers on small files; the streams give what one batch gives."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from salesignal.sources import readers as r
from salesignal.streaming import events as st


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,note,art_1,mod_1,art_2,mod_2\n1,"two\nlines",x,,y,after\n', encoding="utf-8")
    df = r.read_catalogue(spark, str(tmp_path / "a.csv"))
    assert df.columns[0] == "id" and df.first()["note"] == "two\nlines"
    assert sorted(map(tuple, r.numbered_groups(df, r"(?P<name>art|mod)_(?P<n>\d+)", ["id"]).select("id", "n", "art", "mod").collect())) == [("1", 1, "x", None), ("1", 2, "y", "after")]
    (tmp_path / "b.tsv").write_text("1\tx\tann\n2\n3\ty\tbo\n")
    assert sorted(map(tuple, r.read_positional(spark, str(tmp_path / "b.tsv"), {"id": 0, "name": 2}).collect())) == [("1", "ann"), ("3", "bo")]
    (tmp_path / "c.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(x["a"] for x in r.read_json_lines(spark, str(tmp_path / "c.json"), "a int").collect()) == [1, 2]
    (tmp_path / "d.json").write_text(json.dumps({"entries": {"k1": {"n": 3}, "k2": {"n": 4}}}))
    assert sorted(map(tuple, r.read_json_map(spark, str(tmp_path / "d.json"), "n: INT", "entries").collect())) == [("k1", 3), ("k2", 4)]
    with tarfile.open(tmp_path / "e.tar.bz2", "w:bz2") as tar:
        for name, body in (("works/1.json", b'{"id": 1, "t": "x"}'), ("other/2.json", b"{}"), ("works/3.json", b"no json")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert [tuple(x) for x in r.read_tar_json(spark, str(tmp_path / "e.tar.bz2"), "^works/", "id int, t string").collect()] == [(1, "x")]
    assert r.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    page = spark.createDataFrame([(1, "<a href='/x'>one <b>two</b></a>"), (2, None)], "page_id int, html string")
    assert [tuple(x) for x in r.page_links(page).collect()] == [(1, 0, "/x", "one two")]
    assert spark.range(1).select(r.base64_json(F.lit("eyJhIjogMX0="), "a int")["a"]).first()[0] == 1


@pytest.fixture
def feed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00", i % 3, "click", float(i), "{}") for i in range(20)] + [(3, "2024-01-01 03:00:00", 0, "click", 3.0, "{}")], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3).write.parquet(str(tmp_path / "feed"))
    return str(tmp_path / "feed")


def test_streams(spark, feed, tmp_path):
    got = []
    st.run_available(st.deduplicated(st.feed(spark, feed, 9)), str(tmp_path / "c1"), lambda df, _: got.extend(df.collect()))
    assert sorted(x["event_id"] for x in got) == list(range(20))
    days = []
    st.run_available(st.daily_counts(st.feed(spark, feed, 9)), str(tmp_path / "c2"), lambda df, _: days.extend(df.collect()))
    assert {(str(x["day"])[:10], x["n"]) for x in days} == {("2024-01-01", 5), ("2024-01-02", 4), ("2024-01-03", 4)}


def test_pending_stream(spark, tmp_path):
    rows = [(1, 3, "2024-01-01 00:00:00"), (1, 14, "2024-01-02 00:00:00"), (2, 20, "2024-01-01 00:00:00"), (3, 4, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "id bigint, pictures bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = []
    polls = spark.readStream.schema("id bigint, pictures bigint, ts timestamp").parquet(str(tmp_path / "p"))
    st.run_available(st.pending_sales(polls), str(tmp_path / "c"), lambda df, _: got.extend(df.collect()), "append")
    assert sorted((x["id"], x["pictures"]) for x in got) == [(1, 14), (2, 20)]
