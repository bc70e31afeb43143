"""Chunked, paged and batched feeds over local files: what fails is told, the rest is read."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from salesignal.sources import remote as r


def test_chunks_of_an_index(spark, tmp_path):
    r.register(spark)
    chunks = []
    for i in range(7):
        path = tmp_path / f"chunk{i}.txt"
        chunks.append(str(path))
        if i != 3:  # one that the index names is missing
            path.write_text("".join(f'{{"n": {i * 10 + k}}}\n' for k in range(i)))
    (tmp_path / "index.txt").write_text("\n".join(chunks) + "\n\n")
    rows = spark.read.format("chunked_dump").options(index=str(tmp_path / "index.txt"), batch=2, tries=2, pause=0.01).load()
    assert rows.rdd.getNumPartitions() == 4
    got = rows.select(F.get_json_object("value", "$.n").cast("int").alias("n"), "line").filter("n is not null").collect()
    assert sorted((x["n"], x["line"]) for x in got) == [(i * 10 + k, k) for i in range(7) if i != 3 for k in range(i)]
    bad = r.failures(rows).collect()
    assert [x["chunk"] for x in bad] == [chunks[3]] and "FileNotFoundError" in bad[0]["error"]
    (tmp_path / "none.txt").write_text("")
    assert spark.read.format("chunked_dump").options(index=str(tmp_path / "none.txt")).load().count() == 0


def page(path, results):
    path.write_text(json.dumps({"results": results}))


def auction(i, name, ends, house="House", **more):
    return {"auction": {"id": i, "eventName": name, "eventDateEnd": ends, "auctioneer": {"name": house, "city": "Troy", "state": "NY"}, **more}}


def test_pages_until_an_empty_one_and_the_rules_on_top(spark, tmp_path):
    r.register(spark)
    page(tmp_path / "art-1.json", [auction(1, "Fine Art", "2024-01-05T10:00:00"), auction(2, "Old", "2023-11-05T10:00:00"), auction(3, "x" * 200, "2024-01-15T00:00:00", eventCity="Reno", eventState="NV")])
    page(tmp_path / "art-2.json", [auction(1, "Again", "2024-01-06T10:00:00"), auction(4, "No house", "2024-01-05T10:00:00", " "), auction(5, "No date", "soon"), {"auction": None}, auction(6, "Just over", "2023-12-31T15:00:00")])
    page(tmp_path / "art-3.json", [])
    page(tmp_path / "art-4.json", [auction(9, "Behind the end", "2024-01-05T10:00:00")])
    page(tmp_path / "prints-1.json", [auction(7, "Print sale", "2024-01-09T10:00:00")])
    (tmp_path / "prints-2.json").write_text("no json")
    rows = spark.read.format("paged_search").options(pages=str(tmp_path / "{search}-{page}.json"), searches='["art", "prints"]', tries=1).load().cache()
    assert rows.filter("search = 'art'").count() == 8 and {(x["search"], x["page"]) for x in r.failures(rows).collect()} == {("prints", 2)}
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    got = {x["id"]: (x["title"], x["location"], x["info"], x["url"]) for x in r.open_auctions(rows, now).collect()}
    assert got == {1: ("Fine Art", "Troy, NY", "ends 01/05", "https://hibid.com/catalog/1/_"), 3: ("x" * 120, "Reno, NV", "ends 01/15", "https://hibid.com/catalog/3/_"), 6: ("Just over", "Troy, NY", "ends 12/31", "https://hibid.com/catalog/6/_"), 7: ("Print sale", "Troy, NY", "ends 01/09", "https://hibid.com/catalog/7/_")}


def test_batches_of_ids(spark, tmp_path):
    def fetch(ids):
        if 13 in ids:
            raise TimeoutError("slow")
        return [json.dumps({"id": i, "pictures": i * 2}) for i in ids]

    ids = spark.createDataFrame([(i,) for i in range(20)], "id bigint").coalesce(1)
    rows = r.fetched(ids, fetch, batch=4, tries=2, pause=0.001)
    got = rows.filter("error is null").select(F.get_json_object("value", "$.pictures").cast("int").alias("n")).collect()
    assert sorted(x["n"] for x in got) == [i * 2 for i in range(20) if not 12 <= i < 16]
    assert [sorted(x["ids"]) for x in r.failures(rows).collect()] == [["12", "13", "14", "15"]]


def test_a_call_is_tried_again():
    left = [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("no")
        return 5

    assert r.tried(call, 3, 0.001) == (5, None) and r.tried(call, 1, 0)[0] == 5
    left[0] = 9
    assert r.tried(call, 2, 0.001) == (None, "OSError: no")
