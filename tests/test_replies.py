"""JSON in prose against a plain scanner; one call to many rows."""

import json
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from salesignal.functions import replies as r


def plain_scanner(text, want):
    """Tries every end for every start."""
    for i, c in enumerate(text):
        if c in "{[":
            for j in range(len(text), i, -1):
                try:
                    found = json.loads(text[i:j])
                except ValueError:
                    continue
                if isinstance(found, want):
                    return found
                if isinstance(found, list):
                    inner = next((x for x in found if isinstance(x, want)), None)
                    if inner is not None:
                        return inner
                break
    return None


def test_json_in_prose():
    cases = ['{"a": 1}', 'Sure! ```json\n{"a": {"b": "}{"}, "c": [1, 2]}\n``` done', 'he said "hi" {now} and {"a": "\\"}"}', "none", "", None, "{broken} then {\"ok\": true}", '[1, {"x": 2}] and {"y": 3}', '{"a": "\\\\"} {"b": 2}', "}{}", '[{"tier": "strong"}]']
    assert [r.first_json(t) for t in cases] == [{"a": 1}, {"a": {"b": "}{"}, "c": [1, 2]}, {"a": '"}'}, None, None, None, {"ok": True}, {"x": 2}, {"a": "\\"}, {}, {"tier": "strong"}]
    assert [r.first_json(t, "array") for t in cases[1:3] + cases[7:8]] == [None, None, [1, {"x": 2}]]


def test_json_in_prose_is_that_of_a_plain_scanner():
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind == 0:
            return rng.randrange(99)
        if kind in (1, 2):
            return "".join(rng.choice('ab{}[]"\\ ') for _ in range(5))
        return [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 3 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}

    for _ in range(300):
        inner = {"v": value(2)}
        text = "".join(rng.choice("xyz :,\n`") for _ in range(8)) + json.dumps(inner) + rng.choice(["", " ok", '\n```\n{"later": 1}', " }"])
        assert r.first_json(text) == plain_scanner(text, dict) == inner
        text = "well: " + json.dumps([1, inner]) + " bye"
        assert r.first_json(text, "array") == plain_scanner(text, list)


def test_time_is_in_proportion_to_the_text():
    for text in ("{" * 2_000_000, "{}" * 500_000, '{"a": ' * 300_000, "}" * 2_000_000, '{"' * 900_000):
        began = time.process_time()
        r.first_json(text)
        assert time.process_time() - began < 10


def test_json_column(spark):
    rows = spark.createDataFrame([(1, 'x {"n": 5, "t": "é"} y'), (2, None), (3, "nothing")], "id int, reply string")
    assert [x[0] for x in rows.orderBy("id").select(F.from_json(r.json_from_prose(F.col("reply")), "n int, t string")["n"]).collect()] == [5, None, None]


def test_one_call_to_many_rows(spark):
    photos = spark.createDataFrame([(i, f"p{i}") for i in range(1, 40)], "id bigint, photo string")
    status, works = r.detected(photos)
    assert {x["id"]: x["status"] for x in status.collect()} == {i: "failed" if i % 11 == 0 else "ok" for i in range(1, 40)}
    want = set()
    for i in range(1, 40):
        if i % 11:
            for k in range(i % 4):
                x, y, h = (i * 7 + k * 3) % 10 / 10, (i + k) % 8 / 10, 0.5 + k / 10
                if x + 0.25 <= 1.02 and y + h <= 1.02:
                    want.add((f"p{i}", k, ["painting", "drawing", "print"][(i + k) % 3], str((i + k) % 2 == 0)))
    assert {(x["photo"], x["pos"], x["type"], x["signed"]) for x in works.collect()} == want

    def broken(photo, attempt):
        raise OSError("no network")

    status, works = r.detected(photos, detector=broken)
    assert works.count() == 0 and status.filter("status = 'failed'").count() == 39
    with pytest.raises(AnalysisException):
        spark.sql("SELECT d.* FROM VALUES ('p1', 'type') t(a, b), LATERAL detections(a, b) d").collect()


def test_boxes(spark):
    rows = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([0.0, 0.0, 1.01, 1.0],), ([0.5, 0.5, 0.6, 0.1],), ([0.1, 0.1, 0.001, 0.5],), ([-0.1, 0.0, 0.5, 0.5],), ([0.1],), (None,), ([0.1, None, 0.2, 0.2],)], "box array<double>")
    assert [x[0] for x in rows.select(r.valid_box(F.col("box"))).collect()] == [[0.1, 0.2, 0.3, 0.4], [0.0, 0.0, 1.0, 1.0], None, None, None, None, None, None]
