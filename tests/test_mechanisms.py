"""Picture hashes against a plain loop, fragments and seen ids against brute force, the streamed prior against the batch."""

import math
import random
import struct
import zlib

from pyspark.sql import functions as F

from salesignal.operators import feeds as f
from salesignal.operators import match as m
from salesignal.operators import select as se
from salesignal.sources import images as im
from salesignal.streaming import events as st
from salesignal.streaming import taste as ts


def png(path, pixels):
    """A PNG of rows of (red, green, blue)."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def resampled(samples, into):
    """One line of samples by a Lanczos window, sample by sample."""
    n = len(samples)
    scale = n / into
    wide = max(scale, 1.0)
    out = []
    for i in range(into):
        centre, total, weights = (i + 0.5) * scale, 0.0, 0.0
        for k in range(max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))):
            x = (k + 0.5 - centre) / wide
            w = 1.0 if x == 0 else 0.0 if abs(x) >= 3 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2
            total += w * samples[k]
            weights += w
        out.append(min(255, max(0, math.floor(total / weights + 0.5))))
    return out


def plain_hash(pixels):
    lines = [resampled([(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in row], 9) for row in pixels]
    columns = [resampled([line[c] for line in lines], 8) for c in range(9)]
    bits = 0
    for r in range(8):
        for c in range(8):
            bits = bits << 1 | (columns[c][r] > columns[c + 1][r])
    return bits - (1 << 64) if bits >> 63 else bits


def picture(rng, height, width, shade=0):
    wave = [rng.random() * 6 for _ in range(4)]
    return [[tuple(int(min(255, max(0, 128 + shade + 100 * math.sin(wave[0] + wave[k + 1] * x / width * 3 + y / height * 5)))) for k in range(3)) for x in range(width)] for y in range(height)]


def test_picture_hashes(spark, tmp_path):
    rng = random.Random(9)
    want, shapes = {}, [(8, 9), (40, 31), (5, 4), (64, 120), (100, 9), (1, 1)]
    for i, (height, width) in enumerate(shapes):
        pixels = picture(rng, height, width)
        png(tmp_path / f"p{i}.png", pixels)
        want[f"p{i}.png"] = plain_hash(pixels)
    (tmp_path / "x9.png").write_bytes(b"no picture")
    rows = im.read_pictures(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1)).cache()
    got = {r["name"]: r["hash"] for r in im.with_hash(rows).collect()}
    assert got == {**want, "x9.png": None}
    assert [r["name"] for r in im.first_pictures(rows, 2).collect()] == ["p0.png", "p1.png"]


def test_hashes_of_crops_feed_the_clusters(spark, tmp_path):
    rng = random.Random(4)
    views = [picture(rng, 60, 60), picture(rng, 60, 60)]
    black = [[(0, 0, 0)] * 100 for _ in range(100)]
    for i, view in enumerate([views[0], views[1], views[0]]):
        page = [list(row) for row in black]
        for y, row in enumerate(view):
            page[y + 20][10:70] = row
        png(tmp_path / f"p{i}.png", page)
    rows = im.read_pictures(spark, str(tmp_path)).withColumn("id", F.regexp_extract("path", r"p(\d)", 1).cast("long"))
    rows = rows.withColumn("crop", im.crop_box(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.6), F.lit(0.6)), F.col("width"), F.col("height"), pad=0.0))
    hashed = im.with_hash(rows, "crop").withColumn("size", im.crop_area(F.col("crop"))).withColumn("group", F.lit(1)).cache()
    assert {r["id"]: r["hash"] for r in hashed.collect()} == {0: plain_hash(views[0]), 1: plain_hash(views[1]), 2: plain_hash(views[0])}
    assert {r["size"] for r in hashed.collect()} == {3600}
    clusters = {r["id"]: r["cluster"] for r in m.greedy_clusters(hashed, 8).collect()}
    assert clusters[0] == clusters[2] and clusters[0] != clusters[1]


def test_crop_boxes(spark):
    rows = spark.createDataFrame([([0.5, 0.5, 0.5, 0.5],), ([0.0, 0.0, 0.001, 0.001],), (None,)], "box array<double>")
    got = [r[0] and tuple(r[0]) for r in rows.select(im.crop_box(F.col("box"), F.lit(200), F.lit(100))).collect()]
    assert got == [(95, 47, 200, 100), (0, 0, 8, 8), None]


def test_fragments(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abAB c") for _ in range(n))
    names = [(i, word(rng.randrange(25))) for i in range(200)] + [(300, None), (301, "")]
    frags = [(i, word(rng.randrange(7))) for i in range(60)] + [(99, "zzzz")]
    rng.shuffle(frags)
    want = {i: None if n is None else next((x.lower() for _, x in sorted(frags) if x and x.lower() in n.lower()), None) for i, n in names}
    frame, table = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(frags, "pos int, fragment string")
    assert {r["id"]: r["fragment"] for r in m.fragment_matches(frame, table).collect()} == want
    assert m.fragment_matches(frame, table.limit(0)).filter("fragment is not null").count() == 0


def test_fragments_meet_by_equality(spark):
    many = spark.range(10_000).select(F.col("id").alias("pos"), F.concat(F.lit("house "), F.hex(F.xxhash64("id"))).alias("fragment"))
    names = spark.range(300).select(F.concat(F.lit("The House "), F.hex(F.xxhash64("id")), F.lit(" Ltd")).alias("name"))
    df = m.fragment_matches(names, many)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.filter("fragment is not null").count() == 300


def test_seen_ids_past_the_cap(spark):
    rng = random.Random(3)
    ids = [rng.choice([rng.randrange(-50, 50), rng.randrange(1 << 62), -rng.randrange(1 << 62)]) for _ in range(400)] + [(1 << 63) - 1, -(1 << 62)]
    frame = spark.createDataFrame([(i,) for i in ids + ids[:50]] + [(None,)], "id bigint")
    for most in (1, 7, 100, len(set(ids)), 10_000):
        assert sorted(r["id"] for r in f.seen_ids(frame, most, bins=16).collect()) == sorted(set(ids))[-most:]
    assert f.seen_ids(frame.limit(0), 5).count() == 0


def test_streamed_prior_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["Painting", "print", None, "glass"]), rng.choice(["save", "dismiss", "promote", "view", None]), rng.choice([None, "print/repro", "x"])) for _ in range(200)]
    path = str(tmp_path / "prior")
    for i in range(4):
        part = rows[i * 50 : i * 50 + 50]
        spark.createDataFrame(part, "category string, kind string, reason string").coalesce(1).write.mode("append").parquet(str(tmp_path / "ledger"))
        feed = spark.readStream.schema("category string, kind string, reason string").parquet(str(tmp_path / "ledger"))
        st.run_available(ts.running_counts(feed), str(tmp_path / "checkpoint"), ts.merge_into(path), "update")
        batch = se.taste_prior(spark.createDataFrame(rows[: i * 50 + 50], "category string, kind string, reason string"))
        assert sorted(map(tuple, ts.current_prior(spark, path).collect())) == sorted(map(tuple, batch.collect()))
    # a batch that is replayed writes the same again
    last = ts.versions(spark, path)[-1]
    before = sorted(map(tuple, ts.counts_at(spark, path).collect()))
    replayed = spark.createDataFrame(before, "category string, positive bigint, negative bigint")
    ts.merge_into(path)(replayed, last)
    assert sorted(map(tuple, ts.counts_at(spark, path).collect())) == before and ts.current_prior(spark, str(tmp_path / "none")).count() == 0
