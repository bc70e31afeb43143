"""Pictures: read and decoded by Spark's image source, hashed in Arrow batches, cropped by column arithmetic."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a box's width and height that is added on each side of a crop, and its least size in pixels.
PAD, LEAST_PIXELS = 0.05, 8
COLUMNS, ROWS = 9, 8


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the pictures below a folder, decoded; a file that is no picture has null sizes and no data."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    good = F.col("height") > 0
    return rows.select(F.col("origin").alias("path"), *[F.when(good, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def first_pictures(pictures: DataFrame, most: int) -> DataFrame:
    """The first `most` pictures by path: a look at a folder."""
    return pictures.orderBy("path").limit(most)


@lru_cache(maxsize=256)
def lanczos(n: int, into: int) -> np.ndarray:
    """Weights (into x n) that resample n samples to `into` by a Lanczos window of three lobes, widened when samples are left out."""
    scale = n / into
    wide = max(scale, 1.0)
    out = np.zeros((into, n))
    for i in range(into):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        x = (np.arange(low, high) + 0.5 - centre) / wide
        weight = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        out[i, low:high] = weight / weight.sum()
    return out


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma (ITU-R 601) of pixels (rows, columns, channels), in the order blue, green, red as Spark decodes them; transparency does not count."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.int64)
    blue, green, red = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return (19595 * red + 38470 * green + 7471 * blue + 32768) >> 16


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of nine columns is brighter than the next, in eight rows of the grey picture resampled to 9 x 8."""
    small = grey(pixels)
    small = _bytes(small @ lanczos(small.shape[1], COLUMNS).T)
    small = _bytes(lanczos(small.shape[0], ROWS) @ small)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def crop_box(box: Column, width: Column, height: Column, pad: float = PAD) -> Column:
    """struct(left, top, right, bottom) in pixels of a box [left, top, width, height] given in shares of a picture, with a margin, inside the picture as far as LEAST_PIXELS allow."""
    x, y, w, h = (F.get(box, i) for i in range(4))
    zero, one = F.lit(0.0), F.lit(1.0)
    left, top = F.floor(F.greatest(zero, x - w * pad) * width).cast("int"), F.floor(F.greatest(zero, y - h * pad) * height).cast("int")
    right, bottom = F.floor(F.least(one, x + w * (1 + pad)) * width).cast("int"), F.floor(F.least(one, y + h * (1 + pad)) * height).cast("int")
    return F.when(x.isNotNull() & h.isNotNull(), F.struct(left.alias("left"), top.alias("top"), F.greatest(right, left + LEAST_PIXELS).alias("right"), F.greatest(bottom, top + LEAST_PIXELS).alias("bottom")))


def crop_area(crop: Column) -> Column:
    """Pixels of a crop: clusters of views keep the largest."""
    return (crop["right"] - crop["left"]) * (crop["bottom"] - crop["top"])


def with_hash(pictures: DataFrame, crop: str | None = None) -> DataFrame:
    """pictures (height, width, channels, data and any others) with `hash`, of the crop if a column of crop_box is named; null for what is no picture or lies outside it. Pixels stay in the task that read them."""
    kept = [c for c in pictures.columns if c != "data"]
    asked = ["height", "width", "channels", "data", *([f"{crop}.{s}" for s in ("left", "top", "right", "bottom")] if crop else [])]

    def hashed(batches):
        for batch in batches:
            own = [batch.column(i).to_pylist() for i in range(len(asked)) if i != 3]
            codes = []
            for i, raw in enumerate(batch.column(3)):
                height, width, channels, *edges = (c[i] for c in own)
                data = raw.as_buffer() if raw.is_valid else b""
                if not height or not width or len(data) != height * width * channels:
                    codes.append(None)
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                if edges:
                    if None in edges:
                        codes.append(None)
                        continue
                    left, top, right, bottom = edges
                    pixels = pixels[max(0, top) : bottom, max(0, left) : right]
                codes.append(difference_hash(pixels) if pixels.size else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(asked), batch.num_columns)], pa.array(codes, pa.int64())], names=[*kept, "hash"])

    schema = pictures.select(*kept).schema.add("hash", "long")
    return pictures.select(*[F.col(a).alias(f"_{i}") for i, a in enumerate(asked)], *kept).mapInArrow(hashed, schema)
