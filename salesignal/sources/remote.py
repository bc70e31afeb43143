"""Feeds that come in chunks, pages or batches: Python data sources with retries that report what failed instead of failing the scan."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines or results that a reader hands over at once.
ROWS = 5_000


def open_lines(address: str) -> Iterator[str]:
    """Lines of a file, or of an address that urllib opens. Addresses are to be seen from every executor."""
    if "://" in address:
        with urllib.request.urlopen(address, timeout=300) as found:
            for line in found:
                yield line.decode("utf-8", "replace").rstrip("\r\n")
    else:
        with open(address, encoding="utf-8", errors="replace") as found:
            for line in found:
                yield line.rstrip("\r\n")


def tried(call: Callable, tries: int, pause: float):
    """call()'s result, or the last error after so many tries, with growing pauses between them."""
    error: Exception | None = None
    for i in range(max(1, tries)):
        if i:
            time.sleep(pause * 2 ** (i - 1))
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  whatever a remote call raises
            error = e
    return None, f"{type(error).__name__}: {error}"[:200]


class Addresses(InputPartition):
    def __init__(self, items: list[str]):
        self.items = items


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.batch = options["index"], int(options.get("batch", 8))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 0.5))

    def partitions(self) -> list[InputPartition]:
        chunks = [line.strip() for line in open_lines(self.index) if line.strip()]
        return [Addresses(chunks[i : i + self.batch]) for i in range(0, max(1, len(chunks)), self.batch)]

    def read(self, partition: Addresses) -> Iterator[pa.RecordBatch]:
        for chunk in partition.items:
            # a chunk is handed over whole or not at all, so that a failure leaves no half of it; lines are numbered from 0
            lines, error = tried(lambda chunk=chunk: list(open_lines(chunk)), self.tries, self.pause)
            if error is not None:
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "line": pa.array([None], pa.int64()), "value": pa.array([None], pa.string()), "error": [error]})
                continue
            for i in range(0, len(lines), ROWS):
                own = lines[i : i + ROWS]
                yield pa.RecordBatch.from_pydict({"chunk": [chunk] * len(own), "line": pa.array(range(i, i + len(own)), pa.int64()), "value": own, "error": pa.array([None] * len(own), pa.string())})


class ChunkedDump(DataSource):
    """format("chunked_dump"): the lines of all chunks that an index file lists, one address a line.

    Options: index; batch, the chunks that a task reads; tries and pause for each chunk. Rows: chunk, line, value, error. A chunk that cannot be read gives one row with its error; the others are read.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked_dump"

    def schema(self) -> str:
        return "chunk string, line bigint, value string, error string"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.searches = options["pages"], json.loads(options["searches"])
        self.member, self.most = options.get("member", "results"), int(options.get("most_pages", 40))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 0.5))

    def partitions(self) -> list[InputPartition]:
        return [Addresses([s]) for s in self.searches] or [Addresses([])]

    def read(self, partition: Addresses) -> Iterator[pa.RecordBatch]:
        for search in partition.items:
            for page in range(1, self.most + 1):
                address = self.pages.replace("{search}", search).replace("{page}", str(page))
                found, error = tried(lambda address=address: json.loads("\n".join(open_lines(address))).get(self.member) or [], self.tries, self.pause)
                values = [None] if error is not None else [json.dumps(r) for r in found]
                n = len(values)
                if n:
                    yield pa.RecordBatch.from_pydict({"search": [search] * n, "page": pa.array([page] * n, pa.int32()), "pos": pa.array(range(n), pa.int32()), "value": pa.array(values, pa.string()), "error": pa.array([error] * n, pa.string())})
                if error is not None or not n:  # the end, or what lies behind cannot be told
                    break


class PagedSearch(DataSource):
    """format("paged_search"): the results of searches, page after page until one is empty.

    Options: pages, an address with {search} and {page}; searches, a JSON list, a task each; member, where a page holds its results; most_pages, tries, pause. Rows: search, page, pos, value (a result as JSON), error. A page that cannot be read gives a row with its error and ends its search.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "search string, page int, pos int, value string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkedDump)
    spark.dataSource.register(PagedSearch)


def fetched(ids: DataFrame, fetch: Callable[[list], list[str]], key: str = "id", batch: int = 50, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """(ids, value, error): details as JSON texts, asked for in batches of ids. fetch takes a list of ids and gives as many texts; a batch that keeps failing is one row with its ids and error, and the others go on."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for i in range(0, len(own), batch):
                part = own[i : i + batch]
                values, error = tried(lambda part=part: fetch(part), tries, pause)
                rows = [(part, None, error)] if error is not None else [([k], v, None) for k, v in zip(part, values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([[str(k) for k in r[0]] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["ids", "value", "error"])

    return ids.select(key).mapInArrow(asked, "ids array<string>, value string, error string")


def failures(rows: DataFrame) -> DataFrame:
    """What could not be read: the rows with an error."""
    return rows.filter("error is not null")


RESULT = "auction STRUCT<id: BIGINT, eventName: STRING, eventDateEnd: STRING, eventCity: STRING, eventState: STRING, auctioneer: STRUCT<name: STRING, city: STRING, state: STRING>>"


def open_auctions(results: DataFrame, now, before_hours: int = 12, after_days: int = 14) -> DataFrame:
    """(id, platform, title, house, url, info, ends, location) of the auctions that results of a paged search name: each once, where it comes first, if that says that it ends within the window around now and who holds it.

    results: page, pos, value. An end that cannot be read drops the auction; the feed's own `open` is not to be trusted.
    """
    a = F.from_json("value", RESULT)["auction"]
    own = Window.partitionBy("a.id").orderBy("page", "pos", "value")
    rows = results.filter("value is not null").select("page", "pos", "value", a.alias("a")).filter("a.id is not null and a.id <> 0").withColumn("_n", F.row_number().over(own)).filter("_n = 1")
    ends, house = F.try_to_timestamp("a.eventDateEnd"), F.trim(F.coalesce("a.auctioneer.name", F.lit("")))
    inside = (ends >= now - F.expr(f"interval {before_hours} hours")) & (ends <= now + F.expr(f"interval {after_days} days"))

    def place(event: str, auctioneer: str):
        return F.trim(F.coalesce(F.nullif(F.col(event), F.lit("")), F.col(auctioneer), F.lit("")))

    location = F.regexp_replace(F.concat_ws(", ", place("a.eventCity", "a.auctioneer.city"), place("a.eventState", "a.auctioneer.state")), "^[, ]+|[, ]+$", "")
    return rows.filter(inside & (house != "")).select(
        F.col("a.id").alias("id"), F.lit("hibid").alias("platform"), F.substring(F.trim(F.coalesce("a.eventName", F.lit(""))), 1, 120).alias("title"), F.substring(house, 1, 80).alias("house"),
        F.format_string("https://hibid.com/catalog/%d/_", "a.id").alias("url"), F.concat(F.lit("ends "), F.date_format(ends, "MM/dd")).alias("info"), ends.alias("ends"), location.alias("location"),
    )
