"""WARC archives with revisit records: equal payloads are written once, and read back through their references."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesignal.llm.common import BROADCAST_BYTES, new_path, size_within, stored

END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Records in an archive at most, and bytes of its payloads on average, before compression.
RECORDS, ARCHIVE_BYTES = 50_000, 1 << 28


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits, ten hexadecimal digits, are eight base-32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _record_id(page_id: Column, digest: Column) -> Column:
    code = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where value is null. Control characters and spaces in the value are percent-encoded, so that a value cannot start a line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def resolved_headers(pages: DataFrame, least_bytes: int = 0, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type, refers_to and original_url.

    Of pages with equal payloads of least_bytes or more, the one with the largest page_id is the response and the others revisit it. Headers alone are shuffled by digest, after pre-aggregation. What comes back to the pages is the list of digests that more than one page has, with their responses: of a checked size it is sent to where the payloads lie, so that these are not moved; a longer list meets the pages by shuffle, and the adaptive skew join splits a digest that very many pages have.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    headers = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("original"), F.count("*").alias("n"))
    shared = stored(headers.filter("n > 1 and original.page_id is not null").select("payload_digest", "original"), "shared-digests")
    small = size_within(shared, F.octet_length("payload_digest") + F.coalesce(F.octet_length("original.url"), F.lit(0)) + 40, most_bytes)
    rows = rows.join(F.broadcast(shared) if small else shared, "payload_digest", "left")
    revisits = (F.col("payload_bytes") >= least_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return rows.select(
        "page_id",
        "url",
        F.when(~revisits, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("original.page_id")).alias("refers_to"),
        F.when(revisits, F.col("original.url")).alias("original_url"),
    )


def record_text(date: str) -> Column:
    """A record without the two line ends that close it, from the columns of resolved_headers. Lengths and digests are those of what is written now."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.0{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, _clean(F.col("original_url")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records: int | None = None, most_bytes: int = BROADCAST_BYTES) -> None:
    """Deduplicated gzip archives below path, of `records` records each (not given: what makes ARCHIVE_BYTES on average). Spark's own writer commits them, so a lost or repeated task leaves no half-written file; a record ends with the two line ends that the format asks for."""
    if records is None:
        mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
        records = max(1, min(RECORDS, int(ARCHIVE_BYTES / (mean + 1))))
    rows = resolved_headers(pages, least_bytes, most_bytes).select(record_text(date).alias("value"))
    rows.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse_warc(stream: io.BufferedIOBase):
    """(headers, block) of each record; header names in lower case."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record ends before its Content-Length")
        yield headers, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Header rows of all records below path: page_id, record_id, record_type, payload_digest, payload_bytes (null for revisits), refers_to_record. A response whose payload doesn't have its digest raises."""

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                rows = []
                for h, block in parse_warc(gzip.GzipFile(fileobj=raw)):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = None
                    if h["warc-type"] == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
                    page = h.get("x-page-id")
                    rows.append((page and int(page), h["warc-record-id"], h["warc-type"], digest, size, h.get("warc-refers-to")))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to_record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parsed, "page_id bigint, record_id string, record_type string, payload_digest string, payload_bytes bigint, refers_to_record string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: headers meet by payload digest, and a revisit takes length and page of the response it names."""
    responses = records.filter("record_type = 'response'").groupBy("payload_digest", F.col("record_id").alias("refers_to_record")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("original_bytes"))
    joined = records.filter("record_type = 'revisit'").join(responses, ["payload_digest", "refers_to_record"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = joined.withColumn("payload_bytes", F.col("original_bytes")).select(columns)
    return records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits)


def archived_pages(pages: DataFrame, least_bytes: int = 0, path: str | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and reads them back: a row a page.

    Null html is an empty payload, a null url leaves its header out, a null page_id never is what others refer to. Rows that repeat the winning page_id with its payload are responses all, being one page. An empty table gives an empty result; other columns are not archived.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, least_bytes, most_bytes=most_bytes)
    return resolve_revisits(read_records(spark, path))
