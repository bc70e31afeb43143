"""Sources: catalogues, dumps, caches, archives, pages."""

from __future__ import annotations

import io
import json
import re
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from salesignal.functions.keys import text_or_empty


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with the columns of schema; absent: no rows. Columns that an older file lacks are null, others are left out."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    want = T.StructType.fromDDL(schema)
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted line breaks, a byte-order mark and fields of up to 10 million characters; all columns text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", maxCharsPerColumn=10_000_000, mode="PERMISSIVE")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def numbered_groups(df: DataFrame, pattern: str, keep: list[str]) -> DataFrame:
    """Repeated column groups as rows: pattern has the groups `name` and `n`; columns of one n make a row."""
    groups: dict[int, dict[str, str]] = {}
    for c in df.columns:
        m = re.fullmatch(pattern, c)
        if m:
            groups.setdefault(int(m["n"]), {})[m["name"]] = c
    names = sorted({n for g in groups.values() for n in g})
    structs = [F.struct(F.lit(i).alias("n"), *[(F.col(g[n]) if n in g else F.lit(None).cast("string")).alias(n) for n in names]) for i, g in sorted(groups.items())]
    if not structs:
        return df.select(*keep).limit(0)
    return df.select(*keep, F.explode(F.array(*structs)).alias("g")).select(*keep, "g.*")


def read_positional(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """A headerless tab-separated dump by position; lines with fewer fields are dropped."""
    parts = F.split("value", "\t", -1)
    need = max(columns.values()) + 1
    return spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= need).select(*[F.col("p")[i].alias(name) for name, i in columns.items()])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are none are dropped."""
    full = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    rows = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter("_bad is null").drop("_bad")


def read_json_map(spark: SparkSession, path: str, value_schema: str, inside: str | None = None) -> DataFrame:
    """A JSON file {key: {...}}, or that below one member, as rows key, value.*; a file that is no JSON gives none."""
    kind = f"MAP<STRING, STRUCT<{value_schema}>>"
    schema = f"{inside} {kind}" if inside else kind
    parsed = F.from_json("value", schema if not inside else f"STRUCT<{inside}: {kind}>")
    col = parsed[inside] if inside else parsed
    return spark.read.text(path, wholetext=True).select(F.explode(col).alias("key", "v")).select("key", "v.*")


def read_tar_json(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """JSON documents inside tar archives (any compression) whose names match member; an archive is read as a stream in one task."""
    fields = T.StructType.fromDDL(schema).names

    def members(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for info in tar:
                        if info.isfile() and re.search(member, info.name):
                            try:
                                doc = json.load(tar.extractfile(info))
                            except ValueError:
                                continue
                            rows.append([doc.get(f) for f in fields])
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=fields)
                            rows = []
                yield pd.DataFrame(rows, columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, schema)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,webp}") -> DataFrame:
    """(path, file_hash, bytes) of the pictures below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("bytes"))


def base64_json(column: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unbase64(F.regexp_replace(text_or_empty(column), r"\s", "")), "UTF-8"), schema)


def page_links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, href, label) of the anchors of pages."""
    anchor = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(text_or_empty(F.col(html)), F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(text_or_empty(F.col(html)), F.lit(anchor), F.lit(2)).alias("label"))
    return pages.select(page_id, F.posexplode(both).alias("pos", "a")).select(page_id, "pos", "a.href", F.trim(F.regexp_replace("a.label", "<[^>]+>", "")).alias("label"))
