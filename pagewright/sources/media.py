"""Media trees: paths, days, metadata and readability."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pagewright.functions import dates as D
from pagewright.functions.text import MEDIA
from pagewright.sources.store import latest, publish


def _files(spark: SparkSession, root: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where(suffix.isin(MEDIA) & ~F.startswith(name, F.lit(".")))
    base = F.lit(root.rstrip("/").removeprefix("file:") + "/")
    return kept.withColumn("path", F.element_at(F.split(F.regexp_replace("path", "^file:/+", "/"), base, 2), -1))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the media files under a root, relative to it; their content is not read."""
    return _files(spark, root).select("path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).select("path", "length", "content")


def exif_day(data: bytes) -> str | None:
    """When a picture was taken, by its metadata: original, digitised, changed."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return None
    base = at + 6
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None:
        return None

    def directory(offset: int) -> dict[int, bytes]:
        found = {}
        (n,) = struct.unpack_from(order + "H", data, base + offset)
        for k in range(n):
            tag, _, size, value = struct.unpack_from(order + "HHII", data, base + offset + 2 + 12 * k)
            place = base + value if size > 4 else base + offset + 2 + 12 * k + 8
            found[tag] = data[place : place + size] if tag != 0x8769 else struct.pack("I", value)
        return found

    try:
        (first,) = struct.unpack_from(order + "I", data, base + 4)
        top = directory(first)
        sub = directory(struct.unpack("I", top[0x8769])[0]) if 0x8769 in top else {}
    except struct.error:
        return None
    raw = sub.get(36867) or sub.get(36868) or top.get(306)
    return raw.rstrip(b"\0").decode("ascii", "replace") if raw else None


@pandas_udf(StringType())
def _exif(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else exif_day(bytes(b)))


def days(spark: SparkSession, root: str) -> DataFrame:
    """(path, date): the day of each file by name, where that tells, else by its metadata."""
    name = F.element_at(F.split("path", "/"), -1)
    named = _files(spark, root).withColumn("_d", D.file_date(name))
    told = named.where("_d IS NOT NULL").select("path", F.col("_d").alias("date"))
    rest = named.where("_d IS NULL").select("path", D.file_date(name, _exif("content")).alias("date"))
    return told.unionAll(rest)


def cached_days(spark: SparkSession, root: str, store: str, rescan: bool = False) -> DataFrame:
    """``days``, kept as versions at ``store`` (outside the tree) and read from there unless ``rescan``."""
    held = None if rescan else latest(spark, store)
    if held is None:
        publish(days(spark, root), store)
        held = latest(spark, store)
    return held
