"""Reference images of an archive folder: names, times, as-of lookup.

Names are `YYYYMMDDhhmmssXh.jpg` (site letter, H-alpha mark)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import as_of_nearest

NAME = r"^(\d{14})([A-Za-z])h\.jpg$"
LIMIT = 6 * 3600


def parse_name(name: str) -> tuple[int, str] | None:
    """(unix seconds, site) of a science-grade name, else None."""
    import re

    m = re.match(NAME, name)
    if not m:
        return None
    try:
        at = datetime.strptime(m[1], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        return None
    return int(at.timestamp()), m[2]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, listing, site, stamp) of the folder's reference images."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    stamp = F.regexp_extract("name", NAME, 1)
    at = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))
    rows = files.where(F.col("name").rlike(NAME)).select("path", F.col("name").alias("listing"), F.regexp_extract("name", NAME, 2).alias("site"), at.alias("stamp"))
    return rows.where("stamp is not null")


def nearest_reference(scans: DataFrame, references: DataFrame) -> DataFrame:
    """scans (scan_id, at) with the reference nearest in time, within 6 hours."""
    return as_of_nearest(scans, references, "scan_id", "at", "stamp", "listing", LIMIT, carry=["path"])
