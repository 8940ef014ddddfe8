"""Versions: listed in order of time, shown as text or JSON, found by digest; numbers of old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevault.functions.digests import display_time


def in_order(versions: DataFrame) -> DataFrame:
    return versions.orderBy("ver_timestamp", "version_digest")


def as_text(versions: DataFrame, zone: str = "UTC") -> DataFrame:
    return versions.select("ver_timestamp", "version_digest", F.concat(display_time(F.col("ver_timestamp"), zone), F.lit(" - version digest ["), "version_digest", F.lit("] - tree root digest ["), "ver_root", F.lit("]")).alias("line"))


def as_json(versions: DataFrame, zone: str = "UTC") -> DataFrame:
    object_ = F.struct(F.col("version_digest").alias("digest"), display_time(F.col("ver_timestamp"), zone).alias("timestamp"), F.col("ver_root").alias("tree_root"))
    return versions.select("ver_timestamp", "version_digest", F.to_json(object_).alias("line"))


def next_number(names: DataFrame) -> DataFrame:
    """next_id: one more than the largest of name that is a number, 1 if none is."""
    return names.agg((F.coalesce(F.max(F.expr("try_cast(name AS decimal(38,0))")), F.lit(0)) + 1).cast("long").alias("next_id"))


def one(versions: DataFrame, of: str) -> DataFrame:
    """The version of this digest; raises if there is none."""
    found = versions.where(F.col("version_digest") == of.lower())
    if found.isEmpty():
        raise LookupError(f"no version {of}")
    return found
