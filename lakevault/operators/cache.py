"""The stat cache: files whose inode, device, time and size are as before need not be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["inode", "device", "mtime", "size"]


def valid(cache: DataFrame, versions: DataFrame, files_obj: DataFrame | None = None) -> DataFrame:
    """Entries whose version, and file object if these are given, are still stored."""
    out = cache.join(versions.select("version_digest").distinct(), "version_digest", "left_semi")
    return out if files_obj is None else out.join(files_obj.select("file_digest").distinct(), "file_digest", "left_semi")


def looked_up(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with file_digest: null where the cache misses; only those are cut and hashed."""
    known = cache.groupBy(*KEY).agg(F.max("file_digest").alias("file_digest"))
    return files.join(known, KEY, "left")


def next_generation(files: DataFrame, version_digest: str) -> DataFrame:
    """The cache that the next run reads, from files with their stat columns and file_digest."""
    return files.select(F.lit(version_digest).alias("version_digest"), *KEY, "file_digest")
