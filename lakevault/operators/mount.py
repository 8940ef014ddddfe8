"""Views for a read-only mount: attributes of paths, and names in directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modes of a directory and of a file that all may read (fixed values: 040755, 0100644).
DIRECTORY, FILE = 0o040755, 0o100644


def attributes(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """path, mode, kind, size; sizes are those of the plain contents."""
    a = dirs.select(F.concat(F.lit("/"), "path").alias("path"), F.lit(DIRECTORY).alias("mode"), F.lit("dir").alias("kind"), F.col("encoded_size").alias("size"))
    return a.unionByName(files.select(F.concat(F.lit("/"), "path").alias("path"), F.lit(FILE).alias("mode"), F.lit("file").alias("kind"), "size"))


def directories(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """dir, name of all entries, and of the directory itself and the one above."""
    own = dirs.select(F.concat(F.lit("/"), "path").alias("dir"), F.explode(F.array(F.lit("."), F.lit(".."))).alias("name"))
    return entries.select(F.concat(F.lit("/"), "dir").alias("dir"), "name").unionByName(own)
