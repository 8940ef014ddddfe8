"""Backups of a machine: its configuration and its shares as directories of one version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.functions.digests import EMPTY
from lakevault.operators import trees as T

CONFIG, SHARES = "@OS_CONFIG", "@SHARES"


def root(spark: SparkSession, config_digest: str, shares: list[tuple[str, str]]) -> DataFrame:
    """tree_entries and sizes of the root and its list of shares (name, digest), both in the order given."""
    listed = T.listed([("dir", n, d) for n, d in shares], spark) if shares else None
    of = listed.first()["tree_digest"] if listed is not None else EMPTY
    top = T.listed([("dir", CONFIG, config_digest), ("dir", SHARES, of)], spark)
    return top if listed is None else top.unionByName(listed)


def share_names(tree_entries: DataFrame, root_digest: DataFrame) -> DataFrame:
    """name, tree_digest of the shares of a version's root (tree_digest)."""
    at = T.search(tree_entries, root_digest, SHARES).select(F.col("digest").alias("tree_digest"))
    return tree_entries.join(at, "tree_digest").where("kind = 'dir'").select("name", F.col("child_digest").alias("tree_digest"))


def selected(tree_entries: DataFrame, root_digest: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """name, destination, tree_digest of the shares asked for; of a name given twice the last counts, unknown ones are left out."""
    spark = tree_entries.sparkSession
    asked = spark.createDataFrame(list(dict(wanted).items()), "name string, destination string")
    return share_names(tree_entries, root_digest).join(F.broadcast(asked), "name").select("name", "destination", "tree_digest")


def per_share(files: DataFrame) -> DataFrame:
    """share, n_files, size: sums over files (share, size)."""
    return files.groupBy("share").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
