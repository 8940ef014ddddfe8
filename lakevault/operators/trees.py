"""Directory trees: built bottom-up, listed top-down, searched by path.

An entry is a line "kind name digest"; a tree's digest is that of its lines in order of name, byte by byte. Each level of
a build is one aggregation, each level of a listing one join; the levels are cut off from their lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevault.functions.digests import EMPTY, base_name, digest, entry_line, parent
from lakevault.session import durable


def depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def encoded(entries: DataFrame, by: str) -> DataFrame:
    """by, tree_digest, encoded_size, from entries with ordinal, kind, name, child_digest."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", entry_line(F.col("kind"), F.col("name"), F.col("child_digest")).alias("line")))), lambda x: x["line"]), "")
    return entries.groupBy(by).agg(lines.alias("text")).select(by, digest(F.col("text")).alias("tree_digest"), F.octet_length("text").cast("long").alias("encoded_size"))


def listed(entries: list[tuple[str, str, str]], spark) -> DataFrame:
    """tree_digest, encoded_size, ordinal, kind, name, child_digest of one tree with these (kind, name, digest), in this order."""
    rows = spark.createDataFrame([(k, *e) for k, e in enumerate(entries)], "ordinal int, kind string, name string, child_digest string").withColumn("one", F.lit(1))
    return rows.join(encoded(rows, "one"), "one").drop("one")


def build(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dirs, entries) of files (path, file_digest): dirs path, tree_digest, encoded_size; entries dir, ordinal, kind, name, child_digest.

    known: dirs (path, tree_digest) that are taken as they are, files below them must be left out.
    """
    leaf = files.select(F.col("path"), F.lit("file").alias("kind"), F.col("file_digest").alias("child_digest"))
    if known is not None:
        leaf = leaf.unionByName(known.where("path <> ''").select("path", F.lit("dir").alias("kind"), F.col("tree_digest").alias("child_digest")))
    leaf = durable(leaf.withColumn("depth", depth(F.col("path"))))
    deepest = leaf.agg(F.max("depth")).first()[0]
    if deepest is None:
        dirs = files.sparkSession.createDataFrame([("", EMPTY, 0)], "path string, tree_digest string, encoded_size long")
        return dirs, leaf.limit(0).select(F.col("path").alias("dir"), F.lit(0).alias("ordinal"), "kind", F.col("path").alias("name"), "child_digest")
    all_dirs, all_entries, above = [], [], None
    for d in range(deepest, 0, -1):
        nodes = leaf.where(F.col("depth") == d).drop("depth")
        if above is not None:
            nodes = nodes.unionByName(above.select("path", F.lit("dir").alias("kind"), F.col("tree_digest").alias("child_digest")))
        entries = nodes.select(parent(F.col("path")).alias("dir"), "kind", base_name(F.col("path")).alias("name"), "child_digest")
        above = durable(encoded(entries.withColumn("ordinal", F.lit(0)), "dir").withColumnRenamed("dir", "path"))
        all_dirs.append(above)
        all_entries.append(entries)
    entries = reduce(DataFrame.unionByName, all_entries)
    entries = entries.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "child_digest"))).alias("es")).select("dir", F.posexplode("es").alias("ordinal", "e"))
    return reduce(DataFrame.unionByName, all_dirs), entries.select("dir", "ordinal", "e.kind", "e.name", "e.child_digest")


def tables(dirs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, tree_entries), each tree once however many directories are alike."""
    trees = dirs.select("tree_digest", "encoded_size").dropDuplicates(["tree_digest"])
    some = dirs.groupBy("tree_digest").agg(F.min("path").alias("dir"))
    return trees, entries.join(some, "dir").select("tree_digest", "ordinal", "kind", "name", "child_digest")


def listing(tree_entries: DataFrame, root: DataFrame, levels: int | None = None) -> DataFrame:
    """path, level, kind, digest of what lies below the trees in root (tree_digest), the root itself at level 0 as "/".

    Directories end in a slash. levels: the deepest level to list; None lists all.
    """
    e = tree_entries.select(F.col("tree_digest").alias("digest"), F.col("kind").alias("k"), "name", "child_digest")
    now = durable(root.select(F.lit("/").alias("path"), F.lit(0).alias("level"), F.lit("dir").alias("kind"), F.col("tree_digest").alias("digest")))
    found = [now]
    while levels is None or len(found) <= levels:
        below = now.where("kind = 'dir'").select("digest", F.col("path").alias("up"), "level").join(e, "digest")
        path = F.concat("up", "name", F.when(F.col("k") == "dir", F.lit("/")).otherwise(F.lit("")))
        now = durable(below.select(path.alias("path"), (F.col("level") + 1).alias("level"), F.col("k").alias("kind"), F.col("child_digest").alias("digest")))
        if now.isEmpty():
            break
        found.append(now)
    return reduce(DataFrame.unionByName, found)


def search(tree_entries: DataFrame, root: DataFrame, path: str) -> DataFrame:
    """kind, digest of what a path leads to from root (tree_digest): one row, or none."""
    at = root.select(F.lit("dir").alias("kind"), F.col("tree_digest").alias("digest"))
    for name in [x for x in path.split("/") if x and x != "."]:
        step = tree_entries.where(F.col("name") == name).select(F.col("tree_digest").alias("digest"), F.col("kind").alias("k"), "child_digest", "ordinal")
        # of entries with one name the first counts
        at = at.where("kind = 'dir'").join(step, "digest").groupBy("digest").agg(F.min_by(F.struct("k", "child_digest"), "ordinal").alias("hit")).select(F.col("hit.k").alias("kind"), F.col("hit.child_digest").alias("digest"))
    return at


class WrongKind(ValueError):
    """A path leads to a file where a directory is asked for, or the other way round, or nowhere."""


def search_kind(tree_entries: DataFrame, root: DataFrame, path: str, kind: str) -> str:
    row = search(tree_entries, root, path).first()
    if row is None:
        raise WrongKind(f"{path}: not found")
    if row["kind"] != kind:
        raise WrongKind(f"{path}: is a {row['kind']}, not a {kind}")
    return row["digest"]
