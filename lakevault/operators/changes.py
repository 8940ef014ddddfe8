"""Change lists: parsed, put in normal form, looked up, turned into decisions, and applied to a tree.

A change is (path, kind, local_path), kind one of remove, new, fresh; a later one on the same path counts, and a change of a
directory masks those below it. Paths meet segment by segment: a change on a/b says nothing of a/bc. Every prefix
relation is an equi-join on the exploded directories above a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakevault.functions.digests import ancestors, normal_path, parent
from lakevault.operators.trees import build

#: PATH remove | PATH new ABSOLUTE | PATH fresh ABSOLUTE
LINE = r"^\s*([^\s/]\S*)\s+(remove|new|fresh)(?:\s+(/\S*))?\s*$"


def parsed(lines: DataFrame) -> DataFrame:
    """seq, path, kind, local_path of lines (seq, value); blank lines are left out, any other that is no change raises."""
    value = F.col("value")
    part = lambda k: F.regexp_extract(value, LINE, k)
    ok = (part(2) != "") & ((part(2) == "remove") == (part(3) == ""))
    rows = lines.where(F.trim(value) != "")
    kind = F.when(ok, part(2)).otherwise(F.raise_error(F.concat(F.lit("not a change: "), value)))
    return rows.select("seq", normal_path(part(1)).alias("path"), kind.alias("kind"), F.nullif(part(3), F.lit("")).alias("local_path"))


def normalised(changes: DataFrame) -> DataFrame:
    """The last change of each path, without those that a change above masks. path, kind, local_path."""
    rows = changes.withColumn("path", normal_path(F.col("path")))
    last = rows.groupBy("path").agg(F.max_by(F.struct("kind", "local_path"), "seq").alias("c")).select("path", "c.kind", "c.local_path")
    masked = last.select("path", F.explode(ancestors(F.col("path"))).alias("above")).where("above <> path").join(last.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return last.join(masked, "path", "left_anti")


def touched(changes: DataFrame) -> DataFrame:
    """path: the directories below which something changes, the root too."""
    return changes.where("path <> ''").select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def tree_decisions(dirs: DataFrame, changes: DataFrame) -> DataFrame:
    """path, decision (removed, again, traverse, intact), local_path, new_entries of dirs (path), from normalised changes."""
    below = touched(changes).withColumn("below", F.lit(True))
    fresh = changes.where("kind = 'new' AND path <> ''").groupBy(parent(F.col("path")).alias("path")).agg(F.count("*").alias("fresh"))
    hit = dirs.select("path").join(changes, "path", "left").join(below, "path", "left").join(fresh, "path", "left")
    decision = F.when(F.col("kind") == "remove", "removed").when(F.col("kind").isNotNull(), "again").when(F.col("below"), "traverse").otherwise("intact")
    return hit.select("path", decision.alias("decision"), "local_path", F.when(decision == "traverse", F.coalesce("fresh", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("new_entries"))


def file_decisions(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, decision (removed, again, intact), local_path of files (path)."""
    hit = files.select("path").join(changes, "path", "left")
    decision = F.when(F.col("kind") == "remove", "removed").when(F.col("kind").isNotNull(), "again").otherwise("intact")
    return hit.select("path", decision.alias("decision"), "local_path")


def unmatched(dirs: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes without effect: new below a directory that is not there, fresh of what is not there, removals of nothing."""
    nodes = dirs.select("path").unionByName(files.select("path"))
    new = changes.where("kind = 'new'").withColumn("up", parent(F.col("path"))).join(dirs.select(F.col("path").alias("up")), "up", "left_anti").drop("up")
    return new.unionByName(changes.where("kind <> 'new'").join(nodes, "path", "left_anti"))


def patched(dirs: DataFrame, files: DataFrame, changes: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dirs, entries) after normalised changes; untouched directories keep their digest and are not looked into.

    dirs: path, tree_digest; files: path, file_digest; local: local_path, file_digest of the files on this side.
    """
    masks = changes.select(F.col("path").alias("above"))
    alive = lambda df: df.withColumn("above", F.explode(ancestors(F.col("path"), itself=True))).join(masks, "above", "left_semi").select("path").distinct()
    there = touched(changes)
    kept_files = files.join(alive(files), "path", "left_anti").select("path", "file_digest")
    kept_dirs = dirs.join(alive(dirs), "path", "left_anti").join(there, "path", "left_anti").select("path", "tree_digest")
    # of a directory that is kept whole only itself is an entry
    outer = kept_dirs.withColumn("up", parent(F.col("path"))).join(there.select(F.col("path").alias("up")), "up", "left_semi").drop("up")
    loose = kept_files.withColumn("up", parent(F.col("path"))).join(there.select(F.col("path").alias("up")), "up", "left_semi").drop("up")
    known = dirs.select(F.col("path").alias("up"))
    nodes = dirs.select("path").unionByName(files.select("path"))
    new = changes.where("kind = 'new'").withColumn("up", parent(F.col("path"))).join(known, "up", "left_semi").drop("up")
    again = new.unionByName(changes.where("kind = 'fresh'").join(nodes, "path", "left_semi")).select("path", F.regexp_replace("local_path", "/+$", "").alias("from"))
    above = ancestors(F.regexp_replace("local_path", "^/", ""), itself=True)
    found = local.withColumn("from", F.explode(F.transform(above, lambda x: F.concat(F.lit("/"), x)))).join(again, "from")
    copied = found.select(F.concat("path", F.substr("local_path", F.length("from") + 1)).alias("path"), "file_digest")
    return build(loose.unionByName(copied), outer)
