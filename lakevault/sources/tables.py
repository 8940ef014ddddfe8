"""Sources: files as a table of path and content, from local folders, object stores, or other tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.functions.digests import ancestors, parent

#: What is appended to an edited document.
SUFFIX = "\n[reviewed]\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, size, mtime of all files below a folder, links as the files they lead to.

    Spark's file source leaves empty files out; their names alone are listed by the driver, as all names are in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = "^(?:[a-z0-9+.-]+:/*)?" + "/" + "\\Q" + root.split("://")[-1].strip("/") + "\\E/"
    rows = files.select("path", "content", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, empty = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        if not (x := found.next()).getLen():
            empty.append((x.getPath().toString(), bytearray(), 0, x.getModificationTime() * 1000))
    if empty:
        rows = rows.unionByName(spark.createDataFrame(empty, "path string, content binary, size long, mtime long"))
    return rows.withColumn("path", F.regexp_replace("path", prefix, ""))


def of_bytes(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """path, content of files that are given as bytes, which have to fit the driver."""
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


def byte_range(content: Column, first: Column, last: Column) -> Column:
    """Bytes first to last, counted from 0, both included."""
    return F.substring(content, first + 1, last - first + 1)


def scan_counts(files: DataFrame) -> DataFrame:
    """n_files, n_dirs: every directory counts, the root too."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("n_dirs"))
    return files.agg(F.count("*").alias("n_files")).crossJoin(dirs)  # of one row each


def of_texts(rows: DataFrame, path: Column, text: str) -> DataFrame:
    return rows.select(path.alias("path"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id of the documents as files docs/source/lang/id.txt."""
    rows = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return rows.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_texts(table(spark, sf_dir, "conversations"), F.concat(F.lit("conv/"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit("-"), F.coalesce("role", F.lit("none")), F.lit(".txt")), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_texts(table(spark, sf_dir, "pages"), F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")), "html")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_texts(table(spark, sf_dir, "benchmark"), F.concat(F.lit("bench/"), F.col("item_id"), F.lit(".txt")), "text")


def snapshot_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot: documents and conversations."""
    return documents(spark, sf_dir).drop("doc_id").unionByName(conversations(spark, sf_dir))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind ('remove' or 'fresh') of documents that change: copies of an earlier text go, toxic ones are reviewed."""
    docs = documents(spark, sf_dir).withColumn("digest", F.sha2("content", 256))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    kind = F.when(F.col("doc_id") > F.col("first"), "remove").when(F.col("toxic"), "fresh")
    return docs.join(first, "digest").join(toxic, "doc_id", "left").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def last_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: dir of the conversation with the largest id."""
    return table(spark, sf_dir, "conversations").agg(F.concat(F.lit("conv/"), F.max("conv_id")).alias("dir"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path, kind, local_path: what leads from the first snapshot to the second, with some that a removed folder masks."""
    last = last_conversation(spark, sf_dir)
    gone = last.select(F.col("dir").alias("path"), F.lit("remove").alias("kind"))
    masked = conversations(spark, sf_dir).select("path", parent(F.col("path")).alias("dir")).join(F.broadcast(last), "dir").select("path", F.lit("fresh").alias("kind"))
    new = spark.createDataFrame([("bench", "new"), ("pages", "new")], "path string, kind string")
    rows = reduce(DataFrame.unionByName, [edits(spark, sf_dir), gone, masked, new])
    local = F.when(F.col("kind") != "remove", F.concat(F.lit("/b/"), F.col("path")))
    # in order of path, by ranges: a change list is a log, its numbers only tell the order
    return rows.select(F.xxhash64("path").alias("seq"), "path", "kind", local.alias("local_path"))


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("seq", F.concat_ws(" ", "path", "kind", "local_path").alias("value"))


def snapshot_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot."""
    a = documents(spark, sf_dir).drop("doc_id").join(edits(spark, sf_dir), "path", "left")
    docs = a.where("kind IS NULL OR kind <> 'remove'").select("path", F.when(F.col("kind") == "fresh", F.concat("content", F.encode(F.lit(SUFFIX), "utf-8"))).otherwise(F.col("content")).alias("content"))
    conv = conversations(spark, sf_dir).withColumn("dir", parent(F.col("path"))).join(F.broadcast(last_conversation(spark, sf_dir)), "dir", "left_anti").drop("dir")
    return reduce(DataFrame.unionByName, [docs, conv, pages(spark, sf_dir), benchmark(spark, sf_dir)])
