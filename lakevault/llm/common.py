"""What the operators of this subpackage share: the shared work folder, durable intermediate tables, tables by name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, in Java's and in DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; unset, a folder of our own in local mode alone."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "/tmp/checkpoints/lakevault"
            sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and what was nondeterministic is fixed."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for frames that nothing reads any more: what came of them is saved itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than this part of all rows is dealt out to so many tasks.
SHARE, SALTS = 1 / 512, 64


def met(rows: DataFrame, facts: DataFrame, key: str, by: str, total: float) -> DataFrame:
    """rows joined with facts (key, n, ...; a row for each key, n: how many rows have it) on key, without n.

    total: rows, about, or more. Rows of frequent keys are dealt out by the column by, and their facts to all parts. No more
    than 1 / SHARE keys can be frequent, so they are broadcast.
    """
    frequent = F.col("n") > total * SHARE
    some = F.broadcast(facts.where(frequent).select(F.col(key).alias("frequent_key")))
    salt = F.when(F.col("frequent_key").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(some, F.col(key) == F.col("frequent_key"), "left").withColumn("salt", salt).drop("frequent_key")
    parts = F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    return dealt.join(facts.select("*", parts).drop("n"), [key, "salt"]).drop("salt")


def pinned(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder, with its partitioning known: joins on that need no shuffle.

    An adaptive plan doesn't tell its partitioning, so for this one job adaptive planning is off.
    """
    spark = df.sparkSession
    work_dir(spark)
    key = "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        # planned anew, as the plan of df may have been made before
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(key, was)
