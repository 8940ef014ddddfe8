"""Change lists as streams: each batch of lines becomes a version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lakevault.engine import Engine


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """value, at, file of the lines of text files as they appear in a folder."""
    rows = spark.readStream.format("text").load(folder)
    return rows.select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))


def patches(engine: Engine, tree: str, stream: DataFrame, local: Callable[[DataFrame], DataFrame], name: str = "patches") -> DataStreamWriter:
    """A writer that patches a tree batch by batch, each on the result of the one before.

    local gives local_path, content of the files that a batch of changes names. The repository keeps, under the stream's name,
    the last batch and the tree it led to, so that a stream that starts again from its checkpoint goes on there, and leaves
    out a batch that is done. A batch that failed before that was kept makes the same objects again; its version differs in
    time only. A name belongs to one checkpoint.
    """
    at = f"stream-{name}"

    def run(batch: DataFrame, number: int) -> None:
        last = json.loads(engine._pointer(at) or "null")
        if batch.isEmpty() or last and last["batch"] >= number:
            return
        # later files after earlier ones, and lines in their order
        numbered = batch.withColumn("seq", F.struct("at", "file", F.monotonically_increasing_id()))
        version = engine.patch(last["tree"] if last else tree, numbered, local(batch))
        now = engine.store().versions.where(F.col("version_digest") == version).first()["ver_root"]
        engine._point(at, json.dumps({"batch": number, "tree": now}))

    return stream.writeStream.foreachBatch(run)


def distinct_chunks(stream: DataFrame, path: str) -> DataStreamWriter:
    """A writer that keeps, under path, the chunks (chunk_digest, ...) of a stream that no earlier batch has brought.

    What is known is read from what was written, so no state grows; a batch that is run again replaces its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates(["chunk_digest"])
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            have = spark.read.schema("chunk_digest string, batch long").parquet(path).where(F.col("batch") < number)
            new = new.join(have.select("chunk_digest"), "chunk_digest", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run)
