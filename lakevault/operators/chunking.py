"""Files to chunks, chunks to file objects, and what of them is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakevault.functions.digests import EMPTY, IV_BYTES, digest
from lakevault.functions.gear import GearConfig, chunk_column


def fixed_spans(size: Column, step: int) -> Column:
    """array<struct<begin, end>> of pieces of a fixed size; the last may be shorter."""
    n = F.ceil(size / step).cast("int")
    spans = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k * step).cast("long").alias("begin"), F.least((k + 1) * step, size).cast("long").alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))


def chunks(files: DataFrame, cut: GearConfig | int = GearConfig()) -> DataFrame:
    """path, ordinal, begin, end, size, chunk_digest, chunk of files (path, content); cut: a config, or a fixed size."""
    spans = fixed_spans(F.octet_length("content"), cut) if isinstance(cut, int) else chunk_column(F.col("content"), cut)
    rows = files.select("path", "content", F.posexplode(spans).alias("ordinal", "span"))
    size = (F.col("span.end") - F.col("span.begin")).alias("size")
    piece = F.substring("content", (F.col("span.begin") + 1).cast("int"), (F.col("span.end") - F.col("span.begin")).cast("int"))
    return rows.select("path", "ordinal", "span.begin", "span.end", size, digest(piece).alias("chunk_digest"), piece.alias("chunk"))


def file_digest(ordered: Column) -> Column:
    """Of the raw digests of chunks, in order."""
    return digest(F.unhex(F.array_join(ordered, "")))


def file_objects(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """path, file_digest, n_chunks, size; a file without chunks is there, too. pieces: as chunks() gives them, content not needed."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_digest"))), lambda x: x["chunk_digest"])
    found = pieces.groupBy("path").agg(file_digest(listed).alias("file_digest"), F.count("*").alias("n_chunks"), F.sum("size").alias("size"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("file_digest", F.lit(EMPTY)).alias("file_digest"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def unique(objects: DataFrame, *keys: str) -> DataFrame:
    return objects.dropDuplicates(list(keys))


def new_objects(objects: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each object once that is not stored yet: digests meet first, contents follow by a semi join."""
    fresh = objects.select(key).distinct().join(stored.select(key), key, "left_anti")
    return unique(objects.join(fresh, key, "left_semi"), key)


def dedup_report(pieces: DataFrame) -> DataFrame:
    """Chunks and bytes in all, and of distinct chunks."""
    per = pieces.groupBy("chunk_digest").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count("*").alias("distinct_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("distinct_bytes"),
    )


def stored_size(size: Column) -> Column:
    return size + IV_BYTES


def reassembled(file_chunks: DataFrame, stored: DataFrame, by: str = "file_digest") -> DataFrame:
    """by, content: chunks joined by digest, put in order. Empty files have no chunks and no row."""
    parts = file_chunks.join(stored.select("chunk_digest", "content"), "chunk_digest")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "content")))
    # each byte as one character, as only strings can be joined
    return parts.groupBy(by).agg(F.encode(F.array_join(F.transform(ordered, lambda x: F.decode(x["content"], "ISO-8859-1")), ""), "ISO-8859-1").alias("content"))


def offsets(file_chunks: DataFrame, by: str = "file_digest") -> DataFrame:
    """file_chunks with begin, from the sizes of the chunks before."""
    w = Window.partitionBy(by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return file_chunks.withColumn("begin", F.coalesce(F.sum("size").over(w), F.lit(0)))
