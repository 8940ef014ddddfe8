"""The corpus pipeline over documents: toxicity, near-duplicates, substring deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents; the last adds a
document's copies in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm import leaks, mix, ngram_join, substrings, toxicity
from lakevault.llm.common import new_path, saved, table
from lakevault.session import ship


def rejoined(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """docs that have, or lack, a row in verdicts (id, hash): null ids match, too."""
    same = F.col("stage_docs.doc_id").eqNullSafe(F.col("stage_verdicts.id")) & (F.xxhash64("stage_docs.text") == F.col("stage_verdicts.hash"))
    return docs.alias("stage_docs").join(verdicts.alias("stage_verdicts"), same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. It learns from the labels that are not held out.

    Null and empty texts score 0 and stay; repeated rows are scored alike; without labels all stay; an empty table stays so;
    all columns pass through as they are.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return toxicity.kept(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of the n-gram Jaccard join connect, the one of smallest id, and then of least hash, stays; of repeated rows, one.

    Rows are known by id and text: texts that share an id, or have none, are not copies for that. Null ids come last; texts
    without words are copies of nothing but of rows with the same id and text; of such rows that differ elsewhere, the
    least by all columns stays; an empty table stays so; all columns pass through as they are.
    """
    ship(spark)
    # a few numbers a row, which several queries read
    found = saved(ngram_join.joined(docs).select("doc_id", "text_hash", "group_id", "head_hash"), "groups")
    head = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("head_hash"))
    row = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")]
    gone = found.where(~head).select(*row).distinct()
    again = saved(found.where(head).groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select("id", "hash"), "repeated")
    kept = rejoined(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # by their text as JSON, as not all types have an order
    least = F.min_by(whole, F.to_json(whole)).alias("least_row")
    once = rejoined(kept, again, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(least).select("least_row.*")
    return rejoined(kept, again, "left_anti").unionByName(once)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window covers go, and n_chars follows the text; a document left without words goes.

    Null texts, and texts without words, stay as they are; repeated rows lose all windows they hold; an empty table stays so;
    other columns pass through as they are, whatever their names.
    """
    ship(spark)
    schema = docs.schema
    # by number, so that no name clashes with what the operator adds
    plain = docs.toDF(*(n if n == "text" else f"column{k}" for k, n in enumerate(docs.columns)))
    found = substrings.deduplicated(plain).where("n_words = 0 OR n_removed < n_words")
    size = f"column{docs.columns.index('n_chars')}"
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast(schema["n_chars"].dataType)).otherwise(F.col(size))
    return found.withColumn(size, changed).select(*plain.columns).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay, and so does all if there are no items; repeated rows go or stay together; an empty table stays
    so; all columns pass through as they are.
    """
    ship(spark)
    return leaks.kept(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: what the mix takes of each document.

    Null and empty texts have size 0; a null source is one of its own, last in order; repeated rows are drawn each; an empty
    table gives no rows; other columns are left out.
    """
    ship(spark)
    return mix.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The first stage learns, and the last one draws lots: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return docs
