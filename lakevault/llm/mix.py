"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words by its weight, capped at MOST times what it has; what a cap cuts off is shared
again by weight. A document then has the fractional copy probability target / source size. Whole copies are given at
once. The fractions are rounded in pairs: of two partners with fractions, one gives word mass to the other until one of
them is integral, which way by lot, so that each keeps its expectation and the two together keep their words. In a bucket
of documents the partner of the largest one is the pool of all smaller ones, whose common fraction takes up the mass, as
long as the pool can; what the pool can't settle is paired one by one. So the one document at most that is left of each
bucket is a small one. The leftovers of FAN buckets are rounded together, and so on up a tree, until one document of the
source is left, rounded by a last draw. A source's words miss its target by less than the size of that one document.

The draws follow from the seed, the source and the bucket alone, and a bucket's rows are sorted first: neither the
cluster nor the order of rows matters, and reruns agree.

Defined results: null text and text without words have size 0 and take 0 words; a null source is a source of its own,
last in order; repeated rows are separate documents (the same one may be taken in different numbers); null doc_id is a
value like any other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakevault.llm.common import n_words, saved, table

#: A document's copies at most, and so a target's limit as a multiple of its source's size.
MOST = 3
#: Documents in a bucket, about; leftovers of how many buckets meet on the next level of the tree.
BUCKET, FAN = 4096, 512
EPS = 1e-9


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, n, target from (source, source_size, n): by weights 1, 2, 3, repeating in order of source, null last.

    A source's share grows with a common level until it meets its cap. In order of cap / weight the capped sources come
    first, so the level follows from running sums. The frame has a row for each source.
    """
    by_name = Window.partitionBy().orderBy(F.asc_nulls_last("source"))
    by_cap = Window.partitionBy().orderBy("ratio", F.asc_nulls_last("source"))
    all_of = Window.partitionBy()
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", (1 + (F.row_number().over(by_name) - 1) % 3).cast("double")).withColumn("cap", most * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(all_of))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    # the level of the first source that is not capped holds for all that follow
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(all_of)["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size", "n",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).cast("double").alias("target"),
    )


def pivot(rows: list[tuple[int, float]], draw: random.Random) -> tuple[list[int], int, float]:
    """Rounds (size, fraction) rows in the given order: 0 or 1 for each row, the place of the row left over (-1: none) and its fraction."""
    given, at, q, w = [0] * len(rows), -1, 0.0, 0
    for j, (size, p) in enumerate(rows):
        if p <= EPS or not size:
            continue
        if p >= 1 - EPS:
            given[j] = 1
            continue
        if at < 0:
            at, q, w = j, p, size
            continue
        up, down = min((1 - q) * w, p * size), min(q * w, (1 - p) * size)
        mass = up if draw.random() * (up + down) < down else -down
        q, p = q + mass / w, p - mass / size
        for place, x in ((at, q), (j, p)):
            if x >= 1 - EPS:
                given[place] = 1
        if EPS < q < 1 - EPS:
            continue
        at, q, w = (j, p, size) if EPS < p < 1 - EPS else (-1, 0.0, 0)
    return given, at, q


def pooled(sizes: list[int], p: float, draw: random.Random) -> tuple[list[int], list[tuple[int, float]]]:
    """Rounds documents of one fraction, largest first, against the pool of those after them: 0 or 1 for each, and (place, fraction) of those left open."""
    given, open_, rest = [0] * len(sizes), [], sum(sizes)
    for j, w in enumerate(sizes):
        rest -= w
        if p <= EPS or p >= 1 - EPS:
            given[j] = int(p > 0.5)
        elif rest and (1 - p) * w <= p * rest and p * w <= (1 - p) * rest:
            if draw.random() < p:
                given[j] = 1
                p -= (1 - p) * w / rest
            else:
                p += p * w / rest
        else:
            open_.append((j, p))
    return given, open_


def seeded(*key: object) -> random.Random:
    return random.Random(hashlib.sha256(repr(key).encode()).digest())


#: Rows that meet in a bucket or on a higher level; left marks the one whose copies are not known yet.
ROUNDED = "source string, bucket long, doc_id long, k long, size long, copies long, fraction double, left boolean"


def rounded(seed: int, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("k", "ascending")])
        sizes, fractions = rows["size"].to_pylist(), rows["fraction"].to_pylist()
        draw = seeded(seed, level, key[0].as_py(), key[1].as_py())
        given, open_ = pooled(sizes, fractions[0], draw) if not level else ([0] * len(sizes), list(enumerate(fractions)))
        settled, at, q = pivot([(sizes[j], p) for j, p in open_], draw)
        for (j, _), g in zip(open_, settled, strict=True):
            given[j] += g
        at = open_[at][0] if at >= 0 else -1
        copies = [c + g for c, g in zip(rows["copies"].to_pylist(), given, strict=True)]
        left = [i == at for i in range(len(copies))]
        values = {"copies": pa.array(copies, pa.int64()), "fraction": pa.array([q if x else 0.0 for x in left], pa.float64()), "left": pa.array(left, pa.bool_())}
        return pa.table({c: values.get(c, rows[c] if c in rows.column_names else None) for c in ("source", "bucket", "doc_id", "k", "size", "copies", "fraction", "left")})

    return run


def mix(docs: DataFrame, seed: int = 7, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    # repeated rows are counted and told apart by number, so that a row's bucket follows from its values
    rows = docs.select("source", "doc_id", n_words(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    rows = saved(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("double").alias("source_size"), F.sum("times").alias("n"))
    goals = saved(targets(sizes, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    goal = goals.select(F.col("source").alias("s"), rate.alias("rate"), parts.alias("parts"))
    each = rows.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("k"))
    joined = each.join(goal, F.col("source").eqNullSafe(F.col("s")))
    dealt = joined.select(
        "source", F.pmod(F.xxhash64("doc_id", "size", "k"), "parts").alias("bucket"), "doc_id", "k", "size",
        F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"),
    )
    first = saved(dealt.groupBy("source", "bucket").applyInArrow(rounded(seed, 0), ROUNDED), "mix-0")
    settled, waiting, level = [], first.where("left"), 1
    most_buckets = goals.agg(F.max(F.ceil(F.col("n") / BUCKET))).first()[0] or 1
    while most_buckets > 1:
        up = waiting.select("source", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), "doc_id", "k", "size", "copies", "fraction")
        met = saved(up.groupBy("source", "bucket").applyInArrow(rounded(seed, level), ROUNDED), f"mix-{level}")
        settled.append(met.where(~F.col("left")))
        waiting, most_buckets, level = met.where("left"), -(-most_buckets // FAN), level + 1

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            x["copies"] = [c + (seeded(seed, "last", s, d, k).random() < q) for s, d, k, c, q in zip(x["source"], x["doc_id"], x["k"], x["copies"], x["fraction"], strict=True)]
            yield pa.RecordBatch.from_pydict(x, schema=batch.schema)

    settled.append(waiting.mapInArrow(last, ROUNDED))
    done = first.where(~F.col("left"))
    for x in settled:
        done = done.unionByName(x)
    g = goals.select(F.col("source").alias("s"), F.col("source_size").cast("long").alias("source_size"), "target")
    return done.join(g, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")
