"""Jaccard similarity join on word shingles, with Bayesian pruning of candidates.

1. Every text gets its set of shingles, known by 128 bits, and HASHES MinHash values. Texts of equal sets form a class;
   from here on one document stands for a class, with the number of its copies.
2. Classes that agree in ROWS values of one of HASHES / ROWS bands are linked as possible neighbours. Connected components
   of these links say which classes must be compared; a large component is cut into blocks by size, and pairs of blocks
   are the units of work. A class's set is sent once for a small component, and for a large one once for each block that
   holds a possible neighbour of its own; where a band has more than FEW classes, once for each block that has this band
   or another such one. So in a long chain a set is sent a few times, however long it is, and never once for each pair.
3. In a unit, pairs compare MinHash values STEP by STEP. With a uniform prior, the posterior of a similarity s after m
   matches of n is Beta(m + 1, n - m + 1), so P(s >= t) is the probability that a binomial of n + 1 trials with success t is at
   most m. A pair is dropped once that falls below TOLERANCE. What remains is verified exactly on the sets of shingles.
4. A unit tells for each class how many documents it is linked to, and a forest that joins linked classes; links themselves
   are not sent. Sums and connected components of the forests give the result.

A pair of similarity 0.8 is missed by all bands with a probability of 4e-8.

Defined results: texts without words link with nothing and are classes of their own; repeated rows and repeated ids are
documents of their own; a null id stays null; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import dropped, met, partitions, saved, table
from lakevault.llm.components import components
from lakevault.llm.shards import U64, mixed, rows_of
from lakevault.llm.shingles import Shingles, chunks, minima

THRESHOLD, TOLERANCE = 0.8, 1e-7
HASHES, ROWS, STEP = 72, 3, 8
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 19
#: Classes of a band whose neighbours are looked up one by one.
FEW = 64

#: In a unit, rows of side 0 are compared to those of side 1, and rows of side SELF to each other.
SELF = 2

SIGNED = "doc_id long, text_hash long, n long, c1 long, c2 long, sig binary"
ARROW_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.binary())])


def set_hash(distinct: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, by sums over its members."""
    a, b = mixed(distinct + U64(0x9E3779B97F4A7C15)).sum(dtype=U64), mixed(distinct ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        s = Shingles(texts)
        some = np.flatnonzero(s.end > s.begin)
        values = np.ascontiguousarray(minima(s.hash, s.begin[some], HASHES).T)
        out = {"n": [0] * len(texts), "c1": [None] * len(texts), "c2": [None] * len(texts), "sig": [None] * len(texts)}
        for i, k in enumerate(some.tolist()):
            d = s.distinct(k)
            out["n"][k] = len(d)
            out["c1"][k], out["c2"][k] = set_hash(d)
            out["sig"][k] = values[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[f.name], f.type) for f in ARROW_SIGNED if f.name in out)], schema=ARROW_SIGNED)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (columns) of each signature (rows)."""
    n, bands = len(values), HASHES // ROWS
    x = values.astype(U64).reshape(n, bands, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=U64)), (n, bands))
    for k in range(ROWS):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key.view(np.int64)


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = band_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "cid"])


def needed(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of matches of n values at which the posterior of the threshold is not below the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def linked_pairs(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of left x right, i before j, whose sets are similar."""
    need = [(n, needed(n, threshold)) for n in range(STEP, HASHES + 1, STEP)]
    sizes = np.array([len(x) for x in sets])
    members: dict[int, frozenset] = {}

    def members_of(k: int) -> frozenset:
        if (x := members.get(k)) is None:
            x = members[k] = frozenset(sets[k].tolist())
        return x

    a, b = [], []
    for i in left.tolist():
        js = right[right > i] if left is right else right
        js = js[(sizes[js] >= threshold * sizes[i]) & (sizes[js] * threshold <= sizes[i])]
        match = np.zeros(len(js), np.int32)
        for n, least in need:
            if not len(js):
                break
            match += (sigs[js, n - STEP : n] == sigs[i, n - STEP : n]).sum(1, dtype=np.int32)
            live = match >= least
            js, match = js[live], match[live]
        if len(js):
            x, n = members_of(i), sizes[i]
            for j in js.tolist():
                both = len(x & members_of(j))
                if both >= threshold * (n + sizes[j] - both):
                    a.append(i)
                    b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return label
        label = new


TOLD = "cid long, links long, parent long"
ARROW_TOLD = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, cid, copies, sig, shingles), sorted by unit, to what each unit tells of its classes."""
    held: dict[int, tuple] = {}
    now = None

    def out() -> pa.RecordBatch:
        cids = np.array(list(held), np.int64)
        side, copies, sigs, sets = zip(*held.values(), strict=True)
        side, copies = np.array(side), np.array(copies, np.int64)
        values = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)
        arrays = [np.frombuffer(x, U64) for x in sets]
        left = np.flatnonzero(side != 1)
        a, b = linked_pairs(values, arrays, left, left if (side == SELF).any() else np.flatnonzero(side == 1))
        links = np.bincount(a, copies[b], len(cids)) + np.bincount(b, copies[a], len(cids))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.array(links[some].astype(np.int64)), pa.array(cids[forest(len(cids), a, b)[some]])], schema=ARROW_TOLD)

    for row in rows_of(batches):
        if row["unit"] != now:
            if len(held) > 1:
                yield out()
            held, now = {}, row["unit"]
        held[row["cid"]] = (row["side"], row["copies"], row["sig"], row["shingles"])
    if len(held) > 1:
        yield out()


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shingles of texts, a packed array, in place of the text."""
    for batch, texts in chunks(batches):
        s = Shingles(texts)
        cols = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([s.distinct(k).tobytes() for k in range(len(texts))], pa.binary())], names=[*names, "shingles"])


def placed(near: DataFrame, members: DataFrame) -> DataFrame:
    """cid, unit, side: where the sets of classes meet. near: key, cid of bands; members: cid, root, block, blocks."""
    alone = members.where("blocks = 1").select("cid", F.concat_ws(" ", "root").alias("unit"), F.lit(SELF).alias("side"))
    there = saved(near.join(members.where("blocks > 1").select("cid", "root", "block"), "cid").select("key", "cid", "root", "block"), "blocks")
    here = there.groupBy("key", "root", "block").agg(F.count("*").alias("n"))
    sizes = here.groupBy("key").agg(F.sum("n").alias("size"))
    few, many = sizes.where(F.col("size") <= FEW).select("key"), saved(sizes.where(F.col("size") > FEW).select("key"), "keys")
    other = here.select("key", F.col("block").alias("other"), "n")
    # a class alone in its block with a band meets nobody there
    one = there.join(few, "key").join(other, "key").where("block <> other OR n > 1").select("cid", "root", "block", "other")
    dense = here.join(many, "key")
    pairs = dense.select("key", "root", "block").join(other, "key").select("root", "block", "other").distinct()
    each = there.join(many, "key").select("cid", "root", "block").distinct().join(pairs, ["root", "block"]).select("cid", "root", "block", "other")
    unit = F.concat_ws(" ", "root", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), SELF).otherwise((F.col("block") > F.col("other")).cast("int"))
    return alone.unionByName(one.unionByName(each).distinct().select("cid", unit.alias("unit"), side.alias("side")))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, group_id, head_hash for each row of docs (doc_id, text).

    class_id is the smallest id of the documents with an equal set of shingles, group_id that of all which links connect;
    n_links counts the other documents with a similarity of THRESHOLD or more, copies included.
    head_hash is the least text_hash under group_id among the rows of a group: both say which row stands for it, as an id may be
    in several groups.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = saved(docs.mapInArrow(signed, SIGNED), "signatures")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bands = classes.select("cid", "sig").mapInArrow(banded, "key long, cid long")
    least = bands.groupBy("key").agg(F.min("cid").alias("low"), F.count("*").alias("n")).where("n > 1")
    near = saved(met(bands, least, "key", "cid", classes.count() * HASHES / ROWS), "bands")
    tree = components(near.where("cid <> low").select("cid", "low"))
    members = tree.join(classes, F.col("node") == F.col("cid")).select("cid", "root", "copies", "n", "sig", "c1", "c2", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("th"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = members.groupBy("root").agg(blocks.alias("blocks"))
    members = members.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = saved(members, "members")
    work = placed(near, members)
    # null ids match, too
    wanted = members.select("cid", "copies", "sig", F.col("id").alias("mid"), "th")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("mid")) & (F.col("text_hash") == F.col("th"))).select("cid", "copies", "sig", "text")
    sets = texts.mapInArrow(with_sets, "cid long, copies long, sig binary, shingles binary")
    told = sets.join(work, "cid").select("unit", "side", "cid", "copies", "sig", "shingles").repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(units, TOLD)
    told = saved(told, "links")
    dropped(near, members)
    links = told.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(told.where("cid <> parent").select("cid", "parent"))
    ids = groups.join(classes, F.col("node") == F.col("cid")).select("root", "cid", "least", "head")
    smallest = ids.groupBy("root").agg(F.min("least").alias("smallest"), F.min("head").alias("first"), F.count("*").alias("n"))
    per = met(ids, smallest, "root", "cid", groups.count()).select("cid", "smallest", "first").join(links, "cid")
    result = classes.select("c1", "c2", "cid", "least", "head", "copies").join(per, "cid", "left").select(
        "c1", "c2", F.col("least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("group_id"), F.coalesce("first", "head")["text_hash"].alias("head_hash")
    )
    return rows.join(result, ["c1", "c2"], "left").select(
        "doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("head_hash", "text_hash").alias("head_hash")
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("text_hash", "head_hash")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
h AS (SELECT r, hash(s) AS s FROM g),
n AS (SELECT r, count(*) AS n, sum(s::HUGEINT) AS total, bit_xor(hash(s)) AS x FROM h GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM h a JOIN h b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= 0.8 * (x.n + y.n - k)),
deg AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
classes AS (SELECT n.r, min(d.doc_id) OVER (PARTITION BY n.n, n.total, n.x) AS class_id FROM n JOIN d ON d.r = n.r)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, d.doc_id) AS group_id
FROM d LEFT JOIN deg USING (r) LEFT JOIN classes USING (r) LEFT JOIN (
  WITH RECURSIVE reach AS (SELECT a AS r, a AS m FROM links UNION SELECT l.b, reach.m FROM reach JOIN links l ON l.a = reach.r)
  SELECT reach.r, min(doc_id) AS group_id FROM reach JOIN d ON d.r = reach.m GROUP BY reach.r) c USING (r)
"""
