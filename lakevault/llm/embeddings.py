"""Near-duplicate embeddings by cross-polytope hashing.

Vectors of equal components form a class, of which one goes on with the number of its copies. In each of several tables a
vector is rotated at random (three rounds of random signs and a fast Hadamard transform) and hashed to the signed
coordinate axis it is nearest to, PARTS of them for one bucket; the PROBES next ones are probed as well. How many parts
and tables there are follows from the number of classes, so that a bucket holds about BUCKET of them and a pair at the
threshold is missed by all tables with an estimated probability of MISS. All vectors of a bucket are compared in double
precision; a bucket with more than CHUNK vectors is cut into chunks, and pairs of chunks are the units of work. A pair
counts in the first bucket it meets in only, which both vectors' codes tell; so a unit reports sums and a forest that
joins what is linked, never pairs, and nothing has to be made distinct afterwards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths are never linked; repeated rows are vectors of their own; a null id
stays null; labels and other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import met, partitions, saved, table
from lakevault.llm.components import components
from lakevault.llm.ngram_join import SELF, forest
from lakevault.llm.shards import U64, mixed, rows_of

THRESHOLD = 0.95
BUCKET, CHUNK, PROBES, MISS = 1024, 2048, 2, 1e-4
#: What a dot product of unit vectors in single precision may be off by, with room.
SLACK = 1e-4
#: The estimated chance that two vectors at the threshold share one of PROBES axes.
SHARED = 0.72

CLEAN = "vec_id long, c1 long, c2 long, vector binary"
ARROW_CLEAN = pa.schema([("vec_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("vector", pa.binary())])


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as packed doubles with 128 bits to know them by; nulls in place of others."""
    for batch in batches:
        out = {"c1": [], "c2": [], "vector": []}
        for x in batch.column(1):
            v = np.array([np.nan if y is None else y for y in x.as_py()], np.float64) if x.is_valid else np.empty(0)
            if not len(v) or not np.isfinite(v).all() or not v.any():
                for c in out.values():
                    c.append(None)
                continue
            v = v + 0.0  # no negative zeros
            bits = v.view(U64)
            k = np.arange(1, len(v) + 1, dtype=U64)
            for c, m in (("c1", 0x9E3779B97F4A7C15), ("c2", 0xD6E8FEB86659FD93)):
                out[c].append(int(mixed(mixed(bits + k * U64(m)).sum(dtype=U64).reshape(1))[0].view(np.int64)))
            out["vector"].append(v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, ARROW_CLEAN.field(c).type) for c, v in out.items())], schema=ARROW_CLEAN)


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, parts: int, probes: int = PROBES) -> np.ndarray:
    """(vectors, tables, probes) bucket numbers. x: rows of unit length. Beyond one part, a probe changes the part whose next axis is nearest."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        best, gaps = [], []
        for p in range(parts):
            y = padded
            for k in range(3):
                signs = 1.0 - 2.0 * (mixed(np.arange(d, dtype=U64) + U64(((t * 64 + p) * 3 + k + 1) << 20)) & U64(1)).astype(np.float64)
                y = hadamard(y * signs)
            both = np.concatenate([y, -y], 1)
            top = np.argpartition(-both, min(probes, 2 * d) - 1, axis=1)[:, : min(probes, 2 * d)]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, 1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            best.append(top)
            gaps.append((value[:, :1] - value) / np.maximum(value[:, :1], 1e-300))
        first = np.zeros(len(x), np.int64)
        for p in range(parts):
            first = first * (2 * d) + best[p][:, 0]
        # single changes of one part, nearest first
        choices, costs = [], []
        for p in range(parts):
            for j in range(1, best[p].shape[1]):
                choices.append(first + (best[p][:, j] - best[p][:, 0]) * (2 * d) ** (parts - 1 - p))
                costs.append(gaps[p][:, j])
        out[:, t, 0] = first
        if probes > 1:
            if not choices:
                out[:, t, 1:] = first[:, None]
                continue
            order = np.argsort(np.stack(costs, 1), 1, kind="stable")[:, : probes - 1]
            out[:, t, 1 : 1 + order.shape[1]] = np.take_along_axis(np.stack(choices, 1), order, 1)
            out[:, t, 1 + order.shape[1] :] = first[:, None]
    return out


def plan(classes: int, dim: int, miss: float = MISS, shared: float = SHARED) -> tuple[int, int]:
    """Parts and tables."""
    axes = 2 << max(0, (dim - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(1, classes / BUCKET)) / math.log(axes)))
    return parts, math.ceil(math.log(miss) / math.log(1 - shared**parts))


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    # scaled first: squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucketed(tables: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cid, vectors = part.column(0).to_numpy(), part.column(1).to_pylist()
                x = codes(unit_rows(vectors), tables, parts)
                n, t, p = x.shape
                keep = np.ones((n, t, p), bool)
                for j in range(1, p):
                    keep[:, :, j] = (x[:, :, j : j + 1] != x[:, :, :j]).all(2)
                who, tab, _ = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(tab.astype(np.int32)), pa.array(x[keep]), pa.array(cid[who])], names=["tab", "key", "cid"])

    return run


TOLD = "cid long, links long, parent long"
ARROW_TOLD = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def compared(tables: int, parts: int, threshold: float):
    """Rows (unit, tab, key, side, cid, copies, vector), sorted by unit, to what each unit tells of its classes."""

    def out(tab: int, key: int, held: dict) -> pa.RecordBatch:
        cids = np.array(list(held), np.int64)
        side, copies, vectors = zip(*held.values(), strict=True)
        side, copies, x = np.array(side), np.array(copies, np.int64), unit_rows(list(vectors))
        left = np.flatnonzero(side != 1)
        right = left if (side == SELF).any() else np.flatnonzero(side == 1)
        single = x.astype(np.float32)
        others = np.ascontiguousarray(single[right].T)
        mine: np.ndarray | None = None
        links, label = np.zeros(len(cids), np.int64), np.arange(len(cids))
        for start in range(0, len(left), 512):
            rows = left[start : start + 512]
            # single precision sorts out; double precision decides
            i, j = np.nonzero(single[rows] @ others >= np.float32(threshold - SLACK))
            i, j = rows[i], right[j]
            if left is right:
                i, j = i[i < j], j[i < j]
            near_ = np.concatenate([(x[i[s : s + 65536]] * x[j[s : s + 65536]]).sum(1) >= threshold for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[near_], j[near_]
            if not len(i):
                continue
            if mine is None:
                mine = codes(x, tables, parts)
            keep = np.empty(len(i), bool)
            for s in range(0, len(i), 65536):
                a, b = mine[i[s : s + 65536]], mine[j[s : s + 65536]]
                same = a[:, :, :, None] == b[:, :, None, :]
                met = same.any((2, 3))
                first = met.argmax(1)
                at = np.arange(len(a))
                low = np.where(same[at, first].any(2), a[at, first], np.iinfo(np.int64).max).min(1)
                keep[s : s + 65536] = (first == tab) & (low == key)
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = np.minimum(label, forest(len(cids), np.concatenate([i, np.arange(len(cids))]), np.concatenate([j, label])))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.array(links[some]), pa.array(cids[label[some]])], schema=ARROW_TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        now = None
        for row in rows_of(batches):
            if row["unit"] != now:
                if len(held) > 1:
                    yield out(*place, held)
                held, now = {}, row["unit"]
            place = row["tab"], row["key"]
            held[row["cid"]] = (row["side"], row["copies"], row["vector"])
        if len(held) > 1:
            yield out(*place, held)

    return run


def near(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(cleaned, CLEAN), "vectors")
    classes = rows.where(F.col("vector").isNotNull()).groupBy("c1", "c2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "vector-classes")
    told = None
    # vectors of one table nearly always have one length
    for dim, count in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        parts, tables = plan(count, dim, miss)
        of = classes.where(F.col("dim") == dim).select("cid", "copies", "vector")
        keys = saved(of.select("cid", "vector").mapInArrow(bucketed(tables, parts), "tab int, key long, cid long"), "buckets")
        sizes = keys.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / CHUNK).cast("int"))
        dealt = keys.join(sizes.select("tab", "key", "pieces"), ["tab", "key"]).withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
        # a chunk meets itself and each other chunk once
        others = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
        each = dealt.select("tab", "key", "cid", "piece", others)
        unit = F.concat_ws(" ", "tab", "key", F.least("piece", "other"), F.greatest("piece", "other"))
        side = F.when(F.col("piece") == F.col("other"), SELF).otherwise((F.col("piece") > F.col("other")).cast("int"))
        work = each.select("cid", "tab", "key", unit.alias("unit"), side.alias("side"))
        joined = work.join(of, "cid").repartition(n, "unit").sortWithinPartitions("unit")
        one = joined.select("unit", "tab", "key", "side", "cid", "copies", "vector").mapInArrow(compared(tables, parts, threshold), TOLD)
        told = one if told is None else told.unionByName(one)
    if told is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    told = saved(told, "vector-links")
    links = told.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(told.where("cid <> parent").select("cid", "parent"))
    ids = groups.join(classes, F.col("node") == F.col("cid")).select("root", "cid", "least")
    smallest = ids.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("n"))
    per = met(ids, smallest, "root", "cid", groups.count()).select("cid", "smallest").join(links, "cid")
    result = classes.join(per, "cid", "left").select("c1", "c2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    out = rows.select("vec_id", "c1", "c2").join(result, ["c1", "c2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
deg AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
comp AS (WITH RECURSIVE reach AS (SELECT a AS r, a AS m FROM links UNION SELECT l.b, reach.m FROM reach JOIN links l ON l.a = reach.r)
  SELECT reach.r, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.m GROUP BY reach.r)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN deg USING (r) LEFT JOIN comp USING (r)
"""
