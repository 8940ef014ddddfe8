"""Benchmark decontamination: which documents hold which test items.

The search is for containment: at least THRESHOLD of an item's distinct word shingles are in the document. Items are short
and documents may be long, so that their similarity as sets is tiny. Items of up to SHORT shingles are looked up exactly:
a document that has enough of an item has one of any n - least + 1 of its n shingles, so those that fewest items have are
looked for in the whole text. Longer items have size partitions: they are put in classes of size up to U = 32, 64, ...
shingles, and for each class a document becomes overlapping windows of 2 U shingles, one
for every U. A passage of U shingles then lies in one window whole, at a similarity of 0.19 or more, at any length of the
document. A window and an item are a candidate if one of HASHES MinHash values agrees; 0.81^64 = 1e-6 is the chance that
none does, for an item at the lower end of its class of which only 0.8 is left. Each candidate is verified exactly on the
whole document's shingles. Windows are built from minima of blocks of U, and those from blocks of U / 2, so that each
hash function is applied to each shingle once.

Distinct items are read in blocks whose number follows from their count and words, and one block at a time is broadcast;
ids are joined to what was found. Documents
are not shuffled, and a passage that a third of all documents hold is nobody's group.

Defined results: an item or a text of fewer than five words is one shingle of all its words; items and texts without words
match nothing; repeated rows, ids and items give repeated pairs; null ids stay null; a passage of an item of over SHORT
shingles that is scattered over a document is found if a window holds enough of it; empty tables give no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import n_words, saved, table
from lakevault.llm.shards import U64
from lakevault.llm.shingles import Shingles, chunks, multipliers

THRESHOLD, HASHES = 0.8, 64
#: Shingles of an item that is looked up exactly, the smallest size class, and items and their words in a block at most, about.
SHORT, SMALLEST, BLOCK_ITEMS, BLOCK_WORDS = 16, 32, 20_000, 1 << 21
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
ARROW_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


class Items:
    """The items of a block: their shingles, the rarest ones of short items, and the others by size class, hash function and MinHash value."""

    def __init__(self, ids: list, texts: list, threshold: float = THRESHOLD):
        s = Shingles([t or "" for t in texts])
        self.ids = [i for i, n in zip(ids, s.n_words.tolist(), strict=True) if n]
        self.sets = [s.distinct(k) for k in np.flatnonzero(s.n_words).tolist()]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        short = [k for k, x in enumerate(self.sets) if len(x) <= SHORT]
        self.rare = rarest([self.sets[k] for k in short], np.array(short, np.int64), threshold)
        for k, x in enumerate(self.sets):
            if len(x) > SHORT:
                by.setdefault(max(SMALLEST, 1 << (len(x) - 1).bit_length()), []).append(k)
        ms = multipliers(HASHES)
        for size, ks in by.items():
            values = np.stack([((self.sets[k][None, :] * ms[:, None]) >> U64(32)).astype(np.uint32).min(1) for k in ks], 1)
            order = np.argsort(values, axis=1, kind="stable")
            self.classes[size] = np.take_along_axis(values, order, 1), np.array(ks)[order]
        # which low bits occur at all, by class and hash function
        self.seen = {}
        for size, (values, _) in self.classes.items():
            self.seen[size] = np.zeros((HASHES, 1 << 16), bool)
            for k in range(HASHES):
                self.seen[size][k, values[k] & 0xFFFF] = True


def rarest(sets: list[np.ndarray], which: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and the item of each: of each item as many that no text without any of them has enough of it."""
    if not sets:
        return np.empty(0, U64), np.empty(0, np.int64)
    sizes = np.array([len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    freq, first = count[at], np.cumsum(sizes) - sizes
    keys, items = [], []
    for x, a, k in zip(sets, first.tolist(), which.tolist(), strict=True):
        least = next((m for m in range(1, len(x)) if m >= threshold * len(x)), len(x))
        some = x[np.argsort(freq[a : a + len(x)], kind="stable")[: len(x) - least + 1]]
        keys.append(some)
        items.append(np.full(len(some), k))
    key, item = np.concatenate(keys), np.concatenate(items)
    order = np.argsort(key, kind="stable")
    return key[order], item[order]


def windows(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's blocks of this size begin, and the text of each."""
    n = -(-(end - begin) // size)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return begin[text] + (np.arange(len(text)) - first[text]) * size, text


def candidates(s: Shingles, items: Items) -> set[tuple[int, int]]:
    """(text, item) pairs of which a rare shingle of a short item, or one MinHash value in some window, agrees."""
    found: set[tuple[int, int]] = set()
    sizes = sorted(items.classes)
    if not len(s.hash):
        return found
    key, item = items.rare
    if len(key):
        lo = np.searchsorted(key, s.hash, "left")
        at = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == s.hash)
        lo, hi, text = lo[at], np.searchsorted(key, s.hash[at], "right"), np.searchsorted(s.end, at, "right")
        for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True):
            found.update((t, int(i)) for i in item[a:b])
    if not sizes:
        return found
    levels, size = [], SMALLEST
    while size <= sizes[-1]:
        levels.append((size, *windows(s.begin, s.end, size)))
        size *= 2
    joins = []  # how blocks of one level are two of the level below
    for (_, low, _), (_, high, _) in zip(levels, levels[1:], strict=False):
        joins.append(np.searchsorted(low, high))
    for k, m in enumerate(multipliers(HASHES)):
        values = ((s.hash * m) >> U64(32)).astype(np.uint32)
        least = np.minimum.reduceat(values, levels[0][1])
        for depth, (size, _, text) in enumerate(levels):
            if depth:
                least = np.minimum.reduceat(least, joins[depth - 1])
            if size not in items.classes:
                continue
            window = least.copy()  # a block and the next one of the same text
            same = text[1:] == text[:-1]
            window[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
            at = np.flatnonzero(items.seen[size][k, window & 0xFFFF])
            if not len(at):
                continue
            known, which = items.classes[size][0][k], items.classes[size][1][k]
            lo, hi = np.searchsorted(known, window[at], "left"), np.searchsorted(known, window[at], "right")
            for t, a, b in zip(text[at[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((t, int(i)) for i in which[a:b])
    return found


def verified(s: Shingles, items: Items, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shingles of the item, of which the text has) of the pairs that contain enough."""
    last, mine = -1, None
    for t, i in sorted(candidates(s, items)):
        if t != last:
            last, mine = t, s.distinct(t)
        x = items.sets[i]
        at = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
        both = int((mine[at] == x).sum())
        if both >= threshold * len(x):
            yield t, i, len(x), both


def searching(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch, texts in chunks(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[t], items.ids[i], n, both, both / n) for t, i, n, both in verified(Shingles(texts), items, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW_PAIRS)], schema=ARROW_PAIRS)

    return run


def distinct(items: DataFrame) -> DataFrame:
    """number, text of the distinct texts of items, nulls left out."""
    return saved(items.where("text IS NOT NULL").select("text").distinct().withColumn("number", F.monotonically_increasing_id()), "items")


def blocks(texts: DataFrame, threshold: float = THRESHOLD) -> Iterator:
    """Texts (number, text), each once, in broadcasts of a bounded size each."""
    spark = texts.sparkSession
    n, words = texts.agg(F.count("*"), F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0))).first()
    count = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(words / BLOCK_WORDS))
    for k in range(count):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).select("number", "text").collect()
        yield spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], threshold))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: a row for each document that holds an item of items (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts, found = distinct(items), None
    for shared in blocks(texts, threshold):
        one = docs.mapInArrow(searching(shared, threshold), PAIRS).withColumnRenamed("item_id", "number")
        found = one if found is None else found.unionByName(one)
    ids = items.select(F.col("item_id").cast("long").alias("item_id"), "text").join(texts, "text").select("item_id", "number")
    return found.join(ids, "number").select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def kept(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches):
                bad = {t for t, *_ in verified(Shingles(texts), shared.value, threshold)}
                yield batch.filter(pa.array([t not in bad for t in range(len(texts))], pa.bool_()))

        return run

    for shared in blocks(distinct(items), threshold):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT q, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT q, count(*) AS n FROM bs GROUP BY q),
k AS (SELECT r, q, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY r, q)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, k::BIGINT AS n_shared, k / n AS containment
FROM k JOIN n USING (q) JOIN d USING (r) JOIN b USING (q) WHERE k >= 0.8 * n
"""
