"""Substring deduplication on words by difference-cover anchors.

A word is removed if a window of WINDOW consecutive words covers it that also starts anywhere else. A difference cover D
modulo a period P has, for any two places i and j, an offset d < P with i + d and j + d both in D modulo P. So only the
runs of WINDOW - P + 1 words at places in D are hashed at first: two equal windows share one of these anchors at the same
offset. Runs that occur twice somewhere are found by an exchange between shards; each match then extends: the windows
that reach over a shared anchor are compared whole, by 128-bit hashes of all their words, in a second exchange.

Defined results: null and empty texts have no words and lose none; repeated rows are documents of their own, so their
windows repeat; texts of any length are taken whole; an empty table gives no rows; columns named like an added one are
replaced, all others pass through. A text that loses nothing stays as it is; one that loses words is its kept words with
one space between (n_words, n_removed and kept_sha256 always describe the kept words joined by one space).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakevault.llm.common import table
from lakevault.llm.shards import KEYS, Keys, Shard, Tree, covered, rows_of, sharded
from lakevault.llm.words import Words, run_hashes

WINDOW = 35
#: Perfect difference covers by their period (fixed values: planar difference sets).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
ADDED = "n_words long, n_removed long, kept_sha256 string"


def period(window: int) -> int:
    """The longest period that leaves anchors of two fifths of a window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)


class Windows:
    """A shard's words, and which places can start a window."""

    def __init__(self, shard: Shard, window: int):
        self.shard, self.window = shard, window
        self.words = words = Words(shard.buf)
        self.first = np.searchsorted(words.begin, shard.begin)
        self.last = np.searchsorted(words.begin, shard.end)
        self.ends = np.repeat(self.last, self.last - self.first)  # of each word's document

    def anchors(self) -> tuple[np.ndarray, Keys]:
        """Places in the cover with room for an anchor, and their keys."""
        p = period(self.window)
        n, length = len(self.words), self.window - p + 1
        at = np.flatnonzero(np.isin(np.arange(p), COVERS[p])[np.arange(n) % p] & (self.ends - np.arange(n) >= length))
        return at, Keys([run_hashes(self.words.hash, length)[at]])

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, Keys]:
        """Windows that a shared anchor lies in, at an offset below the period, and their keys."""
        n, p = len(self.words), period(self.window)
        sums = np.zeros(n + p + 1, np.int32)
        sums[1 : n + 1][shared] = 1
        sums = np.cumsum(sums)
        at = np.flatnonzero((sums[p : n + p] > sums[:n]) & (self.ends - np.arange(n) >= self.window))
        return at, Keys([run_hashes(self.words.hash, self.window, k)[at] for k in (0, 1)])


def deduplicated(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with text shortened, and n_words, n_removed, kept_sha256."""
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    shards = sharded(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), text)
    p = period(window)
    tree = Tree(shards, len(COVERS[p]) / p / 6)
    ranges = tree.ranges

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, keys = Windows(Shard(row, 0x0A), window).anchors()
            yield keys.rows(row["shard"], ranges)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            x = Windows(Shard(row, 0x0A), window)
            at, keys = x.anchors()
            _, keys = x.candidates(at[keys.verdicts(row["hits"], ranges) > 0])
            yield keys.rows(row["shard"], ranges)

    fields = [f for f in docs.schema if f.name != text]
    out = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    arrow = to_arrow_schema(out)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            x = Windows(Shard(row, 0x0A), window)
            at, keys = x.anchors()
            at, keys = x.candidates(at[keys.verdicts(row["hits"], ranges) > 0])
            marked = np.zeros(len(x.words), bool)
            marked[at[keys.verdicts(row["more"], ranges) > 0]] = True
            texts, more = shortened(x, covered(marked, window))
            others = x.shard.others()
            columns = {f.name: others[f.name] for f in fields} | {text: pa.array(texts, pa.string())} | more
            t = pa.table([columns[n] for n in arrow.names], names=arrow.names).cast(arrow)
            yield from t.combine_chunks().to_batches()

    hits = tree.answers(shards.mapInArrow(first, KEYS))
    one = shards.join(hits.hint("shuffle_hash"), "shard", "left")
    more = tree.answers(one.where(F.col("hits").isNotNull()).mapInArrow(second, KEYS)).withColumnRenamed("hits", "more")
    return one.join(more.hint("shuffle_hash"), "shard", "left").mapInArrow(third, out)


def shortened(x: Windows, gone: np.ndarray) -> tuple[list, dict]:
    """The texts without the words that are gone, and what is told of them."""
    shard, words = x.shard, x.words
    lens = words.end - words.begin
    mask = np.zeros(len(shard.buf) + 1, bool)
    mask[: len(shard.buf)][words.inside] = np.repeat(~gone, lens)
    mask[words.end[~gone]] = True  # the byte after a kept word becomes its space
    buf = np.append(shard.buf, np.uint8(0x20))
    buf[words.end] = 0x20
    kept = buf[mask].tobytes()
    size = np.concatenate([[0], np.cumsum((lens + 1) * ~gone)])
    removed = np.concatenate([[0], np.cumsum(gone)])
    texts, shas = [], []
    n_removed = removed[x.last] - removed[x.first]
    whole = shard.buf.tobytes()
    for i, (a, b) in enumerate(zip(size[x.first].tolist(), size[x.last].tolist(), strict=True)):
        piece = kept[a : max(a, b - 1)]
        shas.append(hashlib.sha256(piece).hexdigest())
        texts.append(None if shard.null[i] else piece.decode() if n_removed[i] else whole[shard.begin[i] : shard.end[i]].decode())
    return texts, {"n_words": pa.array(x.last - x.first, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, unnest([array_to_string(w[i:i+34], ' ')]) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY sha256(win)) AS n FROM s) WHERE n > 1),
gone AS (SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM again GROUP BY r),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(g), 0) AS m, list_filter(w, lambda x, j: g IS NULL OR NOT list_contains(g, j)) AS kept FROM d LEFT JOIN gone USING (r))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
