"""Suffix-array deduplication of byte strings.

A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else. Documents are packed into shards.

1. Each shard sorts its suffixes: by their first bytes, then by Larsson and Sadakane's refinement, which sorts only groups
   that are still equal, by the rank of the suffix a doubled distance on. Kasai's common prefixes of neighbours follow in
   text order: where the bytes before a suffix and before its neighbour agree, the length is one less than the one before,
   elsewhere bytes are compared. A prefix of LENGTH or more marks both starts.
2. Across shards, equal strings meet at anchors. Of the SEED-byte grams in a LENGTH-byte string the one with the least hash is
   its anchor; equal strings have the same one at the same place. The suffixes at anchors, packed to their first 8 bytes and
   64 bits of their first SEED, are a shard's run: they are taken in the order of its suffix array. Runs of all shards are
   merged by binary search, up a tree, a range at a time; equal neighbours say which anchors several shards have, and whether
   their stretches, the texts of all strings with that anchor, are all the same. If so, all these strings repeat, and nothing
   more is sent.
3. Where stretches differ, runs are refined and merged again: of blocks of strings by what all strings of a block have in
   common, and, where blocks still differ, of the strings themselves, by 128 bits of each. Both go up the same tree. Of
   shards with an equal stretch, or block, the first one alone goes on, for the others. So a passage that a third of all
   documents share is one key a shard, one key from the tree's first level on, and its parts are sent once.

Defined results: null texts are empty and lose nothing; strings never span documents; repeated rows are documents of their
own, so their strings repeat; texts of any length are taken whole, in pieces that overlap; an empty table gives no rows;
columns named like an added one are replaced, others pass through, without the text.
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

from lakevault.llm.common import pinned, saved, table
from lakevault.llm.shards import ALIKE, ARROW_KEYS, FIRST, KEYS, U64, Keys, Run, Shard, Tree, covered, in_order, mixed, rows_of, sharded

LENGTH, SEED = 200, 32
#: Bytes in a shard, and in one suffix array at most: rank, rank and place of a suffix must fit 64 bits.
SHARD, ARRAY = (1 << 20) - (1 << 14), (1 << 20) - 1
BITS = 20
#: A block is a part of a string's length in strings.
BLOCKS = 6
SEPARATOR = 0xFF  # no byte of UTF-8
ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of at most ARRAY bytes."""
    n = len(text)
    if n > ARRAY:
        raise ValueError("text too long for one suffix array")
    if n < 2:
        return np.arange(n)
    codes = np.zeros(256, U64)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    codes[used] = np.arange(1, len(used) + 1, dtype=U64)
    bits = int(len(used)).bit_length()
    width = max(1, (64 - BITS) // bits)
    padded = np.concatenate([codes[text], np.zeros(width, U64)])
    key = np.zeros(n, U64)
    for k in range(width):
        key = (key << U64(bits)) | padded[k : k + n]
    place = U64((1 << BITS) - 1)
    key = (key << U64(BITS)) | np.arange(n, dtype=U64)
    key.sort()
    order = (key & place).astype(np.int64)
    slots = np.arange(n)
    head = key >> U64(BITS)
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    far = width
    open_ = ~(new & np.append(new[1:], True))
    slots = slots[open_]
    while len(slots):
        at = order[slots]
        group = rank[at]
        key = (group.astype(U64) << U64(2 * BITS)) | ((rank[np.minimum(at + far, n)] + 1).astype(U64) << U64(BITS)) | at.astype(U64)
        key.sort()
        at = (key & place).astype(np.int64)
        head = key >> U64(BITS)
        new = np.ones(len(key), bool)
        new[1:] = head[1:] != head[:-1]
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        open_ = ~(new & np.append(new[1:], True))
        slots = slots[open_]
        far *= 2
    return order


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text) + 1,), "<u8", padded.tobytes(), strides=(1,))


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the suffix before it in order (-1: none), and the length of the prefix they have in common."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    known = (before > 0) & (places > 0)
    known[known] = text[places[known] - 1] == text[before[known] - 1]
    lanes = np.flatnonzero(~known)
    start = np.zeros(n, np.int64)
    live = lanes[before[lanes] >= 0]
    words, off = words_at(text), 0
    other = before[live]
    while len(live):
        x = words[np.minimum(live + off, n)] ^ words[np.minimum(other + off, n)]
        end = x != 0
        done = off + (np.bitwise_count((x[end] & (~x[end] + U64(1))) - U64(1)).astype(np.int64) >> 3)
        start[live[end]] = np.minimum(done, n - np.maximum(live[end], other[end]))
        live, other = live[~end], other[~end]
        off += 8
        over = np.maximum(live, other) + off >= n
        start[live[over]] = n - np.maximum(live[over], other[over])
        live, other = live[~over], other[~over]
    latest = np.maximum.accumulate(np.where(known, 0, places))
    return before, np.where(before >= 0, np.maximum(start[latest] - (places - latest), 0), 0)


def repeated(text: np.ndarray, order: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which starts of strings of this length, among those with room for one, some other start equals."""
    out = np.zeros(len(text), bool)
    if len(text) < 2 or not room.any():
        return out
    before, common = common_prefixes(text, order)
    at = np.flatnonzero((common >= length) & room)
    out[at] = True
    out[before[at]] = True
    return out & room


class Pieces:
    """A shard's buffer, cut into overlapping pieces that one suffix array can hold; each start with room belongs to one."""

    def __init__(self, shard: Shard, length: int):
        self.shard, self.length = shard, length
        n = len(shard.buf)
        #: Starts with room for a whole string.
        change = np.zeros(n + 1, np.int8)
        fits = shard.end - shard.begin >= length
        change[shard.begin[fits]] += 1
        change[shard.end[fits] - length + 1] -= 1
        self.room = np.cumsum(change[:n], dtype=np.int8) > 0
        step = ARRAY - length + 1
        self.cuts = [(a, min(a + step, n), min(a + ARRAY, n)) for a in range(0, n, step)]

    def own(self, anchors: np.ndarray, detail: np.ndarray) -> tuple[np.ndarray, Run]:
        """Marked starts, by each piece's suffix array and common prefixes; and the run of the suffixes at anchors, in that order."""
        marked = np.zeros(len(self.shard.buf), bool)
        runs = [Keys(prefixes(self.shard.buf, anchors[:0])).run]
        for k, (a, _, c) in enumerate(self.cuts):
            text, room = self.shard.buf[a:c], self.room[a:c] & (np.arange(a, c) + self.length <= c)
            if not room.any():
                continue
            order = suffix_array(text)
            marked[a:c] |= repeated(text, order, room, self.length)
            mine = np.flatnonzero(self.piece == k)
            which = np.full(c - a, -1, np.int64)
            which[anchors[mine] - a] = np.arange(len(mine))
            found = which[order]
            order, words = found[found >= 0], prefixes(self.shard.buf, anchors[mine])
            order = order[in_order([w[order] for w in words])]  # nothing moves but what the first 8 bytes leave open
            runs.append(Keys(words, detail[mine], np.zeros(len(mine)), order).run)
        return marked, Run.together(runs)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of starts with the same anchor: first start, last start, the anchor's place. self.piece: which piece each is of."""
        firsts, lasts, anchors, pieces = [], [], [], []
        for piece, (a, b, c) in enumerate(self.cuts):
            text, room = self.shard.buf[a:c], self.room[a:b]
            if not room.any():
                continue
            words = words_at(text)
            n = len(text) - SEED + 1
            if n <= 0:
                continue
            gram = mixed(words[:n] * U64(0x9E3779B97F4A7C15) + mixed(words[8 : n + 8] + U64(1)))
            gram = mixed(gram + words[16 : n + 16] * U64(0xD6E8FEB86659FD93)) ^ words[24 : n + 24]
            gram = mixed(gram)
            # ties, and hashes that agree in their upper bits, go to the left
            least = (gram & ~U64((1 << BITS) - 1)) | np.arange(n, dtype=U64)
            wide, have = self.length - SEED + 1, 1
            while have * 2 <= wide:
                least = np.minimum(least[:-have], least[have:]) if len(least) > have else least[:0]
                have *= 2
            if wide > have:
                least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :]) if len(least) > wide - have else least[:0]
            at = np.flatnonzero(room[: len(least)])
            chosen = (least[at] & U64((1 << BITS) - 1)).astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(at) != 1)
            head = np.flatnonzero(new)
            firsts.append(at[head] + a)
            lasts.append(at[np.append(head[1:], len(at)) - 1] + a)
            anchors.append(chosen[head] + a)
            pieces.append(np.full(len(head), piece))
        whole = lambda x: np.concatenate([np.empty(0, np.int64), *x])
        self.piece = whole(pieces)
        return whole(firsts), whole(lasts), whole(anchors)


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(marked.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1).astype(np.int64), np.flatnonzero(edge == -1).astype(np.int64)


def string_hashes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the strings at these starts."""
    words = words_at(text)
    a, b = np.zeros(len(starts), U64), np.zeros(len(starts), U64)
    for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        w = words[starts + off]
        a = mixed(a + w * U64(0x9E3779B97F4A7C15) + U64(off + 1))
        b = mixed((b ^ w) * U64(0xD6E8FEB86659FD93) + U64(off + 1))
    return a, b


def prefixes(text: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The first 8 bytes from each place on, as numbers that compare as the bytes do, and 64 bits of the first SEED."""
    return [words_at(text)[places].byteswap(), string_hashes(text, places, SEED)[0]]


def spans_told(text: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """128 bits of the text of each run of starts, and of where it lies to its anchor: the first and the last string tell them."""
    (a, b), (c, d) = (string_hashes(text, x, length) for x in (firsts, lasts))
    place = mixed(((anchors - firsts).astype(U64) << U64(32)) | (anchors - lasts).astype(U64))
    return [mixed(a + mixed(c + place)) | U64(1), mixed(b + mixed(d + place))]


def blocks(firsts: np.ndarray, lasts: np.ndarray, anchors: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Stretches cut into blocks of at most width starts, by distance to the anchor: stretch, first start, last start, number of the block."""
    near, far = anchors - lasts, anchors - firsts
    n = far // width - near // width + 1
    of = np.repeat(np.arange(len(n)), n)
    number = (near // width)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, anchors[of] - np.minimum(far[of], number * width + width - 1), anchors[of] - np.maximum(near[of], number * width), number


class Search:
    """What a shard asks the others, step by step: about anchors, about stretches where some differ, about blocks of those that
    go on, and about strings of blocks where some differ. What a step settles is marked.
    """

    def __init__(self, shard: Shard, stretches: np.ndarray, length: int):
        self.shard, self.length, self.width = shard, length, max(1, length // BLOCKS)
        self.firsts, self.lasts, self.anchors, self.piece = stretches.astype(np.int64)
        self.change = np.zeros(len(shard.buf) + 1, np.int32)

    def mark(self, firsts: np.ndarray, lasts: np.ndarray) -> None:
        np.add.at(self.change, firsts, 1)
        np.add.at(self.change, lasts + 1, -1)

    def questions(self) -> Iterator[list[tuple[Keys, int]] | None]:
        """Yields a step's keys and what is asked of them, and takes the verdicts; None after the last step."""
        text, length, width = self.shard.buf, self.length, self.width
        firsts, lasts, anchors, part = self.firsts, self.lasts, self.anchors, self.piece
        whole = spans_told(text, firsts, lasts, anchors, length)
        (alike,) = yield [(Keys(prefixes(text, anchors), whole[0], part), ALIKE)]
        self.mark(firsts[alike == 1], lasts[alike == 1])
        at = np.flatnonzero(alike == 2)
        firsts, lasts, anchors, part = firsts[at], lasts[at], anchors[at], part[at]
        (first,) = yield [(Keys([x[at] for x in whole], None, part), FIRST)]
        self.mark(firsts[first > 0], lasts[first > 0])
        at = np.flatnonzero(first != 1)
        of, firsts, lasts, number = blocks(firsts[at], lasts[at], anchors[at], width)
        anchors, part = anchors[at][of], part[at][of]
        # all strings of a whole block have these bytes in common, wherever a stretch cuts it off
        a, b = string_hashes(text, anchors - number * width, length - width + 1)
        whole = spans_told(text, firsts, lasts, anchors, length)
        alike, first = yield [(Keys([mixed(a + mixed(number.astype(U64) + U64(1))), b], whole[0], part), ALIKE), (Keys(whole, None, part), FIRST)]
        done = (alike == 1) | (first > 0)
        self.mark(firsts[done], lasts[done])
        at = np.flatnonzero((alike == 2) & (first != 1))
        n = (lasts - firsts + 1)[at]
        starts = np.repeat(firsts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        (again,) = yield [(Keys(list(string_hashes(text, starts, length)), None, np.repeat(part[at], n)), ALIKE)]
        self.mark(starts[again > 0], starts[again > 0])
        yield None

    def asking(self, hits: list[list[dict] | None], ranges: list[int]) -> list[tuple[Keys, int]] | None:
        """What is asked after so many answers."""
        steps = self.questions()
        now = next(steps)
        for h, r in zip(hits, ranges, strict=False):
            now = steps.send([keys.verdicts(h, r, ask) for keys, ask in now])
        return now


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The other columns of docs, and n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept."""
    if length < SEED:
        raise ValueError(f"strings of at least {SEED} bytes are asked for")
    docs = docs.drop(*[f.name for f in T.StructType.fromDDL(ADDED) if f.name != text])
    shards = sharded(docs, text, SHARD)
    # keys in a byte: of anchors, of stretches, of blocks of half of all strings, and of a sixteenth of all strings
    anchors = 2 / (length - SEED + 2)
    trees = [Tree(shards, x) for x in (anchors, anchors, BLOCKS / length, 1 / 16)]
    ranges = [t.ranges for t in trees]

    def search(row: dict) -> Search:
        return Search(Shard(row, SEPARATOR), np.frombuffer(row["stretches"], np.int32).reshape(4, -1), length)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            x = Pieces(shard := Shard(row, SEPARATOR), length)
            firsts, lasts, anchors = x.stretches()
            marked, run = x.own(anchors, spans_told(shard.buf, firsts, lasts, anchors, length)[0])
            out = run.rows(row["shard"], 0, ranges[0])
            begin, end = runs(marked)
            stretches = np.stack([firsts, lasts, anchors, x.piece]).astype(np.int32)
            for n, v in zip(out, (-1, -1, -1, row["shard"], 0, 0, begin.tobytes(), end.tobytes(), stretches.tobytes(), b""), strict=True):
                out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, ARROW_KEYS)

    def asked(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                for keys, ask in search(row).asking([row[f"hits{k}"] for k in range(step)], ranges):
                    yield keys.rows(row["shard"], ranges[step], ask)

        return run

    fields = [f for f in docs.schema if f.name != text]
    out_type = T.StructType([*fields, *T.StructType.fromDDL(ADDED).fields])
    arrow = to_arrow_schema(out_type)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            x = search(row)
            if row["hits0"]:
                x.asking([row[f"hits{k}"] for k in range(len(trees))], ranges)
            np.add.at(x.change, np.frombuffer(row["begins"], np.int64), 1)
            np.add.at(x.change, np.frombuffer(row["ends"], np.int64), -1)
            gone = covered(np.cumsum(x.change[:-1]) > 0, length)
            others, more = x.shard.others(), told(x.shard, gone)
            t = pa.table([others[n] if n in others.column_names else more[n] for n in arrow.names], names=arrow.names).cast(arrow)
            yield from t.combine_chunks().to_batches()

    found = saved(shards.mapInArrow(first, KEYS), "suffixes")
    own = found.where("range < 0").select(F.col("child").alias("shard"), F.col("keys").alias("begins"), F.col("low").alias("ends"), F.col("high").alias("stretches"))
    own = pinned(own.repartition(trees[0].parts, "shard"))
    rows, asks = shards.join(own.hint("shuffle_hash"), "shard"), found.where("range >= 0")
    for step, tree in enumerate(trees):
        if step:
            asks = rows.where("hits0 IS NOT NULL").mapInArrow(asked(step), KEYS)
        rows = rows.join(tree.answers(asks).withColumnRenamed("hits", f"hits{step}").hint("shuffle_hash"), "shard", "left")
    return rows.mapInArrow(last, out_type)


def told(shard: Shard, gone: np.ndarray) -> dict[str, pa.Array]:
    keep = ~gone
    keep[shard.end] = False
    kept = shard.buf[keep]
    sums = np.concatenate([[0], np.cumsum(keep)])
    a, b = sums[shard.begin], sums[shard.end]
    # covered never marks separators, so that a run never spans documents
    edges = np.concatenate([[0], np.cumsum(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1)])
    data = kept.tobytes()
    pieces = [data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    n = shard.end - shard.begin
    return {
        "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(n - (b - a), pa.int64()), "n_spans": pa.array(edges[shard.end] - edges[shard.begin], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()), "kept": pa.array(pieces, pa.binary()),
    }


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).drop("kept")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, sha256(array_slice(b, i, i + 199)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
islands AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM islands GROUP BY r, g),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS p FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS tail, string_agg(CASE WHEN a > p THEN hex(array_slice(b, p, a - 1)) ELSE '' END, '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept || CASE WHEN tail <= octet_length(b) THEN hex(array_slice(b, tail, octet_length(b))) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
