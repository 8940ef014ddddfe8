"""Documents packed into shards, and an exchange that finds keys which occur more than once among all shards.

A shard is one row with some documents: their texts, one after the other, and their other columns as an Arrow stream,
both compressed. Shards are checkpointed in the shared folder, dealt out by their number; as that partitioning is kept,
what is found out about a shard later comes back to its texts without another shuffle of texts. A document row has no
other identity than its place in its shard, so rows may repeat and ids may be null.

The exchange: a shard sends its distinct keys as sorted runs, once each, however often it has them. Shards meet in a tree:
a node merges the runs of its children, a range of keys at a time, by binary search, and passes one run on, in which a key
that any number of children have is one key again. So no node ever holds more than FAN entries of a key, be it in a third of all
documents. The verdicts come back down the tree in the same way. Ranges are by hash and hold about NODE_KEYS keys, so
they are even whatever the texts are; the tree's depth grows with the logarithm of the number of shards.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevault.llm.common import partitions, pinned, saved

U64 = np.uint64
#: Children of a node of the merge tree, and keys in a node, about.
FAN, NODE_KEYS = 1 << 15, 1 << 19
PARTITION = 64 << 20
SHARDS = "shard long, n_bytes long, lens binary, texts binary, others binary"


def packed(text: str, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = [x.encode() if x is not None else b"" for x in rows[text].to_pylist()]
            lens = np.array([len(x) if x or not null else -1 for x, null in zip(texts, rows[text].is_null().to_pylist(), strict=True)], np.int64)
            others = pa.BufferOutputStream()
            with pa.ipc.new_stream(others, (rest := rows.drop_columns([text])).schema) as w:
                w.write_table(rest)
            whole = b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + k]), pa.array([len(whole)]), pa.array([lens.tobytes()]), pa.array([pa.compress(whole, "zstd", asbytes=True)], pa.binary()), pa.array([len(others.getvalue()).to_bytes(8, "little") + pa.compress(others.getvalue(), "zstd", asbytes=True)], pa.binary())],
                names=["shard", "n_bytes", "lens", "texts", "others"],
            )

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > shard_bytes:
                    held.append(batch.slice(start, i - start))
                    yield out()
                    held, size, start, k = [], 0, i, k + 1
                size += n + 1
            held.append(batch.slice(start))
        if sum(x.num_rows for x in held):
            yield out()

    return run


def sharded(docs: DataFrame, text: str = "text", shard_bytes: int = 2 << 20) -> DataFrame:
    """The shards of docs, checkpointed and partitioned by shard, of about PARTITION bytes of text a partition at most."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return pinned(docs.mapInArrow(packed(text, shard_bytes), SHARDS).repartition(max(partitions(docs.sparkSession), -(-size // PARTITION)), "shard"))


class Shard:
    """A shard's row unpacked. buf: the texts, a separator byte after each; begin, end: where each document lies in it."""

    def __init__(self, row: dict, separator: int):
        lens = np.frombuffer(row["lens"], np.int64)
        self.number, self.null = row["shard"], lens < 0
        lens = np.maximum(lens, 0)
        whole = np.frombuffer(pa.decompress(row["texts"], row["n_bytes"], "zstd", asbytes=True), np.uint8)
        self.begin = np.cumsum(lens + 1) - lens - 1
        self.end = self.begin + lens
        self.buf = np.full(len(whole) + len(lens), separator, np.uint8)
        keep = np.ones(len(self.buf), bool)
        keep[self.end] = False
        self.buf[keep] = whole
        self.raw = row["others"]

    def others(self) -> pa.Table:
        n = int.from_bytes(self.raw[:8], "little")
        return pa.ipc.open_stream(pa.decompress(self.raw[8:], n, "zstd")).read_all()


def released() -> None:
    """Gives memory that is free back to the system: a worker goes on to other tasks, and would keep what its largest one took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
    released()


def in_order(words: list[np.ndarray]) -> np.ndarray:
    """Order by the first word, then by the next ones; the first alone nearly always decides."""
    order = np.argsort(words[0], kind="stable")
    first = words[0][order]
    same = first[1:] == first[:-1]
    if same.any() and any(np.any(same & (w[order][1:] != w[order][:-1])) for w in words[1:]):
        return np.lexsort(words[::-1])
    return order


def as_bytes(words: list[np.ndarray]) -> np.ndarray:
    """Keys of some words each as byte strings, which compare as the words do."""
    return np.ascontiguousarray(np.stack(words, 1).astype(">u8")).view(f"S{8 * len(words)}").ravel()


def spread(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, by which keys are dealt out evenly."""
    words = np.frombuffer(keys.tobytes(), ">u8").reshape(len(keys), keys.itemsize // 8).astype(U64)
    x = np.zeros(len(keys), U64)
    for k in range(words.shape[1]):
        x = mixed(x * U64(0x9E3779B97F4A7C15) + words[:, k] + U64(1))
    return x >> U64(32)


#: What a shard may ask of a key. ALIKE: 0 if no other shard, and nothing else here, has it; 1 if all have it with one detail; else 2.
#: FIRST: 0 likewise; 2 if of those that have it this shard is the one of least number; else 1. The detail is the shard, and goes without saying.
ALIKE, FIRST = 0, 1


class Run:
    """Distinct keys in order. low, high: the least and the greatest detail each was given with; many: given more than once."""

    def __init__(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray):
        self.keys, self.low, self.high, self.many = keys, low, high, many

    def merged(self, other: Run) -> Run:
        """Both: other's keys are placed among this run's by binary search; equal neighbours become one key."""
        if len(other.keys) > len(self.keys):
            self, other = other, self  # noqa: PLW0642
        at = np.searchsorted(self.keys, other.keys)
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == other.keys if len(self.keys) else np.zeros(len(at), bool)
        low, high, many = self.low.copy(), self.high.copy(), self.many.copy()
        here, new = at[same], ~same
        low[here] = np.minimum(low[here], other.low[same])
        high[here] = np.maximum(high[here], other.high[same])
        many[here] = True
        put = lambda x, y: np.insert(x, at[new], y[new])
        return Run(put(self.keys, other.keys), put(low, other.low), put(high, other.high), put(many, other.many))

    def dealt(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys' places by range, in order within each, and where each range begins among them."""
        of = (spread(self.keys) * U64(ranges)) >> U64(32)
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(ranges + 1, dtype=U64))

    def rows(self, child: int, piece: int, ranges: int, group: int = 0, ask: int = ALIKE) -> dict[str, list]:
        """A row for each range that has keys, as in KEYS."""
        out: dict[str, list] = {n: [] for n in ARROW_KEYS.names}
        order, cuts = self.dealt(ranges)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            x = order[cuts[k] : cuts[k + 1]]
            low, high, many = self.low[x], self.high[x], self.many[x]
            row = (group, k, ask, child, piece, self.keys.itemsize, self.keys[x].tobytes(), low.tobytes() if low.any() else b"", b"" if (low == high).all() else high.tobytes(), np.packbits(many).tobytes() if many.any() else b"")
            for n, v in zip(out, row, strict=True):
                out[n].append(v)
        return out

    @staticmethod
    def of(row: dict, ask: int) -> Run:
        keys = np.frombuffer(row["keys"], f"S{row['width']}")
        n = len(keys)
        low = np.frombuffer(row["low"], U64) if row["low"] else np.full(n, row["child"] + 1 if ask == FIRST else 0, U64)
        high = np.frombuffer(row["high"], U64) if row["high"] else low
        return Run(keys, low, high, np.unpackbits(np.frombuffer(row["many"], np.uint8), count=n).astype(bool) if row["many"] else np.zeros(n, bool))

    @staticmethod
    def together(runs: list[Run]) -> Run:
        """All runs merged in pairs, round by round."""
        while len(runs) > 1:
            runs = [runs[k].merged(runs[k + 1]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]


class Keys:
    """The run of the keys of one shard, given in words; place: of each given key in it; first: one given key for each.

    A key is given more than once if it was given for several parts; without parts, if it was given several times.
    order: the given keys in order, where that is known.
    """

    def __init__(self, words: list[np.ndarray], detail: np.ndarray | None = None, part: np.ndarray | None = None, order: np.ndarray | None = None):
        n = len(words[0])
        order = in_order(words) if order is None else order
        new = np.ones(n, bool)
        new[1:] = False
        for w in words:
            new[1:] |= w[order][1:] != w[order][:-1]
        heads = np.flatnonzero(new)
        self.place = np.empty(n, np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.first = order[heads]
        low = high = np.zeros(len(heads), U64)
        many = np.diff(np.append(heads, n)) > 1
        if n and detail is not None:
            low, high = np.minimum.reduceat(detail[order], heads), np.maximum.reduceat(detail[order], heads)
        if n and part is not None:
            many = np.minimum.reduceat(part[order], heads) != np.maximum.reduceat(part[order], heads)
        self.run = Run(as_bytes([w[self.first] for w in words]), low, high, many)

    def rows(self, shard: int, ranges: int, ask: int = ALIKE) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(self.run.rows(shard, 0, ranges, 0, ask), ARROW_KEYS)

    def verdicts(self, hits: list[dict] | None, ranges: int, ask: int = ALIKE) -> np.ndarray:
        """For each given key what was asked of it: see ALIKE and FIRST."""
        return spread_out(self.run, [h for h in hits or [] if h["ask"] == ask], ranges)[self.place]


def spread_out(run: Run, hits: list[dict] | None, ranges: int) -> np.ndarray:
    """A verdict for each key of a run, from the verdicts on its ranges; 0 where none came."""
    out = np.zeros(len(run.keys), np.uint8)
    if hits:
        order, cuts = run.dealt(ranges)
        for h in hits:
            k = h["range"]
            out[order[cuts[k] : cuts[k + 1]]] = np.frombuffer(h["verdicts"], np.uint8)
    return out


#: A child (a shard, or a node of the level below with a piece, its range) tells a node of the tree, which is a group of children and a range of keys, its keys.
KEYS = "grp int, range int, ask int, child long, piece int, width int, keys binary, low binary, high binary, many binary"
ARROW_KEYS = pa.schema([("grp", pa.int32()), ("range", pa.int32()), ("ask", pa.int32()), ("child", pa.int64()), ("piece", pa.int32()), ("width", pa.int32()), *((n, pa.binary()) for n in ("keys", "low", "high", "many"))])
#: What a node answers a child's piece about a range of its keys.
ANSWERS = "child long, piece int, range int, ask int, verdicts binary"
ARROW_ANSWERS = pa.schema([("child", pa.int64()), ("piece", pa.int32()), ("range", pa.int32()), ("ask", pa.int32()), ("verdicts", pa.binary())])


class Tree:
    """The merge tree over the shards: at each level up to FAN children meet in a group, and its keys are cut into ranges of about NODE_KEYS.

    density: keys in a byte of text, about. levels: groups and ranges of each level; a range is cut into a whole number of ranges of the next level.
    """

    def __init__(self, shards: DataFrame, density: float):
        n, size = shards.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        self.parts, keys = shards.rdd.getNumPartitions(), size * density
        groups = max(1, -(-n // FAN))
        self.levels = [(groups, max(1, math.ceil(keys / groups / NODE_KEYS)))]
        while groups > 1:
            groups = -(-groups // FAN)
            ranges = self.levels[-1][1]
            self.levels.append((groups, ranges * max(1, math.ceil(keys / groups / NODE_KEYS / ranges))))

    @property
    def ranges(self) -> int:
        """Of a shard's keys."""
        return self.levels[0][1]

    def answers(self, keys: DataFrame) -> DataFrame:
        """shard, hits: the verdicts on each shard's keys, from rows as in KEYS. Runs are merged upwards, and the verdicts come back the same way."""
        groups = self.levels[0][0]
        rows = [keys.withColumn("grp", F.pmod(F.xxhash64("child"), F.lit(groups)).cast("int"))]
        for _, finer in self.levels[1:]:
            rows.append(saved(rows[-1].groupBy("grp", "range", "ask").applyInArrow(upwards(finer, FAN), KEYS), "runs"))
        found = None
        for level in reversed(range(len(rows))):
            asked = rows[level].withColumn("verdicts", F.lit(None).cast("binary"))
            if found is not None:
                # what the level above says of a node's run, beside what the node's children have told it
                told = found.select(F.col("child").cast("int").alias("grp"), F.col("piece").alias("range"), F.lit(-1).cast("long").alias("child"), F.col("range").alias("piece"), "ask", "verdicts")
                asked = asked.unionByName(told, allowMissingColumns=True)
            finer = self.levels[level + 1][1] if found is not None else 0
            found = asked.groupBy("grp", "range", "ask").applyInArrow(downwards(finer), ANSWERS)
        # dealt out as the shards are, so that they meet without another shuffle
        return pinned(found.withColumnRenamed("child", "shard").repartition(self.parts, "shard").groupBy("shard").agg(F.collect_list(F.struct("range", "ask", "verdicts")).alias("hits")))


def node_runs(rows: pa.Table) -> list[dict]:
    return rows.select(ARROW_KEYS.names).to_pylist()


def upwards(finer: int, fan: int):
    """A node's run, as a child of the level above."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group, piece = key[0].as_py(), key[1].as_py()
        whole = Run.together([Run.of(r, key[2].as_py()) for r in node_runs(rows)])
        return pa.table(whole.rows(group, piece, finer, group // fan, key[2].as_py()), ARROW_KEYS)

    return run


def downwards(finer: int):
    """A node's verdicts for each child's piece: of its own run at the top (finer: 0), else as the level above says of its run, cut into finer ranges."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ask = key[2].as_py()
        told = node_runs(rows)
        verdicts = rows["verdicts"].to_pylist()
        children = [(r, Run.of(r, ask)) for r in told if r["child"] >= 0]
        whole = Run.together([x for _, x in children])
        if finer:
            answer = spread_out(whole, [{"range": r["piece"], "verdicts": v} for r, v in zip(told, verdicts, strict=True) if r["child"] < 0], finer)
        else:
            answer = np.where(whole.many, np.where((whole.low == whole.high) & (ask == ALIKE), 1, 2), 0).astype(np.uint8)
        out: dict[str, list] = {n: [] for n in ARROW_ANSWERS.names}
        if answer.any():
            for r, x in children:
                at = np.searchsorted(whole.keys, x.keys)
                mine = answer[at]
                if ask == FIRST:
                    mine = np.where(x.low == whole.low[at], mine, np.minimum(mine, 1))
                if mine.any():
                    for n, v in zip(out, (r["child"], r["piece"], r["range"], ask, mine.tobytes()), strict=True):
                        out[n].append(v)
        return pa.table(out, ARROW_ANSWERS)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Which places a run of length that begins at a marked start covers; all runs end inside."""
    change = np.zeros(len(starts) + length + 1, np.int32)
    at = np.flatnonzero(starts)
    change[at] += 1
    change[at + length] -= 1
    return np.cumsum(change[: len(starts)]) > 0
