"""Sets of word shingles, and MinHash values, of whole texts.

A shingle is WORDS consecutive words; a text of fewer words, but at least one, has one shingle of all its words; a null
text, or one without words, has none. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

from lakevault.llm.shards import U64, mixed, released
from lakevault.llm.words import Words, run_hashes

WORDS = 5
#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 2 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, of about CHUNK bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        cuts, size = [0], 0
        for i, n in enumerate(lengths):
            if size and size + n > CHUNK:
                cuts.append(i)
                size = 0
            size += n
        for a, b in zip(cuts, [*cuts[1:], len(lengths)], strict=True):
            if b > a:
                yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]
    released()


class Shingles:
    """hash: all shingles of the texts, in order, repeats included; begin, end: each text's."""

    def __init__(self, texts: list[str], width: int = WORDS):
        raw = [t.encode() for t in texts]
        lens = np.array([len(x) for x in raw], np.int64)
        begin = np.cumsum(lens + 1) - lens - 1
        words = Words(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
        first, last = (np.searchsorted(words.begin, x) for x in (begin, begin + lens))
        self.n_words = n = last - first
        count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.hash = np.empty(int(self.end[-1]) if len(count) else 0, U64)
        runs = run_hashes(words.hash, width)
        full = np.flatnonzero(n >= width)
        at = np.repeat(first[full] - self.begin[full], count[full])
        to = np.repeat(self.begin[full] - (np.cumsum(count[full]) - count[full]), count[full]) + np.arange(count[full].sum())
        self.hash[to] = runs[to + at]
        for k in np.flatnonzero((n > 0) & (n < width)).tolist():
            self.hash[self.begin[k]] = run_hashes(words.hash[first[k] : last[k]], int(n[k]))[0] + U64(n[k])

    def distinct(self, k: int) -> np.ndarray:
        return np.unique(self.hash[self.begin[k] : self.end[k]])


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x632BE59BD9B4E019)) | U64(1)


def minima(hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (rows) of each run of hashes that begins at begin and ends at the next one's begin; no run is empty."""
    out = np.empty((n, len(begin)), np.uint32)
    if len(begin):
        for k, m in enumerate(multipliers(n)):
            out[k] = np.minimum.reduceat(((hashes * m) >> U64(32)).astype(np.uint32), begin)
    return out
