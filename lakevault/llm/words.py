"""Hashes of words, and of runs of words, by array operations on UTF-8 bytes.

A word's hash is the sum of pseudorandom values of its (place, byte) pairs. A run's hash is a polynomial in its words'
hashes modulo 2^64, taken from prefix sums: the value of a run depends on its words alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np

from lakevault.llm.shards import U64, mixed

TABLE_PLACES = 64
_table: np.ndarray | None = None
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Odd multipliers of the run hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def table() -> np.ndarray:
    global _table
    if _table is None:
        _table = mixed(np.arange(1, 1 + 256 * TABLE_PLACES, dtype=U64) * U64(0xA0761D6478BD642F))
    return _table


class Words:
    """The words of a buffer: begin, end (bytes), hash. A word is a run of bytes other than ASCII white space."""

    def __init__(self, buf: np.ndarray):
        inside = (buf != 0x20) & ((buf - np.uint8(9)) > 4)  # unsigned: 9 to 13 become 0 to 4
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.inside = inside
        if not len(self.begin):
            self.hash = np.empty(0, U64)
            return
        lens = self.end - self.begin
        firsts = np.cumsum(lens) - lens
        chars = buf[inside]
        place = (np.arange(len(chars), dtype=np.int32) - np.repeat(firsts.astype(np.int32), lens))
        if lens.max() <= TABLE_PLACES:
            values = table()[(place << 8) + chars]
        else:
            values = mixed((1 + (place.astype(np.int64) << 8) + chars).astype(U64) * U64(0xA0761D6478BD642F))
        self.hash = mixed(np.add.reduceat(values, firsts) + lens.astype(U64))

    def __len__(self) -> int:
        return len(self.begin)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and their inverses modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[base]
    return up, down


def run_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of the run of length words from each word on; there are len(hashes) - length + 1."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = powers(BASES[which], len(hashes))
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * down[:n])
