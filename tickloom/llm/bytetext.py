"""Numpy views of Arrow string columns, and hashes of their words, for code that runs in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space, and tab to carriage return: what separates words.
WORD_BREAK = np.zeros(256, dtype=bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd, so that powers can be undone modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
#: A prime, and a base of powers modulo it: modulo 2**64 alone whole families of strings have one hash, whatever the base.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_299_709_421


def pieces(batch: pa.RecordBatch, column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about `most` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system where the C library can: idle workers would hold on to it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class Powers:
    """Powers of BASE and PRIME_BASE and of their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = self.prime_up = self.prime_down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
            self.prime_up, self.prime_down = (self._modular(b, n) for b in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)))
        return self.up, self.down, self.prime_up, self.prime_down

    @staticmethod
    def _modular(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:  # what is there, times the power that comes next
            more = min(done, n - done)
            out[done : done + more] = _reduced(out[:more] * np.uint64(pow(base, done, PRIME)))
            done += more
        return out


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each units[start:end], units below 2**31; equal spans have equal hashes wherever they stand."""
    up, down, prime_up, prime_down = powers.get(len(units) + 1)
    units = units.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    # Sums of up to 2**33 numbers below the prime stay whole.
    np.cumsum(_reduced(units * prime_up[: len(units)]), out=total[1:])
    return mix(out + mix(_reduced(_reduced(total[ends] - total[starts]) * prime_down[starts])))


def words(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z lower-cased, first word of each row and one past the last)."""
    broken = WORD_BREAK[data]
    edge = np.ones(len(data) + 1, bool)  # a break stands before each row
    edge[1:] = broken
    edge[offsets[:-1]] = True
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(edge[:-1] & ~broken)
    stop = np.ones(len(data), bool)
    stop[:-1] = broken[1:]
    stop[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(stop & ~broken) + 1
    return span_hashes(LOWER[data], starts, ends, powers), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and where each row starts.

    A row with fewer than `width` words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(first) - 1
    count = np.diff(first)
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(many)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    row = np.repeat(np.arange(n), many)
    pos = np.arange(at[-1]) - at[row] + first[row]
    length = np.minimum(count, width)[row]
    key = np.zeros(at[-1], np.uint64)
    for k in range(width):
        inside = k < length
        key = np.where(inside, key * np.uint64(BASE) + hashes[np.minimum(pos + k, len(hashes) - 1)], key)
    key = mix(key + length.astype(np.uint64))
    for i in range(n):
        key[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[at[:-1][many > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])[at]
    return key[fresh], kept
