"""Elias-Fano coded monotone sequences and an n-gram trie level built from them, on numpy arrays.

A sequence of n values below u keeps the low bits of each value as they are
(rounded up to whole bytes here) and the high bits in unary: two bits a value.
Counts before every 64 bits answer select in a bounded scan.  All arrays can live in
one memory-mapped file.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

SAMPLE_BYTES = 8
STEP = 1 << 16          # queries handled at once: bounds the scan matrices

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: position of the k-th set bit of a byte (8 where there is none)
_SELECT = np.array([[([p for p in range(8) if i >> p & 1] + [8] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """Monotone values with access, successor and equality search, all over arrays of queries."""

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        bits = max(0, int(universe // max(self.n, 1)).bit_length() - 1)
        self.width = -(-bits // 8)              # low bytes of a value
        shift = np.uint64(8 * self.width)
        high = (values >> shift).astype(np.int64)
        self.buckets = (int(universe) >> (8 * self.width)) + 1
        size = self.n + self.buckets
        ones = np.zeros(-(-size // (8 * SAMPLE_BYTES)) * 8 * SAMPLE_BYTES, np.uint8)
        ones[high + np.arange(self.n)] = 1
        self.upper = np.packbits(ones, bitorder="little")
        self.low = values.view(np.uint8).reshape(-1, 8)[:, :self.width].copy() if self.n else np.zeros((0, self.width), np.uint8)
        per = _POP[self.upper].reshape(-1, SAMPLE_BYTES).sum(axis=1, dtype=np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32 if self.n < 1 << 31 else np.int64)
        self.arrays = ("upper", "low", "ones_before")

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the k-th (from 0) set or clear bit."""
        before = self.ones_before.astype(np.int64)
        if not one:
            before = np.arange(len(before)) * 8 * SAMPLE_BYTES - before
        out = np.empty(len(k), np.int64)
        grid = self.upper.reshape(-1, SAMPLE_BYTES)
        for a in range(0, len(k), STEP):
            q = k[a:a + STEP]
            s = np.searchsorted(before, q, side="right") - 1
            rows = grid[s] if one else ~grid[s]
            cum = np.cumsum(_POP[rows], axis=1, dtype=np.int32)
            left = q - before[s]
            byte = (cum <= left[:, None]).sum(axis=1)
            at = np.arange(len(q))
            left = left - np.where(byte > 0, cum[at, byte - 1], 0)
            out[a:a + STEP] = s * 8 * SAMPLE_BYTES + byte * 8 + _SELECT[rows[at, byte], left]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, :self.width] = self.low[i]
        return out.view(np.uint64).ravel()

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(8 * self.width)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last index of the values with these high bits."""
        end = self._select(high, False) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        return start, end

    def _search(self, x: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None):
        """Index of the first value >= x in x's own bucket (cut to [lo, hi)), the bucket's end, x's low bits."""
        high = np.minimum((x >> np.uint64(8 * self.width)).astype(np.int64), self.buckets - 1)
        a, end = self._bucket(high)
        if lo is not None:
            a, end = np.clip(a, lo, hi), np.clip(end, lo, hi)
        b = end.copy()
        low = x & np.uint64((1 << (8 * self.width)) - 1)
        live = np.flatnonzero(a < b)
        while len(live):  # binary search inside the buckets, all queries at once
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        return a, end, low

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= x among [lo, hi) (``hi`` where there is none); ranges must be
        contiguous in value, as a trie's children are."""
        return self._search(np.asarray(x, np.uint64), lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of x, or -1: its successor, if that lies in x's bucket and has x's low bits."""
        x = np.asarray(x, np.uint64)
        i, end, low = self._search(x, lo, hi)
        out = np.full(len(x), -1, np.int64)
        at = np.flatnonzero(i < end)
        same = self._low(i[at]) == low[at]
        out[at[same]] = i[at[same]]
        return out


def dump(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as bytes, Elias-Fano coded from the least one on: their number, the least, the half bytes
    of a low part, the low parts (whole bytes, then an odd half byte of each, two to a byte) and the high parts."""
    n = len(values)
    if not n:
        return b""
    v = values - values[0]
    halves = -(-max(0, (int(v[-1]) // n).bit_length() - 1) // 4)
    high = (v >> np.uint64(4 * halves)).astype(np.int64) if halves < 16 else np.zeros(n, np.int64)
    ones = np.zeros(n + int(high[-1]), np.uint8)
    ones[high + np.arange(n)] = 1
    each = v.view(np.uint8).reshape(-1, 8)
    odd = np.append(each[:, halves // 2] & 15, np.zeros(n % 2, np.uint8)) if halves % 2 else np.zeros(0, np.uint8)
    return (struct.pack("<QQB", n, int(values[0]), halves) + each[:, :halves // 2].tobytes() + (odd[::2] | odd[1::2] << 4).tobytes()
            + np.packbits(ones, bitorder="little").tobytes())


def load(coded: bytes) -> np.ndarray:
    """The values that ``dump`` coded."""
    if not coded:
        return np.zeros(0, np.uint64)
    n, least, halves = struct.unpack_from("<QQB", coded)
    raw, whole = np.frombuffer(coded, np.uint8, offset=17), n * (halves // 2)
    low = np.zeros((n, 8), np.uint8)
    low[:, :halves // 2] = raw[:whole].reshape(n, halves // 2)
    if halves % 2:
        odd = raw[whole:whole + (n + 1) // 2]
        low[0::2, halves // 2] = odd & 15
        low[1::2, halves // 2] = odd[:n // 2] >> 4
        whole += len(odd)
    values = low.view(np.uint64).ravel()
    if halves < 16:
        ones = np.flatnonzero(np.unpackbits(raw[whole:], bitorder="little"))
        values |= (ones - np.arange(n)).astype(np.uint64) << np.uint64(4 * halves)
    return values + np.uint64(least)


class Level:
    """Children of contexts: contexts and pointers Elias-Fano coded, children stored relative to their
    context's rank so that the whole level is one monotone sequence, and a 16-bit code per child."""

    def __init__(self, context: np.ndarray, child: np.ndarray, code: np.ndarray):
        """(context, child) pairs of 32-bit words, sorted and distinct."""
        first = np.ones(len(context), bool)
        first[1:] = context[1:] != context[:-1]
        heads = np.flatnonzero(first)
        rank = (np.cumsum(first) - 1).astype(np.uint64)
        self.contexts = EliasFano(context[heads], 1 << 32)
        self.pointers = EliasFano(np.append(heads, len(context)), len(context) + 1)
        self.children = EliasFano((rank << np.uint64(32)) | child.astype(np.uint64), max(len(heads), 1) << 32)
        self.code = code.astype(np.uint16)

    def map_to(self, file: BinaryIO) -> "Level":
        """Move all arrays into the file, memory-mapped."""
        parts = [(o, n) for o in (self.contexts, self.pointers, self.children) for n in o.arrays] + [(self, "code")]
        spots = []
        for o, n in parts:
            arr = np.ascontiguousarray(getattr(o, n))
            file.write(b"\0" * (-file.tell() % 8))
            spots.append((o, n, file.tell(), arr.dtype, arr.shape))
            file.write(arr.tobytes())
        file.flush()
        for o, n, at, dtype, shape in spots:
            if 0 not in shape:
                setattr(o, n, np.memmap(file, dtype, "r", at, shape))
        return self

    def codes(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Code of each (context, child), 0 where it isn't stored."""
        out = np.zeros(len(context), np.uint16)
        if not len(self.code) or not len(context):
            return out
        order = np.lexsort((child, context))    # in the trie's order: neighbours share contexts and cache lines
        context, child = context[order], child[order]
        first = np.ones(len(context), bool)
        first[1:] = context[1:] != context[:-1]
        c = self.contexts.find(context[first])
        known = np.flatnonzero(c >= 0)
        ends = self.pointers.access(np.concatenate([c[known], c[known] + 1])).astype(np.int64)
        lo, hi = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        lo[known], hi[known] = ends[:len(known)], ends[len(known):]
        group = np.cumsum(first) - 1
        at = np.flatnonzero(c[group] >= 0)
        g = group[at]
        i = self.children.find((c[g].astype(np.uint64) << np.uint64(32)) | child[at].astype(np.uint64), lo[g], hi[g])
        hit = i >= 0
        out[order[at[hit]]] = self.code[i[hit]]
        return out
