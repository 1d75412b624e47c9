"""Exact repeated-substring removal by distributed prefix doubling over a sparse set of positions.

A byte goes where a ``threshold``-byte string covering it also starts earlier
(smaller doc_id, or earlier in the same document).  As in prefix doubling,
positions are ranked by ever longer prefixes, shuffled and sorted as rank
pairs, and leave as soon as their rank is unique; ranking ends past the
threshold.  Ranking every byte position would shuffle dozens of times the
input, so the first round (32-byte prefixes) ranks one position per window:

32 bytes  Every window of ``threshold`` bytes elects the position inside it whose
          32-byte prefix has the least hash.  Equal windows elect at the same
          offset, so a window can only repeat where its elected prefix does:
          unique ranks leave.  Where the whole surrounding string (all windows that
          elect the position) occurs earlier, its windows are settled as repeats,
          and where all repeats have the same surroundings the first one is.
64 bytes  The same among the windows left (at edits and edges of repeats), with
          prefixes ranked by the pair (rank32(i), rank32(i + 32)).
threshold Windows still left are ranked whole, by 128-bit digest: what is equal now
          is a repeat, and the smallest (doc_id, start) stays.

Ranks are 64-bit names of the strings, so that no round needs another one's
numbers; a name that two strings share by chance keeps a window in the next
round and decides nothing.  Defined cases: null and empty texts have no bytes; rows that repeat a
doc_id count as later documents, in block order; an empty table gives an
empty result; further columns are not read; matches never cross documents.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from . import chunks as C

THRESHOLD = 100
BASES = (32, 64)        # bytes ranked per round before the threshold itself
SEGMENT = 1 << 18       # window starts handled at once: bounds memory on very long texts
NONE, FIRST, LATER, OPEN = 0, 1, 2, 3   # what a round says of a pair

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), 77) for i in range(256)], np.uint64)


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Name of the pair of names (a, b)."""
    x = a * _ODD[level % 8] + b * _ODD[(level + 3) % 8]
    x ^= x >> np.uint64(32)
    x *= _ODD[(level + 5) % 8]
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, base: int) -> np.ndarray:
    """64-bit names of the strings of ``base`` bytes (a power of two) starting at every position, by doubling."""
    h, span, level = _BYTE[data], 1, 0
    while span < base:
        h = _pair(h[:-span], h[span:], level) if len(h) > span else h[:0]
        span, level = span * 2, level + 1
    return h


def _evenly(x: np.ndarray) -> np.ndarray:
    """A bijection of names: elected ones are the least, and shards split the range of names evenly."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[7]
    x = (x ^ (x >> np.uint64(27))) * _ODD[6]
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the inclusive ranges."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inclusive ranges of sorted distinct integers."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return (at[np.concatenate([[0], cut])], at[np.append(cut, len(at)) - 1]) if len(at) else (at, at)


def elected(block: C.Block, threshold: int, base: int, windows: tuple[np.ndarray, np.ndarray] | None = None):
    """Runs of windows electing one position: (first start, last start, position, its name); of all windows
    or those in the given ranges of starts."""
    data = np.frombuffer(block.data, np.uint8) if block.data else np.zeros(0, np.uint8)
    if windows is None:
        has = np.flatnonzero(block.offs[1:] - block.offs[:-1] >= threshold)
        windows = block.offs[:-1][has], block.offs[1:][has] - threshold
    open_at = np.zeros(len(data) + 1, np.int8)
    np.add.at(open_at, windows[0], 1)
    np.add.at(open_at, windows[1] + 1, -1)
    is_open = np.cumsum(open_at, dtype=np.int8) > 0
    out = []
    for seg in range(0, len(data) - threshold + 1, SEGMENT):
        stop = min(seg + SEGMENT, len(data) - threshold + 1)
        start = np.flatnonzero(is_open[seg:stop])
        if not len(start):
            continue
        name = names(data[seg:stop + threshold - 1], base)
        key = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
        at = (_sliding_min(key, threshold - base + 1)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(start)) - 1
        out.append((start[first] + seg, start[end] + seg, at[first] + seg, _evenly(name[at[first]])))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


class Round:
    """Elected positions of a block and their distinct (name, surrounding string) pairs, sorted by name."""

    def __init__(self, block: C.Block, threshold: int, base: int, windows=None):
        self.lo, self.hi, self.at, self.name = elected(block, threshold, base, windows)
        raw, dig = block.data, xxhash.xxh3_64_intdigest
        around = np.array([dig(raw[a:b], c) for a, b, c in zip(
            self.lo.tolist(), (self.hi + threshold).tolist(), (self.at - self.lo).tolist())], np.uint64)
        row = np.searchsorted(block.offs, self.lo, side="right") - 1
        doc = block.ids[row] if len(row) else np.zeros(0, np.int64)
        self.order = np.lexsort((self.lo, doc, around, self.name))
        name, around, doc = self.name[self.order], around[self.order], doc[self.order]
        self.new = np.ones(len(name), bool)     # first occurrence of its pair in this block
        self.new[1:] = (name[1:] != name[:-1]) | (around[1:] != around[:-1])
        heads = np.flatnonzero(self.new)
        self.group = np.cumsum(self.new) - 1
        self.names, self.around, self.doc = name[heads], around[heads], doc[heads]
        self.many = (np.diff(np.append(heads, len(name))) > 1).astype(np.uint8)

    def payload(self, a: int, b: int) -> bytes:
        return (np.int64(b - a).tobytes() + self.names[a:b].tobytes() + self.around[a:b].tobytes()
                + C.squeeze(self.doc[a:b].tobytes() + self.many[a:b].tobytes()))


def _unpack(p: bytes):
    k = int(np.frombuffer(p[:8], np.int64)[0])
    rest = C.unsqueeze(p[8 + 16 * k:])
    return (np.frombuffer(p, np.uint64, k, 8), np.frombuffer(p, np.uint64, k, 8 + 8 * k),
            np.frombuffer(rest, np.int64, k), np.frombuffer(rest, np.uint8, k, 8 * k))


def merge(payloads: list[bytes], blocks: list[int]) -> list[bytes]:
    """Per pair: NONE where its name occurs once in the corpus; else LATER where the pair occurs in an earlier
    block; else FIRST, or OPEN where the name also stands in other surroundings."""
    parts = [_unpack(p) for p in payloads]
    n = [len(p[0]) for p in parts]
    name, around, doc, many = (np.concatenate(c) for c in zip(*parts))
    src = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((src, doc, around, name))
    name, around, many = name[order], around[order], many[order]
    new_name, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_name[1:] = name[1:] != name[:-1]
    new[1:] = new_name[1:] | (around[1:] != around[:-1])
    group = np.cumsum(new_name) - 1
    contexts = np.bincount(group, new)
    total = np.bincount(group, 1 + many)
    code = np.where(total[group] == 1, NONE, np.where(~new, LATER, np.where(contexts[group] > 1, OPEN, FIRST)))
    out = np.empty(len(order), np.uint8)
    out[order] = code
    return [C.squeeze(x.tobytes()) for x in np.split(out, np.cumsum(n)[:-1])]


def _codes(answers: pd.DataFrame, shards: int, keys: np.ndarray) -> np.ndarray:
    b = C.by_shard(keys, shards)
    out = np.zeros(len(keys), np.uint8)
    for s, payload in zip(answers.shard, answers.payload):
        out[b[s]:b[s + 1]] = np.frombuffer(C.unsqueeze(payload), np.uint8)
    return out


def settle_round(r: Round, code: np.ndarray):
    """(ranges of window starts settled as repeats, ranges of windows still open)."""
    code = code[r.group]
    gone = r.order[(code == LATER) | ~r.new]    # a second occurrence of a pair in this block repeats the first
    left = np.sort(r.order[(code == OPEN) & r.new])
    return (r.lo[gone], r.hi[gone]), (r.lo[left], r.hi[left])


def _state(block: int, *what) -> tuple[int, int, bytes]:
    return -1, block, C.squeeze(pickle.dumps(what))


def _read_state(rows: pd.DataFrame):
    return pickle.loads(C.unsqueeze(rows[rows.shard == -1].payload.iloc[0]))


def round64(block: C.Block, answers: pd.DataFrame, shards: int, threshold: int) -> pd.DataFrame:
    """After the first round: its state, and what the second asks."""
    r = Round(block, threshold, BASES[0])
    done, left = settle_round(r, _codes(answers, shards, r.names))
    r = Round(block, threshold, BASES[1], left)
    out = [_state(block.id, done, left)]
    C.ask_rows(out, block.id, r.names, shards, r.payload)
    return pd.DataFrame(out, columns=["shard", "block", "payload"])


def last_round(block: C.Block, rows: pd.DataFrame, shards: int, threshold: int) -> pd.DataFrame:
    """After the second round: its state, and the digests of the windows left."""
    done, left = _read_state(rows)
    r = Round(block, threshold, BASES[1], left)
    more, left = settle_round(r, _codes(rows[rows.shard >= 0], shards, r.names))
    wins = _spread(*left)
    raw, dig = block.data, xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([dig(raw[a:a + threshold]) for a in wins.tolist()]), ">u8").reshape(-1, 2)
    hi, lo = d[:, 0].astype(np.uint64), d[:, 1].astype(np.uint64)
    row = np.searchsorted(block.offs, wins, side="right") - 1
    doc = block.ids[row] if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((wins, doc, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    heads = order[new]
    bounds = C.by_shard(hi[heads], shards)
    out = [_state(block.id, [np.concatenate(x) for x in zip(done, more)], _ranges(np.sort(wins)), order.astype(np.uint32),
                  np.packbits(new), bounds)]
    C.ask_rows(out, block.id, hi[heads], shards, C.first_copy_payload(hi[heads], lo[heads], doc[heads]))
    return pd.DataFrame(out, columns=["shard", "block", "payload"])


def finish(block: C.Block, rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    done, left, order, new, bounds = _read_state(rows)
    wins, new = _spread(*left), np.unpackbits(new)[:len(order)].astype(bool)
    holds = np.zeros(int(bounds[-1]), bool)
    for s, payload in zip(rows.shard, rows.payload):
        if s >= 0:
            a, b = bounds[s], bounds[s + 1]
            holds[a:b] = np.unpackbits(np.frombuffer(C.unsqueeze(payload), np.uint8))[:b - a]
    repeated = np.ones(len(order), bool)
    repeated[order[new]] = ~holds
    extra = wins[repeated]
    cover = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(cover, np.concatenate([done[0], extra]), 1)
    np.add.at(cover, np.concatenate([done[1], extra]) + threshold, -1)
    gone = (np.cumsum(cover) > 0).astype(np.int8)[:-1]
    # bounds of removed runs; a run ends with its document
    edge = np.diff(np.concatenate([[0], gone, [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = block.offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(gone))])
    cut = cut[(gone[cut - 1] == 1) & (gone[cut] == 1)] if len(cut) else cut
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, block.offs[:-1]).tolist()
    last = np.searchsorted(start, block.offs[1:]).tolist()
    start, end, offs, out = start.tolist(), end.tolist(), block.offs.tolist(), []
    for i, doc in enumerate(block.ids.tolist()):
        o, n, kept, at = offs[i], offs[i + 1], [], offs[i]
        spans = list(zip(start[first[i]:last[i]], end[first[i]:last[i]])) if n > o else []
        for s, e in spans:
            kept.append(block.data[at:s])
            at = e
        kept.append(block.data[at:n])
        out.append((doc, n - o, sum(e - s for s, e in spans), len(spans),
                    [{"start": s - o, "end": e - o} for s, e in spans], b"".join(kept)))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def dedup_suffixes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the bytes kept.  ``threshold`` is at least 64 bytes."""
    if threshold < BASES[-1]:
        raise ValueError(f"the threshold must be at least {BASES[-1]} bytes: ranks double up to there first")
    blocks = C.pack(docs)
    shards = C.shard_count(blocks, 35)

    def ask(block: C.Block) -> list:
        r, out = Round(block, threshold, BASES[0]), []
        C.ask_rows(out, block.id, r.names, shards, r.payload)
        return out

    def replies(asked: DataFrame, merged) -> DataFrame:
        return C.answer(asked.filter("shard >= 0"), merged).union(asked.filter("shard = -1"))

    first = C.answer(C.asks(blocks, ask), merge)
    second = C.materialize(C.settle(blocks, first, lambda b, a: round64(b, a, shards, threshold), C.ASK_SCHEMA), "round64")
    third = C.materialize(C.settle(blocks, replies(second, merge), lambda b, a: last_round(b, a, shards, threshold),
                                   C.ASK_SCHEMA), "last-round")
    return C.settle(blocks, replies(third, C.first_copy_merge), lambda b, a: finish(b, a, threshold), SCHEMA)
