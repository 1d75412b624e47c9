"""Substring deduplication by content-defined chunking.

A gear rolling hash cuts every text where it is least among its neighbours, so
boundaries depend on nearby bytes only and an insertion shifts no other chunk.  Chunks are
compared by 128-bit digest across the corpus; the first copy (smallest doc_id,
then earliest start) stays.  Single chunks are short, so a repeat counts only
as part of a run of neighbouring repeated chunks of at least ``min_run`` bytes, or
of fewer that can be what whole chunks leave of a passage of over MAX_WORDS short
words: phrases that recur by chance stay.

Defined cases: null and empty texts come back as empty texts with no removals;
rows that repeat a doc_id count as later documents, in block order; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame

from . import chunks as C

WINDOW = 8              # bytes the gear hash looks back on
HALF = 12               # a cut's hash is the least among so many on both sides: chunks of 25 bytes on average
MAX_CHUNK = 256
MIN_RUN = 160           # bytes of neighbouring repeated chunks that count as a repeat
MAX_WORDS = 50          # and fewer, if with EDGE bytes on both sides they hold more words: a passage's ends are no whole chunks
EDGE = 80

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, text string"


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 2024) >> 32 for i in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-j]] << j over the last WINDOW bytes (by doubling)."""
    h = _gear()[data]
    span = 1
    while span < WINDOW:
        nxt = h.copy()
        nxt[span:] += h[:-span] << np.uint32(span)
        h, span = nxt, span * 2
    return h


def cut_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk bounds of the joined texts (every text starts a chunk; no cut inside a character).

    A byte ends a chunk where its hash is the first least one among its HALF neighbours on both
    sides, so whether there is a cut depends on WINDOW + 2 * HALF bytes of its own text only:
    copies are cut alike from the first cut that is that far inside them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    none = np.uint32(0xFFFFFFFF)
    # the WINDOW-bit sum keeps the low WINDOW bits full: mix before comparing
    h = np.minimum(gear_hash(data) * np.uint32(0x9E3779B1), none - np.uint32(1))
    head = np.ones(n + 1, bool)
    head[:n] = (data & 0xC0) != 0x80
    h[~head[1:]] = none                     # no cut inside a character
    starts = offs[:-1]
    for k in range(WINDOW - 1):             # nor where the hash would look at the text before
        at = starts + k
        h[at[at < offs[1:]]] = none
    # texts apart by HALF empty places: none sees another's hashes
    spread = np.arange(n) + HALF * (np.searchsorted(offs, np.arange(n), side="right"))
    apart = np.full(n + HALF * (len(offs) + 1), none)
    apart[spread] = h
    least, span = apart, 1                  # least[i] = min of apart[i:i + HALF], by doubling
    while span < HALF:
        step = min(span, HALF - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    before, after = least[spread - HALF], least[np.minimum(spread + 1, len(least) - 1)]
    may = np.flatnonzero((h < before) & (h <= after) & (h != none)) + 1
    bounds = np.union1d(may, offs.astype(np.int64))
    if not len(wide := np.flatnonzero(np.diff(bounds) > MAX_CHUNK)):
        return bounds
    more, heads = [], head.tobytes()
    for start, end in zip(bounds[wide].tolist(), bounds[wide + 1].tolist()):
        at = start + MAX_CHUNK
        while at < end:
            while at < end and not heads[at]:
                at += 1
            more.append(at)
            at += MAX_CHUNK
    return np.union1d(bounds, np.array(more, np.int64))


def _chunks(block: C.Block):
    """Chunk starts, ends, documents (row numbers) and digests of a block."""
    data = np.frombuffer(block.data, np.uint8)
    cuts = cut_points(data, block.offs)
    start, end = cuts[:-1], cuts[1:]
    keep = end > start
    start, end = start[keep], end[keep]
    row = np.searchsorted(block.offs, start, side="right") - 1
    raw = block.data
    dig = xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([dig(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]), ">u8").reshape(-1, 2)
    return start, end, row, d[:, 0].astype(np.uint64), d[:, 1].astype(np.uint64)


def _distinct(block: C.Block):
    start, end, row, hi, lo = _chunks(block)
    doc = block.ids[row] if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((start, doc, lo, hi))
    h, l = hi[order], lo[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    return start, end, row, order, new, h[new], l[new], doc[order][new]


def ask(block: C.Block, shards: int) -> list:
    *_, h, l, doc = _distinct(block)
    out: list = []
    C.ask_rows(out, block.id, h, shards, C.first_copy_payload(h, l, doc))
    return out


def _runs(start, end, row, repeated):
    """Maximal runs of repeated chunks inside one document: (row, start, end)."""
    flag = repeated.astype(np.int8)
    same = np.zeros(len(flag), bool)
    same[1:] = (row[1:] == row[:-1]) & repeated[1:] & repeated[:-1]
    first = np.flatnonzero(repeated & ~same)
    nxt = np.append(same[1:], False)
    last = np.flatnonzero((flag == 1) & ~nxt)
    return row[first], start[first], end[last]


def remove(block: C.Block, answers: pd.DataFrame, shards: int, min_run: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, spans, text) of the block's documents, in order."""
    start, end, row, order, new, h, _, _ = _distinct(block)
    holds = C.first_copy_bits(answers, shards, h)
    repeated = np.ones(len(order), bool)
    repeated[order[new]] = ~holds  # the first of each digest here stays where this block holds the first copy
    r, a, b = _runs(start, end, row, repeated)
    long_enough = (b - a) >= min_run
    for i in np.flatnonzero(~long_enough).tolist():
        o, n = block.offs[r[i]], block.offs[r[i] + 1]
        long_enough[i] = len(block.data[max(o, a[i] - EDGE):min(n, b[i] + EDGE)].split()) > MAX_WORDS
    r, a, b = r[long_enough], a[long_enough], b[long_enough]
    by_doc: dict[int, list] = {}
    for i, s, e in zip(r.tolist(), a.tolist(), b.tolist()):
        by_doc.setdefault(i, []).append((s, e))
    out = []
    offs = block.offs.tolist()
    for i, doc in enumerate(block.ids.tolist()):
        o, n = offs[i], offs[i + 1]
        spans, kept, at = by_doc.get(i, []), [], o
        for s, e in spans:
            kept.append(block.data[at:s])
            at = e
        kept.append(block.data[at:n])
        out.append((doc, n - o, sum(e - s for s, e in spans), len(spans),
                    [{"start": s - o, "end": e - o} for s, e in spans], b"".join(kept).decode("utf-8", "replace")))
    return out


def _exchange(docs: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame, int]:
    blocks = C.pack(docs, carry=carry)
    shards = C.shard_count(blocks, 26)
    return blocks, C.answer(C.asks(blocks, lambda b: ask(b, shards)), C.first_copy_merge), shards


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans and the text that is left."""
    blocks, answers, shards = _exchange(docs, ())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return C.settle(blocks, answers, lambda b, a: pd.DataFrame(remove(b, a, shards, min_run), columns=names), SCHEMA)


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The documents with all their columns and what is left of their texts (a null text stays null)."""
    blocks, answers, shards = _exchange(docs, tuple(docs.columns))
    names, at = docs.columns, docs.columns.index("text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        tables = []
        answers = right.to_pandas().sort_values("shard", kind="stable")
        for row in left.to_pylist():
            block = C.Block(SimpleNamespace(**row))
            rest = block.rest()
            texts = [r[5] for r in remove(block, answers, shards, min_run)]
            was = rest.column(at)
            kept = pa.compute.if_else(was.combine_chunks().is_valid(), pa.array(texts, pa.string()), None)
            tables.append(rest.set_column(at, names[at], kept).rename_columns(names))
        return pa.concat_tables(tables).combine_chunks()

    C.small_batches(docs.sparkSession)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, docs.schema)
