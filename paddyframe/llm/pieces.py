"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A model file gives pieces, log scores and normaliser flags.  White space is
marked U+2581; where no piece holds a marker after another character (true of
the usual models), no piece crosses the start of a marked word, so the best
segmentation of a text is that of its words in turn and every distinct word is
segmented once per worker.  All words of a batch go through the trie and the
Viterbi recursion together, one array step per depth or position.

Ties go to the longer piece at the earliest start.  A character that no piece
covers costs the lowest score less 10 and comes out as its byte pieces (or as
the unknown piece, neighbours merged, where the model has no byte pieces).

Defined cases: null and empty texts have no pieces; decoding restores every text without U+2581 (a
literal marker comes back as a space); unknown ids decode to " ⁇ ", control ids to nothing; repeated
rows get equal results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C

MARK = "▁"
UNK_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)   # piece types of the file format: fixed values
MEMO_WORDS = 1 << 19        # segmentations that a worker keeps; half stay, those met again, where it is full
MEMO_IDS = 1 << 22          # ids of them all
MEMO_CHARS = 32
TEXT_BATCH = 1 << 20        # characters of texts (one at least) put together at once
WORD_BATCH = 1 << 16        # characters segmented at once: bounds the match tables


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (buf[at] & 127) << shift
            shift += 7
            at += 1
            if buf[at - 1] < 128:
                return out, at
    at = 0
    while at < len(buf):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = buf[at:at + size], at + size
        yield tag >> 3, value


class DoubleArray:
    """Double-array trie over byte strings: child of s by byte b is base[s] + b + 1 where check there is s."""

    def __init__(self, keys: list[bytes]):
        self.base, self.check, self.value = [0], [-1], [-1]
        items = sorted((k, i) for i, k in enumerate(keys))
        todo = [(0, 0, len(items), 0)]      # node, first and past-last item, depth
        free, tried = 1, defaultdict(int)
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(items[lo][0]) == depth:
                self.value[node] = items[lo][1]
                lo += 1
            kids, i = [], lo
            while i < hi:
                b, j = items[i][0][depth], i
                while j < hi and items[j][0][depth] == b:
                    j += 1
                kids.append((b, i, j))
                i = j
            if not kids:
                continue
            while free < len(self.check) and self.check[free] != -1:
                free += 1
            # where a family of this size was placed last: earlier gaps are taken or too tight
            at = max(free - kids[0][0] - 1, tried[min(len(kids), 8)], 0)
            while any(at + b + 1 < len(self.check) and self.check[at + b + 1] != -1 for b, _, _ in kids) or at + kids[0][0] + 1 < 1:
                at += 1
            tried[min(len(kids), 8)] = at
            grow = at + kids[-1][0] + 2 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            self.base[node] = at
            for b, i, j in kids:
                self.check[at + b + 1] = node
                todo.append((at + b + 1, i, j, depth + 1))
        pad = [0] * 257                     # no step leaves the arrays
        self.base = np.array(self.base + pad, np.int32)
        self.check = np.array(self.check + [-1] * 257, np.int32)
        self.value = np.array(self.value + [-1] * 257, np.int32)


class Words(dict):
    """Number of every word, those met for the first time listed in ``new``."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words))))
        self.n, self.new = len(words), []

    def __missing__(self, word: str) -> int:
        self[word] = n = self.n
        self.n += 1
        self.new.append(word)
        return n


def _put(array: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` from place n on, doubled where it is full."""
    if n + len(more) > len(array):
        array = np.concatenate([array[:n], np.zeros(max(n, len(more)), array.dtype)])
    array[n:n + len(more)] = more
    return array


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, count of them."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    prefix: bool        # a marker before the text
    squeeze: bool       # runs of spaces count as one, none at the ends

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        pieces, scores, types, flags = [], [], [], {3: 1, 4: 1}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    pieces.append(own[1].decode("utf-8"))
                    scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    types.append(own.get(3, NORMAL))
                elif number == 3:
                    spec = dict(_fields(value))
                    if spec.get(2):
                        raise ValueError("models with a character map are not supported: give texts already mapped")
                    flags.update({k: v for k, v in spec.items() if k in (3, 4)})
        return cls(pieces, np.array(scores), np.array(types), bool(flags[3]), bool(flags[4]))

    def __post_init__(self):
        self.types, self.scores = np.asarray(self.types), np.asarray(self.scores, float)
        usable = np.flatnonzero(np.isin(self.types, (NORMAL, USER))).tolist()
        self.trie = DoubleArray([self.pieces[i].encode() for i in usable])
        self.ids = np.array(usable + [-1], np.int64)
        normal = self.scores[self.types == NORMAL]
        low, high = (normal.min(), normal.max()) if len(normal) else (0.0, 0.0)
        self.unknown_score = low - UNK_PENALTY
        score = self.scores.copy()
        for i in np.flatnonzero(self.types == USER):  # user-defined pieces win over any other reading
            score[i] = len(self.pieces[i]) * high - 0.1
        self.piece_score = np.append(score, 0.0)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0]) if (self.types == UNKNOWN).any() else 0
        self.byte_ids = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(self.types == BYTE)}
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in usable)
        self.byte_table = np.array([self.byte_ids.get(c, -1) for c in range(256)])
        # segmentations by word number: the ids lie in flat from first on
        self.memo = Words([])
        self.flat, self.n_flat = np.zeros(0, np.uint32), 0
        self.first, self.count, self.n_bytes = (np.zeros(0, np.int64) for _ in range(3))
        self.total, self.again = np.zeros(0), np.zeros(0, bool)

    # --- encoding ---

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentation of each word: all ids in turn; by word their number, score, number of byte pieces."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size + 1) - size - 1              # one slot past each word: its end
        # no UTF-8 text, and so no piece, holds the byte between the words: no match runs past it
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        head = (text & 0xC0) != 0x80                        # starts of characters (and word ends)
        edge = np.flatnonzero(head)
        ends = text[edge] == 255
        at, nxt = edge[~ends], np.append(edge[1:], len(text))[~ends]
        found = []
        node, begin, depth = np.zeros(len(at), np.int32), at, 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        while len(begin):
            child = base[node] + text[begin + depth] + 1
            ok = check[child] == node
            node, begin, depth = child[ok], begin[ok], depth + 1
            got = value[node]
            hit = got >= 0
            found.append((begin[hit], begin[hit] + depth, self.ids[got[hit]]))
        single = np.zeros(len(text), bool)
        char_end = np.zeros(len(text), np.int64)
        char_end[at] = nxt
        for x, y, _ in found[:4]:                           # a character has four bytes at most
            single[x[y == char_end[x]]] = True
        lone = ~single[at]
        found.append((at[lone], nxt[lone], np.full(int(lone.sum()), -1)))
        a, b, piece = (np.concatenate(c) for c in zip(*found))
        gain = np.where(piece >= 0, self.piece_score[piece], self.unknown_score)
        best = np.full(len(text), -np.inf)
        best[start] = 0.0
        back, used = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
        offset = (np.arange(len(text)) - np.repeat(start, size + 1))[a]
        if size.max(initial=0) < 1 << 15:
            offset = offset.astype(np.int16)                # sorted in one pass
        order = np.argsort(offset, kind="stable")
        a, b, piece, gain, offset = a[order], b[order], piece[order], gain[order], offset[order]
        cuts = (np.flatnonzero(np.diff(offset)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(a)]):     # by start offset: each end once a start
            cand = best[a[lo:hi]] + gain[lo:hi]
            up = np.flatnonzero(cand > best[b[lo:hi]]) + lo
            best[b[up]] = cand[up - lo]
            back[b[up]], used[b[up]] = a[up], piece[up]
        # all words walk back from their ends together
        word, at = np.arange(len(raw)), start + size
        steps, length = [], np.zeros(len(raw), np.int64)
        live = np.flatnonzero(at > start)
        word, at = word[live], at[live]
        while len(word):
            steps.append((word, at))
            length[word] += 1
            at = back[at]
            live = np.flatnonzero(at > start[word])
            word, at = word[live], at[live]
        last = np.cumsum(length)
        b = np.empty(int(length.sum()), np.int64)
        for step, (word, at) in enumerate(steps):
            b[last[word] - 1 - step] = at
        a, piece = back[b], used[b]
        total, n_bytes = best[start + size], np.zeros(len(raw), np.int64)
        odd = piece < 0
        if odd.any():   # characters that no piece covers
            word = np.repeat(np.arange(len(raw)), length)
            if self.byte_ids:
                times = np.where(odd, b - a, 1)
                place = np.arange(times.sum()) + np.repeat(a - np.cumsum(times) + times, times)
                odd, word = np.repeat(odd, times), np.repeat(word, times)
                piece = np.where(odd, self.byte_table[text[place]], np.repeat(piece, times))
                if (piece < 0).any():
                    raise KeyError("the model lacks a byte piece")
                n_bytes = np.bincount(word[odd], minlength=len(raw))
            else:
                piece = np.where(odd, self.unknown, piece)
                keep = np.ones(len(piece), bool)
                keep[1:] = ~odd[1:] | (word[1:] != word[:-1]) | (piece[:-1] != self.unknown)
                piece, word = piece[keep], word[keep]
            length = np.bincount(word, minlength=len(raw))
        return piece.astype(np.uint32), length, total, n_bytes

    def _learn(self, words: list[str]) -> None:
        """Segmentations of the words, the last numbered, put after the others."""
        n = self.memo.n - len(words)
        part, size = 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= WORD_BATCH or i == len(words) - 1:
                ids, length, total, n_bytes = self.segment(words[part:i + 1])
                self.flat = _put(self.flat, self.n_flat, ids)
                self.first = _put(self.first, n, self.n_flat + np.cumsum(length) - length)
                self.count, self.n_bytes = _put(self.count, n, length), _put(self.n_bytes, n, n_bytes)
                self.total, self.again = _put(self.total, n, total), _put(self.again, n, np.zeros(len(length), bool))
                self.n_flat, n, part, size = self.n_flat + len(ids), n + len(length), i + 1, 0

    def _forget(self) -> None:
        """Keep the words met again since the last time, half of the memo at most."""
        kept = [(w, i) for w, i in self.memo.items() if self.again[i]][:MEMO_WORDS // 2]
        at = np.array([i for _, i in kept], np.int64)
        n = int(np.searchsorted(np.cumsum(self.count[at]), MEMO_IDS // 2, "right"))
        kept, at = kept[:n], at[:n]
        self.memo, self.count = Words([w for w, _ in kept]), self.count[at]
        self.flat, self.first = self.flat[_spans(self.first[at], self.count)], np.cumsum(self.count) - self.count
        self.n_flat, self.total, self.n_bytes = len(self.flat), self.total[at], self.n_bytes[at]
        self.again = np.zeros(len(at), bool)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], np.ndarray]:
        """All ids in turn; bounds of each text's ids among them; scores; numbers of byte pieces."""
        cuts, size = [0], 0
        for i, t in enumerate(texts):
            if size and size + len(t) > TEXT_BATCH:
                cuts.append(i)
                size = 0
            size += len(t)
        ids, counts, scores, n_bytes = zip(*(self._encode_part(texts[x:y]) for x, y in zip(cuts, [*cuts[1:], len(texts)])))
        return (np.concatenate(ids), np.cumsum(np.concatenate([[0], *counts])), list(chain.from_iterable(scores)),
                np.concatenate(n_bytes))

    def _encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], np.ndarray]:
        """All ids in turn; by text their number, score, number of byte pieces."""
        marked = [self.normalize(t) for t in texts]
        split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if self.apart else lambda t: [t] if t else []
        words = [split(t) for t in marked]
        if self.memo.n > MEMO_WORDS or self.n_flat > MEMO_IDS:
            self._forget()
        old, memo = self.memo.n, self.memo
        ends = np.cumsum([0, *map(len, words)])
        at = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]))
        new, memo.new = memo.new, []
        self._learn(new)
        self.again[at[at < old]] = True
        count = self.count[at]
        ids = self.flat[_spans(self.first[at], count)]
        counts = np.diff(np.concatenate([[0], np.cumsum(count)])[ends])
        n_bytes = np.diff(np.concatenate([[0], np.cumsum(self.n_bytes[at])])[ends])
        total, ends = self.total[at].tolist(), ends.tolist()
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return ids, counts, [sum(total[x:y]) for x, y in zip(ends, ends[1:])], n_bytes

    def encode(self, texts: list[str]) -> list[tuple[bytes, float, int]]:
        """Ids (unsigned 32-bit), score and number of byte pieces of each text."""
        ids, bounds, scores, n_bytes = self.encode_flat(texts)
        bounds = bounds.tolist()
        return [(ids[x:y].astype("<u4").tobytes(), s, n) for x, y, s, n in zip(bounds, bounds[1:], scores, n_bytes.tolist())]

    # --- decoding ---

    def surfaces(self) -> list[bytes]:
        """What every id contributes to the decoded text."""
        back = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [back[i] if i in back else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
                else p.replace(MARK, " ").encode() for i, (p, t) in enumerate(zip(self.pieces, self.types.tolist()))]

    def decode(self, ids: list[int], surfaces: list[bytes]) -> str:
        text = b"".join(map(surfaces.__getitem__, ids)).decode("utf-8", "replace")
        # the marker before the text is no part of it
        return text[1:] if self.prefix and ids and self.pieces[ids[0]].startswith(MARK) else text


ENCODED = "doc_id long, ids array<int>, score double, n_byte_pieces long"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, score, n_byte_pieces) of every whole text; ``path`` names a SentencePiece model file."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(path))  # bounded by the vocabulary

    def run(batches):
        for batch in batches:
            ids, bounds, scores, n_bytes = model.value.encode_flat([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                 pa.array(scores, pa.float64()), pa.array(n_bytes, pa.int64())],
                names=["doc_id", "ids", "score", "n_byte_pieces"])

    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``text``, the decoded ids (null ids: empty)."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    names = [*encoded.columns, "text"]
    at = names.index("ids")

    def run(batches):
        surfaces = model.value.surfaces()
        for batch in batches:
            ids = batch.column(at).fill_null([]) if batch.column(at).null_count else batch.column(at)
            flat, offs = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())])
            texts = [model.value.decode(flat[a:b], surfaces) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    C.small_batches(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")
