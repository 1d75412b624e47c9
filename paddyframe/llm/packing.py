"""Best-fit packing of tokenised documents, reduced first by Martello-Toth dominance.

Tokenising and numbering run on all documents; the packing itself only needs
how many pieces there are of each length, a table of at most ``capacity`` rows
whatever the corpus holds, so it is solved once on the driver and its placement
rules are sent back as ranges of piece numbers.

Reduction: while the longest piece left has a partner set of at most three
pieces that provably dominates every other set holding it (it fills the
sequence exactly, or no alternative can use the space better), that sequence is
fixed for good; the rest is packed best-fit in descending length.

Documents longer than the capacity are cut from the end, so only the first
piece is shorter.  Defined cases: a null or empty text is the end token alone;
repeated rows are packed as often as they occur; pieces of equal length are
numbered by (row block, order); an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks as C

CAPACITY = 2048
END_ID = 0
MEMO_WORDS = 1 << 19    # word encodings in each of a worker's two generations (some 100 MB a generation)
MEMO_CHARS = 64         # longer words are encoded anew
TEXT_BATCH = 1 << 21    # bytes of texts (one at least) encoded together: the more, the fewer distinct words a byte
ROW_BYTES = 64          # that an empty text counts for, too

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, num long"
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Two white-space characters around a space: the only place where cutting before the space could
#: change the tokens (any character that either library counts as white space is in the class).
_UNSAFE = f"[{_SPACE}] (?:[{_SPACE}]|\\z)"

_TAIL = ".,;:!?"   # signs that often close a word
#: Letters and signs whose pre-tokens are known without the tokenizer's expression: a run of either, of digits, or one
#: line break between two of them.  An apostrophe (contractions) is none, nor is any other white space.
_LETTERS = "A-Za-z" + "".join(chr(c) for c in range(0xaa, 0x530) if chr(c).isalpha())
_SIGNS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_RUNS = f"[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+|\n"


class _Memo:
    """Ids of words behind a given first character (a space, or nothing at a text's start)."""

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}   # words not met since the memo was last full go with it

    def find(self, words: list[str]) -> list[bytes | None]:
        out = list(map(self.newer.get, words))
        if self.older:
            again = [i for i, ids in enumerate(out) if ids is None and words[i] in self.older]
            for i in again:
                out[i] = self.older[words[i]]
            self.keep([words[i] for i in again], [out[i] for i in again])
        return out

    def keep(self, words: list[str], ids: list[bytes]) -> None:
        if max(map(len, words), default=0) > MEMO_CHARS:
            short = [len(w) <= MEMO_CHARS for w in words]
            words, ids = list(compress(words, short)), list(compress(ids, short))
        if len(self.newer) + len(words) > MEMO_WORDS:
            self.newer, self.older = {}, self.newer
        self.newer.update(islice(zip(words, ids), MEMO_WORDS))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()   # much quicker than a scalar per string


def _pack(tok, text: str) -> bytes:
    """Ids by the call that leaves out the offsets of the tokens."""
    return array("I", tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes() if text else b""


class WordEncoder:
    """Token ids of whole texts, encoding each distinct word once.

    The tokenizer starts a new pre-token at every space between non-space
    characters, so a text can be cut there and the parts' ids joined, and
    likewise between a letter and a closing sign; texts with runs of white space
    around a space are encoded whole.  The words of many texts are cut and
    numbered together, and those not met before go to the tokenizer in one call;
    runs of letters, digits or signs are pre-tokens already and go to its model.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)    # no expression, no added tokens: for known pre-tokens
        self.first, self.rest = _Memo(), _Memo()
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in [10, 32, *range(0xaa, 0x530)]}
        added = self.tok.get_added_tokens_decoder()
        not_added = f"(?!.*(?:{'|'.join(re.escape(t.content) for t in added.values())}))" if added else ""
        known = f"[{_LETTERS}0-9{_SIGNS}]"
        self.known = re.compile(f"{not_added}{known}+(?:\n{known}+)*", re.S).fullmatch
        self.runs = re.compile(_RUNS).findall
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of every token; a byte is one character there
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if i in added else len(token)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return bytes(self.encode_all(pa.array([text], pa.string()))[0])

    def encode_all(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Ids of all texts (none null) in turn, as ``encode`` gives them; bounds of each text's ids in bytes."""
        whole = pc.match_substring_regex(texts, _UNSAFE)
        words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        at = words.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        words = words.flatten()
        behind = np.ones(len(words), bool)      # a space
        behind[at[:-1]] = False
        coded = words.filter(pa.array(behind)).dictionary_encode()
        ids = self._lookup(_strings(coded.dictionary), " ")
        start = self._lookup(_strings(words.take(pa.array(at[:-1]))), "")
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            start[i] = _pack(self.tok, texts[i].as_py())
        number = np.empty(len(words), np.int64)
        number[behind] = coded.indices.to_numpy()
        number[at[:-1]] = len(ids) + np.arange(len(start))
        out = pa.array(ids + start, pa.large_binary()).take(pa.array(number))
        _, ends, data = out.buffers()
        return memoryview(data or b""), np.frombuffer(ends, np.int64, len(out) + 1)[at]

    def _lookup(self, words: list[str], before: str) -> list[bytes]:
        memo = self.rest if before else self.first
        out = memo.find(words)
        new = [i for i, ids in enumerate(out) if ids is None]
        if not new:
            return out
        run = pc.match_substring_regex(pa.array([words[i] for i in new], pa.large_string()), f"^(?:{_RUNS})$")
        run = run.to_numpy(zero_copy_only=False)
        runs, whole, apart = np.array(new)[run].tolist(), [], []
        for i in np.array(new)[~run].tolist():
            parts = self._parts(words[i])
            (whole if parts is None else apart).append(i if parts is None else (i, parts))
        lead = before.translate(self.spelt)
        spelt = [lead + (w if w.isascii() and w != "\n" else w.translate(self.spelt)) for w in map(words.__getitem__, runs)]
        texts = [before + words[i] for i in whole]
        fresh = (self._tokens(self.bare, spelt, list(map(len, spelt)))
                 + self._tokens(self.tok, texts, [len(t.encode()) for t in texts]))
        runs += whole
        for i, ids in zip(runs, fresh):
            out[i] = ids
        memo.keep([words[i] for i in runs], fresh)
        if apart:
            heads, tails = list({p[0] for _, p in apart}), list({x for _, p in apart for x in p[1:]})
            head, tail = dict(zip(heads, self._lookup(heads, before))), dict(zip(tails, self._lookup(tails, "")))
            for i, p in apart:
                out[i] = head[p[0]] + (tail[p[1]] if len(p) == 2 else b"".join(map(tail.__getitem__, p[1:])))
            memo.keep([words[i] for i, _ in apart], [out[i] for i, _ in apart])
        return out

    def _parts(self, word: str) -> list[str] | None:
        """Parts between which the tokenizer starts a new pre-token; None: there is one, or none is known."""
        if self.known(word):
            return self.runs(word)
        base = word.rstrip(_TAIL)
        if base and base != word and base[-1].isalpha():    # a pre-token ends between letter and sign
            return [base, word[len(base):]]
        return None

    def _tokens(self, tok, texts: list[str], n_bytes: list[int]) -> list[bytes]:
        """Ids of each text: all in one call, parted where the tokens' bytes end with the text's."""
        if not texts:
            return []
        ids = np.array(tok.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends, want = np.append(0, np.cumsum(self.n_bytes[ids])), np.cumsum(n_bytes)
        last = np.searchsorted(ends, want, side="right") - 1
        if (ends[last] != want).any() or last[-1] != len(ids):  # a token that is not the bytes it stands for
            return [_pack(tok, t) for t in texts]
        data, cuts = ids.tobytes(), (4 * last).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def _encoder(path: str) -> WordEncoder:
    return C.keep(f"encoder {path}", lambda: WordEncoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n > capacity else [(0, n)]


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``TEXT_BATCH`` bytes of text, one row at least."""
    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum([0, *(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False) + ROW_BYTES).tolist()])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + TEXT_BATCH - size, side="right")) - 1
            stop = max(stop, start if held else start + 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
            start = stop
            if start < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with a number per (row block, length): ``slot`` the block, ``num`` the count before it there."""
    types = dict(zip(["long", "int"], [pa.int64(), pa.int32()]))
    fields = [(name, types[kind]) for name, kind in map(str.split, PIECES.split(", "))]

    def run(batches):
        enc = _encoder(path)
        slot = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.uint32(END_ID).tobytes()
        for batch in _by_size(batches):
            out = []
            pa.default_memory_pool().release_unused()
            ids, bounds = enc.encode_all(batch.column("text"))
            bounds = bounds.tolist()
            for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
                for i, (s, n) in enumerate(cut((b - a) // 4 + 1, capacity)):
                    stop = a + 4 * (s + n)
                    crc = zlib.crc32(ids[a + 4 * s:min(stop, b)])
                    out.append((row, i, s, n, crc if stop <= b else zlib.crc32(end, crc), slot, seen[n]))
                    seen[n] += 1
            row, *rest = zip(*out)
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, (_, t) in zip(rest, fields[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, PIECES)


def _dominant(w: int, count: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set holding ``w`` that dominates every other feasible set holding it, if a rule proves one."""
    room = capacity - w
    rest = {x: c - (x == w) for x, c in count.items() if x <= room and c > (x == w)}
    if not rest:
        return (w,)
    lens = sorted(rest)
    a = lens[-1]
    small = [x for x in lens[:3] for _ in range(min(3, rest[x]))][:3]
    if a == room or len(small) < 2 or small[0] + small[1] > room:
        return (w, a)           # what else may stand beside w goes, together, where a was
    if len(small) > 2 and sum(small) <= room:
        return None
    # at most two pieces fit beside w
    beside = [x for x in lens if x <= room - a and (x != a or rest[x] > 1)]
    pairs = [(d, d if rest[d] > 1 else c) for d, c in zip(lens, lens[1:] + [capacity + 1])]
    pairs = [(d, c) for d, c in pairs if d + c <= room]
    if not beside:
        return (w, a) if max(_pair_sum(rest, lens, room)) <= a else None
    return (w, a, beside[-1]) if max(d for d, _ in pairs) <= beside[-1] else None


def _pair_sum(rest: dict[int, int], lens: list[int], room: int) -> list[int]:
    """Sums of the best partner pair of every length."""
    out, j = [0], len(lens) - 1
    for i, x in enumerate(lens):
        while j >= 0 and (x + lens[j] > room or (i == j and rest[x] < 2)):
            j -= 1
        if j < i:
            break
        out.append(x + lens[j])
    return out


def reduce_by_dominance(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction: fixed (lengths, how many such sequences); ``count`` keeps what is left.

    For a piece w (longest first): alone, if nothing fits beside it; with its
    largest partner a, if the two fill the sequence, or no two pieces fit beside
    w, or no two that fit outweigh a; with a and the largest piece b beside
    them, if at most two pieces fit beside w and the smaller of any two is at
    most b.  Fewer pieces leave fewer alternatives, so the same set goes on
    dominating until one of its lengths runs out; passes end when none changes.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for w in sorted(count, reverse=True):
            while count.get(w) and (chosen := _dominant(w, count, capacity)):
                need = Counter(chosen)
                times = min(count[x] // k for x, k in need.items())
                for x, k in need.items():
                    count[x] -= k * times
                    if not count[x]:
                        del count[x]
                fixed.append((chosen, times))
                changed = True
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in order, how many such sequences).

    Sequences with equal contents are handled as one group, so the work depends
    on the number of lengths, not of pieces.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # room -> [contents, how many]
    for w in sorted(count, reverse=True):
        left = count[w]
        while left:
            room = next((r for r in sorted(groups) if r >= w and groups[r]), None)
            content, have = groups[room].pop() if room is not None else ((), -(-left // (capacity // w)))
            room = capacity if room is None else room
            k = min(room // w, left)          # best fit goes on with the sequence it has just used
            times = min(have, left // k)
            if have > times:
                groups[room].append([content, have - times])
            if content == () and have > times:
                groups[room].pop()            # sequences not opened
            groups[room - k * w].append([content + (w,) * k, times])
            left -= k * times
    return [(tuple(c), n) for gs in groups.values() for c, n in gs]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All sequences as (lengths in order, how many)."""
    left = dict(count)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def placement(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which piece number on, first sequence minus that number, and offset."""
    rules: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, times in patterns:
        at = 0
        for w in lengths:
            rules[w].append((used[w], base - used[w], at))
            used[w] += times
            at += w
        base += times
    return {w: tuple(np.array(c, np.int64) for c in zip(*r)) for w, r in rules.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    cut_up = C.materialize(pieces(docs, path, capacity), "pieces")
    by_slot = cut_up.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("slot")
                                        .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    offsets = by_slot.select("length", "slot", before)  # one row per (length, task), not per piece
    count = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules = spark.sparkContext.broadcast(placement(plan(count, capacity)))  # bounded by the number of lengths

    def place(batches):
        C.let_go()
        for pdf in batches:
            num = (pdf.before + pdf.num).to_numpy()
            length = pdf["length"].to_numpy()
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for w in np.unique(length):
                at = length == w
                start, shift, offset = rules.value[int(w)]
                rule = np.searchsorted(start, num[at], side="right") - 1
                seq[at], off[at] = shift[rule] + num[at], offset[rule]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "piece": pdf.piece, "start": pdf.start, "length": length,
                                "ids_crc32": pdf.ids_crc32, "sequence_id": seq, "offset": off})

    return cut_up.join(offsets, ["length", "slot"]).mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
