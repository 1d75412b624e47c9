"""Language-model scores from n-gram counts of the whole training corpus, held in sharded Elias-Fano tries.

Every block of documents sends its distinct tokens and n-grams (Elias-Fano coded,
with their training counts) to shards by hash; a shard sums the counts, builds its part of
the trie (a memory-mapped file while the shard is answered), looks every asked
n-gram up by successor search among its context's children, and returns 16-bit
codes of the stored counts (floor of CODE_STEP log10 c; smoothing is the block's).  N-grams
are dealt by context and word together, so the children of a frequent context
spread over all shards.

p(w)     = (1 - r) c(w) / N for known tokens; all unknown tokens share r, the
           share of training tokens seen once (Good-Turing)
p(w | h) = (1 - l) c(h w) / c(h) + l p(w | shorter h),   l = K b c(h)^(b - 1)

l is the chance that the next word is new after h: the slope of Heaps' law
K c^b, fitted to how the distinct followers of contexts grow with their counts
in all blocks.  Both are distributions over the V + 1 token classes (up to the
codes' rounding down).  Tokens are named by 64-bit hashes; n-grams by 32 bits
of context and 32 of word beside the shard's share of the hash.

Defined cases: a null or empty text is its end token alone; repeated rows count
as often as they occur; without training documents every token is unknown, with
probability 1; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .eliasfano import Level, dump, load

ORDER = 3
FOLDS = 10
CODE_STEP = 1000        # codes per factor of ten
BLOCK_BYTES = 8 << 20   # larger blocks hold fewer distinct n-grams a byte, and their sorted keys code shorter
END = b" "              # no word holds a space
BUCKETS = 40            # powers of two of context counts for the Heaps fit

SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
_ANSWERS = "shard int, block long, payload binary, n long, v long, ones long, heaps array<double>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


class Tokens:
    """A block's tokens: local numbers in text order, every document closed by the end token."""

    def __init__(self, block: C.Block):
        number: dict[bytes, int] = defaultdict(count().__next__)
        number[END]
        flat: list[int] = []
        get, sizes = number.__getitem__, []
        for text in block.texts():
            words = text.lower().split()
            flat.extend(map(get, words))
            flat.append(0)
            sizes.append(len(words) + 1)
        self.word = np.array(flat, np.int64)
        self.size = np.array(sizes, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.name = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
        self.held = np.array([is_held_out(d) for d in block.ids.tolist()], bool)
        self.train = np.repeat(~self.held, self.size)
        self.place = np.arange(len(flat)) - np.repeat(self.start, self.size)

    def grams(self, order: int):
        """Per order 2..n: (which tokens have one, index of each into the distinct keys, keys, training counts).

        A document's first token follows an end token; longer contexts start no
        earlier than that.  Keys spread context and word over the high half.
        """
        name = self.name[self.word]
        context = np.concatenate([self.name[:1], name[:-1]]) if len(name) else name
        back = context
        for n in range(2, order + 1):
            at = np.flatnonzero(self.place >= n - 2)
            if n > 2:
                back = np.concatenate([np.zeros(1, np.uint64), back[:-1]]) if len(back) else back
                context = _mix(context * _B + back)
            c32, w32 = context[at] >> np.uint64(32), name[at] & np.uint64(0xFFFFFFFF)
            key = ((c32 ^ (_mix(w32 + np.uint64(1)) >> np.uint64(32))) << np.uint64(32)) | w32
            keys, inverse = np.unique(key, return_inverse=True)
            yield at, inverse, keys, np.bincount(inverse, self.train[at], len(keys)).astype(np.int64)


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of n-gram keys."""
    w = keys & np.uint64(0xFFFFFFFF)
    return (keys >> np.uint64(32)) ^ (_mix(w + np.uint64(1)) >> np.uint64(32)), w


def _heaps(t: Tokens, inverse: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(contexts, training count, distinct followers) by the power of two of the context's count here."""
    out = np.zeros((BUCKETS, 3))
    if counts.any():
        prev = np.concatenate([[0], t.word[:-1]])
        c = np.bincount(prev, t.train)
        of = np.empty(len(counts), np.int64)
        of[inverse] = prev                      # a bigram's first word
        f = np.bincount(of[counts > 0], minlength=len(c))
        b = np.log2(np.maximum(c, 1)).astype(int)
        for i, x in enumerate((c > 0, c, f)):
            out[:, i] = np.bincount(b, x, BUCKETS)
    return out


def ask(block: C.Block, shards: int, order: int) -> list:
    t, out = Tokens(block), []
    by = np.argsort(t.name)
    names, counts = t.name[by], np.bincount(t.word, t.train, len(t.name)).astype(np.int64)[by]
    heaps = None
    for n, (at, inverse, keys, cs) in enumerate(t.grams(order), 2):
        if n == 2:
            heaps = _heaps(t, inverse, cs)
        rows: list = []
        C.ask_rows(rows, block.id, keys, shards, lambda a, b, k=keys, c=cs: _write(k[a:b], c[a:b]))
        out += [(s + (n - 1) * shards, b, p) for s, b, p in rows]
    rows = []
    C.ask_rows(rows, block.id, names, shards, lambda a, b: _write(names[a:b], counts[a:b]))
    if heaps is not None and rows:
        rows[0] = (*rows[0][:2], rows[0][2] + b"HEAPS" + heaps.tobytes())
    return out + rows


def _write(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, Elias-Fano coded, and their counts in the smallest type that holds them."""
    c = C.squeeze(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes())
    return struct.pack("<I", len(c)) + c + dump(keys)


def _read(p: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    heaps = None
    tail = 8 * 3 * BUCKETS
    if p[-tail - 5:-tail] == b"HEAPS":
        heaps, p = np.frombuffer(p[-tail:], np.float64), p[:-tail - 5]
    cut = 4 + struct.unpack_from("<I", p)[0]
    keys, counts = load(p[cut:]), C.unsqueeze(p[4:cut])
    return keys, np.frombuffer(counts, f"u{len(counts) // len(keys)}").astype(np.int64), heaps


def answer(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Sum a shard's counts; tokens get their count back, n-grams the codes of the shard's trie."""
    pdf = pdf.sort_values("block", kind="stable").reset_index(drop=True)
    parts = [_read(p) for p in pdf.payload]
    cuts = np.cumsum([len(k) for k, _, _ in parts])[:-1]
    every, counts = np.concatenate([k for k, _, _ in parts]), np.concatenate([c for _, c, _ in parts])
    keys, inverse = np.unique(every, return_inverse=True)
    total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    heaps = np.sum([h for _, _, h in parts if h is not None], axis=0) if any(h is not None for _, _, h in parts) else None
    if pdf.shard.iloc[0] < shards:
        back = [C.squeeze(x.tobytes()) for x in np.split(total[inverse], cuts)]
        stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum())]
    else:
        known = total > 0
        context, word = _split(keys[known])
        order = np.lexsort((word, context))
        code = 1 + np.floor(np.log10(total[known]) * CODE_STEP + 1e-9)
        with tempfile.TemporaryFile() as file:
            level = Level(context[order], word[order], code[order]).map_to(file)
            found = level.codes(*_split(keys))[inverse]
            back = [C.squeeze(x.tobytes()) for x in np.split(found, cuts)]
            del level
        stats = [0, 0, 0]
    rest = [0] * (len(pdf) - 1)
    return pd.DataFrame({"shard": pdf.shard, "block": pdf.block, "payload": back, "n": [stats[0], *rest],
                         "v": [stats[1], *rest], "ones": [stats[2], *rest],
                         "heaps": [heaps] + [None] * (len(pdf) - 1)})


def fit_heaps(sums: np.ndarray) -> tuple[float, float]:
    """K and b of followers = K c^b, by least squares over the buckets' means, weighted by their tokens."""
    s = sums[sums[:, 0] > 0]
    if len(s) < 2:
        return 1.0, 0.9
    x, y, w = np.log(s[:, 1] / s[:, 0]), np.log(np.maximum(s[:, 2] / s[:, 0], 1e-9)), np.sqrt(s[:, 1])
    b, k = np.polyfit(x, y, 1, w=np.sqrt(w))
    return float(np.exp(k)), float(np.clip(b, 0.05, 0.999))


def finish(block: C.Block, answers: pd.DataFrame, shards: int, order: int, model: dict) -> pd.DataFrame:
    t = Tokens(block)
    n, v, ones, scale, power = (model[k] for k in ("n", "v", "ones", "scale", "power"))
    by = np.argsort(t.name)
    counts = np.empty(len(by), np.int64)
    counts[by] = _collect(answers, 0, shards, t.name[by], np.int64)
    c = counts[t.word]
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    unseen = ones / n if n else 1.0
    if n and not 0 < unseen < 1:
        unseen = 0.5 / n if unseen == 0 else 0.5
    p = np.where(c > 0, (1 - unseen) * c / max(n, 1), unseen)
    above = np.concatenate([counts[:1], c[:-1]]).astype(np.float64)     # count of each token's context
    for k, (at, inverse, keys, _) in enumerate(t.grams(order), 2):
        code = _collect(answers, k - 1, shards, keys, np.uint16)[inverse]
        joint = np.where(code > 0, 10.0 ** ((code - 1.0) / CODE_STEP), 0.0)
        h = above[at]
        new = np.clip(scale * power * np.maximum(h, 1) ** (power - 1), 1e-4, 0.999)
        p[at] = np.where(h > 0, (1 - new) * np.minimum(joint / np.maximum(h, 1), 1) + new * p[at], p[at])
        grown = np.zeros(len(p))
        grown[at] = joint
        above = np.concatenate([[0.0], grown[:-1]])
    log = np.log10(p)
    add = lambda x: np.add.reduceat(x, t.start) if len(t.start) else x
    return pd.DataFrame({"doc_id": block.ids, "held_out": t.held, "n_tokens": t.size, "n_known": add((c > 0).astype(np.int64)),
                         "train_tokens": n, "base_score": add(base), "score": add(log)})


def _collect(answers: pd.DataFrame, level: int, shards: int, keys: np.ndarray, dtype) -> np.ndarray:
    b, out = C.by_shard(keys, shards), np.zeros(len(keys), dtype)
    for s, payload in zip(answers.shard, answers.payload):
        if s // shards == level:
            s %= shards
            out[b[s]:b[s + 1]] = np.frombuffer(C.unsqueeze(payload), dtype)
    return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Token counts, unigram base score and model score (log10) of every document."""
    blocks = C.pack(docs, block_bytes=BLOCK_BYTES)
    shards = C.shard_count(blocks, 10)
    answers = C.materialize(C.asks(blocks, lambda b: ask(b, shards, order)).groupBy("shard").applyInPandas(
        lambda pdf: answer(pdf, shards), _ANSWERS), "model")
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("ones").alias("ones"),
                       *[F.sum(F.col("heaps")[i]) for i in range(3 * BUCKETS)]).first()
    heaps = np.array([x or 0.0 for x in sums[3:]]).reshape(BUCKETS, 3)
    scale, power = fit_heaps(heaps)
    model = {"n": int(sums["n"] or 0), "v": int(sums["v"] or 0), "ones": int(sums["ones"] or 0), "scale": scale, "power": power}
    return C.settle(blocks, answers.select("shard", "block", "payload"),
                    lambda b, a: finish(b, a, shards, order, model), SCHEMA)
