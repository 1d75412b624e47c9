"""Hard negatives by rotated one-bit codes with stored alignments, deterministic intervals and integer scores.

Every vector is turned by a pseudo-random rotation and its direction u is written as a sum of one-bit codes:
b1 holds the signs of u, the alignment a1 = <b1, u> is stored, b2 holds the signs of what a1 b1 leaves, and
so on for LEVELS codes; the length of each remainder is stored too.  For an anchor q

    <q, u> = a1 <q, b1> + ... + ak <q, bk> + <q, rk>,   |<q, rk>| <= |rk| sqrt(|q|^2 - <q, bk>^2)

by Cauchy and Schwarz (rk is orthogonal to bk).  <q, b> comes from population counts of the code with
QUERY_BITS bit planes of the quantised q, whose error is measured and added, so the interval around the
estimate always holds the true score.  Rows whose interval cannot matter are dropped after each code; the
others are scored in integers.  Nothing depends on chance: the result is exact.

On Spark: rows are packed in blocks of about BLOCK_ROWS, anchors in packs; a task compares one block with up to
GROUP_PACKS packs and returns at most a few rows per anchor, a window keeps the best.  Blocks
are dealt by a hash of the id, so no label or copy, however frequent, makes a task larger.  First every
anchor's positives are found, then, between the bounds these give, its negatives.

Defined cases: rows with a null label or vector, or null or non-finite components take no part, nor do those of
another length than the smallest id's; of rows that share an id the one with the least (label, vector) counts,
rows without an id do not; zero vectors score 0; components beyond a long are the nearest long, scores
too; an anchor without positives, or a positive without a negative between its bounds, returns no row; empty
tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks as C
from .ann import rotate

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # percent of the positive's score between which a negative is hard
LEVELS = 4
QUERY_BITS = 7
BLOCK_ROWS = 4096
PACK_ROWS = 512             # anchors in a pack
GROUP_PACKS = 16            # packs that meet a block in one task
ROUNDING = 1e-9             # of |q| |v|: far above what doubles lose in these sums
LONG = np.iinfo(np.int64)
PACK_SCHEMA = "at int, ids binary, labels binary, kind string, dim int, vectors binary, positives binary"


# --- codes and intervals -----------------------------------------------------------------------------

def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, align, left, norm) of the rows: packed signs per level, alignments, lengths of the remainders, lengths."""
    norm = np.linalg.norm(x.astype(float), axis=1)
    zero = norm == 0
    u = rotate(np.where(zero[:, None], 1.0, x.astype(float)), 0, 1)
    bits, align, left = [], [], []
    for _ in range(LEVELS):
        up = u >= 0
        a = np.abs(u).sum(axis=1) / np.sqrt(u.shape[1])
        u = u - a[:, None] * np.where(up, 1.0, -1.0) / np.sqrt(u.shape[1])
        bits.append(_words(up))
        align.append(a)
        left.append(np.linalg.norm(u, axis=1))
    return np.stack(bits), np.stack(align), np.stack(left), np.where(zero, 0.0, norm)


def _words(up: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    whole = np.zeros((len(up), -(-up.shape[1] // 64) * 64), bool)
    whole[:, :up.shape[1]] = up
    return np.packbits(whole, axis=1).view(np.uint64)


class Asker:
    """An anchor: its direction in bit planes, against which codes are counted."""

    def __init__(self, norm: float, width: int, low: float, step: float, total: float, error: float, planes: np.ndarray):
        self.norm, self.width, self.low, self.step, self.sum, self.error, self.planes = norm, width, low, step, total, error, planes

    def along(self, bits: np.ndarray) -> np.ndarray:
        """<quantised direction, b> of each code by population counts."""
        got = self.low * _ones(bits)
        for j, plane in enumerate(self.planes):
            got += self.step * (1 << j) * _ones(bits & plane)
        return (2 * got - self.sum) / np.sqrt(self.width)


def _ones(bits: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(bits)
    return (n[:, 0] if n.shape[1] == 1 else n.sum(axis=1, dtype=np.int64)).astype(float)


def askers(x: np.ndarray) -> Iterator[Asker]:
    """The anchors of a pack, turned and quantised together."""
    if not len(x):
        return
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1)
    y = rotate(np.where((norm == 0)[:, None], 1.0, x), 0, 1)
    low = y.min(axis=1)
    step = (y.max(axis=1) - low) / ((1 << QUERY_BITS) - 1)
    step = np.where(step == 0, 1.0, step)
    k = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
    near = low[:, None] + step[:, None] * k
    planes = np.stack([_words((k >> j & 1).astype(bool)) for j in range(QUERY_BITS)], axis=1)
    error = np.linalg.norm(y - near, axis=1)
    for i in range(len(x)):
        yield Asker(float(norm[i]), y.shape[1], float(low[i]), float(step[i]), float(near[i].sum()), float(error[i]), planes[i])


class Block:
    """Packed rows with their codes."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels, self.x = ids, labels, vectors
        self.bits, self.align, self.left, self.norm = codes(vectors) if len(ids) else (None,) * 4
        self.exact = vectors.astype(float)
        self.largest = float(np.abs(self.exact).max()) if vectors.size else 0.0

    def scores(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products with the rows ``at``."""
        bound = self.largest * float(np.abs(v.astype(float)).max(initial=0.0)) * max(1, len(v))
        if bound < 2.0 ** 52:       # sums of integers that doubles hold exactly
            return np.rint(self.exact[at] @ v.astype(float)).astype(np.int64)
        if bound < 2.0 ** 62:
            return self.x[at] @ v
        wide = self.x[at].astype(object) @ v.astype(object)
        return np.array([min(max(s, LONG.min), LONG.max) for s in wide], np.int64)

    def narrowed(self, asker: Asker, at: np.ndarray, keep) -> np.ndarray:
        """The rows of ``at`` that ``keep(least, most)`` leaves after each code."""
        estimate, fuzz = np.zeros(len(at)), np.zeros(len(at))
        for level in range(LEVELS):
            if not len(at):
                break
            along = asker.along(self.bits[level][at])
            a = self.align[level][at]
            estimate = estimate + a * along
            fuzz = fuzz + a * asker.error
            # the true <q, b> may be nearer to 0 than its estimate by the quantisation's error
            rest = np.sqrt(np.maximum(0.0, 1.0 - np.square(np.maximum(0.0, np.abs(along) - asker.error))))
            scale = asker.norm * self.norm[at]
            half = scale * (fuzz + self.left[level][at] * rest + ROUNDING)
            ok = keep(estimate * scale - half, estimate * scale + half)
            at, estimate, fuzz = at[ok], estimate[ok], fuzz[ok]
        return at


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; minus infinity where there are fewer."""
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def best_of(block: Block, asker: Asker, anchor: int, v: np.ndarray, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores): the first k other rows of the anchor's label."""
    at = np.flatnonzero((block.labels == label) & (block.ids != anchor))
    at = block.narrowed(asker, at, lambda least, most: most >= _kth(least, k))
    score = block.scores(v, at)
    first = np.lexsort((block.ids[at], -score))[:k]
    return block.ids[at[first]], score[first]


def bounds(positive: int) -> tuple[int, int]:
    """The least and the largest hard score beside a positive's."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def hard_of(block: Block, asker: Asker, v: np.ndarray, label: int, positives: list[int], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(positive score, ids, scores): for each positive score the first k rows of other labels between its bounds."""
    wanted = [(p, *bounds(p)) for p in positives if p >= 0]
    if not wanted:
        return

    def keep(least, most):
        ok = np.zeros(len(least), bool)
        for _, lo, hi in wanted:
            sure = (least >= lo) & (most <= hi)
            ok |= (most >= max(lo, _kth(least[sure], k))) & (least <= hi)
        return ok

    at = block.narrowed(asker, np.flatnonzero(block.labels != label), keep)
    score = block.scores(v, at)
    order = np.lexsort((block.ids[at], -score))
    ids, score = block.ids[at[order]], score[order]
    for p, lo, hi in wanted:
        first = np.searchsorted(-score, -hi)
        last = min(first + k, np.searchsorted(-score, -lo, "right"))
        yield p, ids[first:last], score[first:last]


# --- packing -----------------------------------------------------------------------------------------

def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (at, vec_id, label, v) of one pack as one row."""
    x = np.array(pdf.v.tolist(), np.int64).reshape(len(pdf), -1)
    kind = next(t for t in ("int16", "int32", "int64") if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
    pos = [[] if p is None else [int(s) for s in p] for p in pdf.positives] if "positives" in pdf else []
    flat = np.array([[len(p), *p] + [0] * (POSITIVES - len(p)) for p in pos], np.int64)
    return pd.DataFrame([dict(at=pdf["at"].iloc[0], ids=pdf.vec_id.to_numpy(np.int64).tobytes(), labels=pdf.label.to_numpy(np.int64).tobytes(),
                              kind=kind, dim=x.shape[1], vectors=C.squeeze(x.astype(kind).tobytes()), positives=flat.tobytes())])


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    ids = np.frombuffer(row.ids, np.int64)
    x = np.frombuffer(C.unsqueeze(row.vectors), row.kind).astype(np.int64).reshape(len(ids), row.dim)
    pos = np.frombuffer(row.positives, np.int64).reshape(-1, POSITIVES + 1)
    return ids, np.frombuffer(row.labels, np.int64), x, [p[1:1 + p[0]].tolist() for p in pos]


def _packs(rows: DataFrame, count: int) -> DataFrame:
    """Rows in ``count`` packs of about equal size."""
    at = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    return rows.withColumn("at", at).groupBy("at").applyInPandas(_pack, PACK_SCHEMA)


def _meet(blocks: DataFrame, n_blocks: int, packs: DataFrame, n_packs: int, compare, schema: str) -> DataFrame:
    """``compare(block row, pack rows)`` for every block and group of packs."""
    groups = -(-n_packs // GROUP_PACKS)
    tasks = n_blocks * groups   # named, so that small partitions are not merged: a task's work is in its pairs, not its bytes
    left = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "at", "g")
    right = packs.withColumn("g", F.expr(f"at div {GROUP_PACKS}").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, "b", "g")
    return left.groupBy(left["at"], left["g"]).cogroup(right.groupBy("b", "g")).applyInPandas(compare, schema)


# --- mining ------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): one row per id, components scaled and floored."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                       & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = fine.agg(F.min_by(F.size("v"), "vec_id")).first()[0]
    one = fine.filter(F.size("v") == F.lit(first if first is not None else -1)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", F.transform("r.v", lambda x: F.floor(x * scale)).alias("v"))


def _ranked(offers: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return offers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column | str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over integer vectors
    (vec_id, label, v), as ``usable`` gives them; ``is_anchor`` is a condition on vec_id."""
    C.small_batches(rows.sparkSession, 2048)
    rows = C.materialize(rows, "vectors")
    anchors = rows.filter(is_anchor)
    n_blocks = -(-rows.count() // BLOCK_ROWS) or 1
    n_packs = -(-anchors.count() // PACK_ROWS) or 1
    blocks = C.materialize(_packs(rows, n_blocks), "blocks")

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in left.itertuples(index=False):
            block = Block(*_unpack(b)[:3])
            for p in right.itertuples(index=False):
                ids, labels, x, _ = _unpack(p)
                for asker, anchor, label, v in zip(askers(x), ids.tolist(), labels.tolist(), x):
                    near, score = best_of(block, asker, anchor, v, label, POSITIVES)
                    out += [(anchor, i, s) for i, s in zip(near.tolist(), score.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"])

    offers = _meet(blocks, n_blocks, _packs(anchors, n_packs), n_packs, positives, "anchor_id long, vec_id long, score long")
    chosen = C.materialize(_ranked(offers, ["anchor_id"], POSITIVES).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in left.itertuples(index=False):
            block = Block(*_unpack(b)[:3])
            for p in right.itertuples(index=False):
                ids, labels, x, scores = _unpack(p)
                for asker, anchor, label, v, of in zip(askers(x), ids.tolist(), labels.tolist(), x, scores):
                    for positive, near, score in hard_of(block, asker, v, label, sorted(set(of)), NEGATIVES):
                        out += [(anchor, positive, i, s) for i, s in zip(near.tolist(), score.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "positive_score", "vec_id", "score"])

    wanted = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("positive_score").alias("positives"))  # at most POSITIVES
    asking = anchors.join(wanted, "vec_id")
    hard = _meet(blocks, n_blocks, _packs(asking, n_packs), n_packs, negatives, "anchor_id long, positive_score long, vec_id long, score long")
    best = _ranked(hard, ["anchor_id", "positive_score"], NEGATIVES)
    return chosen.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
