"""Embedding retrieval (survey 2.K, K9/K10) and retrieval metrics.

Exact top-k by squared L2 distance without scoring all pairs.  Corpus rows belong to the ball of their nearest pivot
(corpus rows of the least key hashes, more of them as the corpus grows) and within it to one of ``RINGS`` rings by
their distance from the pivot; a ring is cut by hash into parts of about ``PART_ROWS``, so a ball that holds a third of
all rows, or copies of one vector, is many tasks.  By the triangle inequality no row of a ring with distances lo..hi
from its pivot is nearer to a query at distance d from that pivot than max(d - hi, lo - d).

Two rounds: a query first meets the rings of the least bounds that hold k rows in all, then every other ring whose
bound is not above the k-th distance found.  Only rings that some query of a query block asks for are copied to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import py_round
from ..session import cut_lineage

DEFAULT_TOP_K = 2
QUERY_BLOCK_BYTES = 16 << 20
PART_ROWS = 4096
RINGS = 4
PIVOT_BYTES = 8 << 20       # at most these many bytes of pivots, and
MAX_PIVOTS = 1024           # this number of them, go to every task
SLACK = 1e-9                # share of the distances by which a bound may be off through rounding


def _sound(vec: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    return F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, a pivot at a time (as exact as the scores themselves)."""
    return np.stack([np.sqrt(np.square(x - p).sum(axis=1)) for p in pivots], axis=1)


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _assign(pivots: np.ndarray):
    """Ball and distance from its pivot for every corpus row."""
    def run(batches):
        for b in batches:
            if len(b):
                d = _to_pivots(_rows(b["_cv"]), pivots)
                ball = d.argmin(axis=1)
                yield b.assign(_ball=ball.astype("int32"), _d=d[np.arange(len(b)), ball])
    return run


@dataclass
class Rings:
    """What every task knows of the corpus: a row per ring (at most ``MAX_PIVOTS`` x ``RINGS``)."""
    pivots: np.ndarray
    ball: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No row of the ring is nearer than this: queries x rings."""
        d = _to_pivots(x, self.pivots)[:, self.ball]
        return np.maximum(np.maximum(d - self.hi, self.lo - d) - SLACK * (d + self.hi), 0.0)

    def first(self, bound: np.ndarray, k: int) -> np.ndarray:
        """For each query the rings of the least bounds that hold k rows: a truth table of queries x rings."""
        order = np.argsort(bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


def _visits(rings: Rings, k: int, part_rows: int, second: bool):
    """A row per query and part of a ring that it must meet in this round; n_scored, of its first row, counts the ring rows."""
    parts = rings.n // part_rows + 1

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.iloc[lo:lo + 256]
                bound = rings.bounds(_rows(some["_qv"]))
                meet = rings.first(bound, k)
                if second:
                    meet = ~meet & (bound <= some["_far"].to_numpy()[:, None])
                q, cell = np.nonzero(meet)
                head = np.zeros(len(q), bool)
                head[np.unique(q, return_index=True)[1]] = True
                scored = np.where(head, (meet @ rings.n)[q], 0)
                n = parts[cell]
                q, cell, scored = np.repeat(q, n), np.repeat(cell, n), np.where(np.arange(n.sum()) == np.repeat(np.cumsum(n) - n, n), np.repeat(scored, n), 0)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"_qk": some["_qk"].to_numpy()[q], "_qv": some["_qv"].to_numpy()[q], "_qb": some["_qb"].to_numpy()[q],
                                    "_ball": rings.ball[cell], "_ring": rings.ring[cell], "_part": part.astype("int32"), "_n": scored})
    return run


def _block_top(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, ids = _rows(c["_cv"]), c["_ck"].to_numpy()
            for key, vec in zip(q["_qk"], q["_qv"]):
                d = np.square(x - np.asarray(vec, float)).sum(axis=1)
                at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                at = at[np.lexsort((ids[at], d[at]))][:k]
                out.append(pd.DataFrame({"_qk": key, "_ck": ids[at], "distance": d[at]}))
        return pd.concat(out) if out else pd.DataFrame({"_qk": [], "_ck": [], "distance": []}, dtype=object)
    return run


def pivot_topk(queries: DataFrame, corpus: DataFrame, q_key: str, c_key: str, q_vec: str = "embedding", c_vec: str = "embedding",
               k: int = DEFAULT_TOP_K, query_block_bytes: int = QUERY_BLOCK_BYTES,
               part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The k nearest corpus rows of each query, (_qk, rank, _ck, distance), and how many corpus rows each query was
    compared with, (_qk, n_scored).

    Rows without a key, without a vector or with components that are null or no finite numbers take no part; ties go to the smaller corpus key.
    """
    q = queries.select(F.col(q_key).alias("_qk"), F.col(q_vec).alias("_qv")).filter(F.col("_qk").isNotNull() & _sound("_qv"))
    c = corpus.select(F.col(c_key).alias("_ck"), F.col(c_vec).alias("_cv")).filter(F.col("_ck").isNotNull() & _sound("_cv"))
    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields + c.schema.fields}
    near_t = f"_qk {kinds['_qk']}, _ck {kinds['_ck']}, distance double"
    n_c, dim = c.agg(F.count(F.lit(1)), F.max(F.size("_cv"))).first()
    if not n_c:
        return (c.sparkSession.createDataFrame([], near_t + ", rank int").select("_qk", "rank", "_ck", "distance"),
                q.select("_qk", F.lit(0).cast("long").alias("n_scored")).distinct())
    q = cut_lineage(q)      # read by both rounds
    size = q.agg(F.sum(F.size("_qv") * 8 + 64)).first()[0] or 0
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_qk"), F.lit(int(size // query_block_bytes) + 1)).cast("int"))
    # the pivots: one ball per part_rows x RINGS rows, as long as they stay small
    n_p = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * max(dim, 1)), -(-n_c // (part_rows * RINGS))))
    chosen = c.orderBy(F.xxhash64("_ck"), "_ck").limit(n_p).select("_cv").collect()
    pivots = np.unique(np.array([r["_cv"] for r in chosen], float), axis=0)
    balls = cut_lineage(c.mapInPandas(_assign(pivots), f"_ck {kinds['_ck']}, _cv {kinds['_cv']}, _ball int, _d double"))
    # rings of equal width; the balls' ranges are at most MAX_PIVOTS rows
    span = balls.groupBy("_ball").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    n_rings = min(RINGS, -(-n_c // part_rows))
    place = F.floor(F.try_divide(F.col("_d") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * n_rings)
    placed = balls.join(F.broadcast(span), "_ball").select("_ck", "_cv", "_ball", "_d", F.least(F.coalesce(place, F.lit(0)), F.lit(n_rings - 1)).cast("int").alias("_ring"))
    told = placed.groupBy("_ball", "_ring").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).toPandas()
    rings = Rings(pivots, *(told[x].to_numpy() for x in ("_ball", "_ring", "n", "lo", "hi")))
    parts = told[["_ball", "_ring"]].assign(_parts=told["n"] // part_rows + 1)
    sized = F.broadcast(c.sparkSession.createDataFrame(parts, "_ball int, _ring int, _parts long"))
    cells = placed.join(sized, ["_ball", "_ring"]).select("_ck", "_cv", "_ball", "_ring", F.pmod(F.xxhash64("_ck"), F.col("_parts")).cast("int").alias("_part"))

    def met(asked: DataFrame, second: bool) -> tuple[DataFrame, DataFrame]:
        v = asked.mapInPandas(_visits(rings, k, part_rows, second),
                              f"_qk {kinds['_qk']}, _qv {kinds['_qv']}, _qb int, _ball int, _ring int, _part int, _n long")
        at = ["_qb", "_ball", "_ring", "_part"]
        wanted = cells.join(v.select(*[F.col(x).alias(x) for x in at]).distinct(), at[1:])
        near = v.groupBy(*at).cogroup(wanted.groupBy(*at)).applyInPandas(_block_top(k), near_t)
        return near, v.groupBy("_qk").agg(F.sum("_n").alias("_n"))

    best = Window.partitionBy("_qk").orderBy("distance", "_ck")
    top = lambda near: near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    near1, scored1 = met(q, False)
    if len(told) == 1:          # nothing is left for a second round
        return top(near1).select("_qk", "rank", "_ck", "distance"), scored1.withColumnRenamed("_n", "n_scored")
    found = cut_lineage(top(near1))
    # with fewer than k rows in all, the first round met every ring
    far = found.groupBy("_qk").agg(F.sqrt(F.max("distance")).alias("_far"))
    near2, scored2 = met(q.join(far.withColumn("_far", F.col("_far") * (1 + SLACK)), "_qk"), True)
    out = top(found.select("_qk", "_ck", "distance").unionByName(near2)).select("_qk", "rank", "_ck", "distance")
    scored = scored1.unionByName(scored2).groupBy("_qk").agg(F.sum("_n").alias("n_scored"))
    return out, scored


def vector_topk(queries: DataFrame, corpus: DataFrame, q_key: str, c_key: str, q_vec: str = "embedding",
                c_vec: str = "embedding", k: int = DEFAULT_TOP_K,
                query_block_bytes: int = QUERY_BLOCK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(q_key, rank, c_key, distance, other corpus columns) for the k nearest corpus rows of each query (K9), as ``pivot_topk``."""
    top, _ = pivot_topk(queries, corpus, q_key, c_key, q_vec, c_vec, k, query_block_bytes, part_rows)
    rest = corpus.select(F.col(c_key).alias("_ck"), *[x for x in corpus.columns if x not in (c_key, c_vec)])
    return top.join(rest, "_ck").withColumnRenamed("_qk", q_key).withColumnRenamed("_ck", c_key)


# --- fixed values: context header and block labels ---------------------------
CONTEXT_HEADER = "### Published Research Evidence (RRL)\n"
SOURCE_LABEL, SECTION_LABEL, NO_SECTION = "**Source:** ", " | **Section:** ", "Unknown Section"
# -----------------------------------------------------------------------------


def assemble_context(hits: DataFrame, q_key: str, header: str = CONTEXT_HEADER,
                     source_col: str = "source", section_col: str = "section", text_col: str = "text") -> DataFrame:
    """Header + "Source | Section" + text blocks in rank order, one string per query.

    The group is the query's k hits (k is the retrieval parameter), so the
    collected list is bounded by k.
    """
    block = F.concat(F.lit(SOURCE_LABEL), F.coalesce(F.col(source_col).cast("string"), F.lit("")),
                     F.lit(SECTION_LABEL), F.coalesce(F.col(section_col).cast("string"), F.lit(NO_SECTION)),
                     F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")), F.lit("\n\n"))
    agg = hits.groupBy(q_key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_bl"))
    return agg.select(q_key, F.concat(F.lit(header), F.array_join(F.transform("_bl", lambda s: s["b"]), ""))
                      .alias("context"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, q_key: str, item_col: str, k: int = DEFAULT_TOP_K,
                      digits: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """P@k, R@k (hits not de-duplicated), MRR averaged over queries, rounded.

    ``hits``: (q_key, rank, item); ``relevant``: (q_key, item) distinct relevant set;
    ``queries``: all queries (those of ``relevant`` when not given).  A query
    without hits counts with zeros.
    """
    rel = relevant.select(q_key, item_col).distinct().withColumn("_rel", F.lit(1))
    n_rel = relevant.select(q_key, item_col).distinct().groupBy(q_key).agg(F.count(F.lit(1)).alias("_nrel"))
    h = hits.filter(F.col("rank") <= k).join(rel, [q_key, item_col], "left")
    asked = (relevant if queries is None else queries).select(q_key).distinct()
    per = h.groupBy(q_key).agg(F.count(F.lit(1)).alias("_nh"), F.sum(F.coalesce("_rel", F.lit(0))).alias("_hit"),
                               F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"))
    hit, nh = F.coalesce("_hit", F.lit(0)), F.coalesce("_nh", F.lit(0))
    per = asked.join(per, q_key, "left").join(n_rel, q_key, "left").select(
        q_key, (hit / F.greatest(nh, F.lit(1))).alias("p"),
        (hit / F.greatest(F.coalesce(F.col("_nrel"), F.lit(0)), F.lit(1))).alias("r"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("_first")), F.lit(0.0)).alias("rr"))
    return per.agg(py_round(F.avg("p"), digits).alias("precision_at_k"), py_round(F.avg("r"), digits).alias("recall_at_k"),
                   py_round(F.avg("rr"), digits).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))
