"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance d <= 2r meet in a fingerprint that
is within r of both.  Every *distinct* fingerprint emits all variants within
radius r (1 + 64 rows for r = 1), variants are shuffled, and the fingerprints
that share one are linked.  All fingerprints at one variant are within 2r of
each other, so a chain through them in order links the whole bucket: no group
emits all its pairs.  A bucket holds at most as many rows as the ball has
points, whatever the corpus holds.

Defined cases: a null, empty or all-blank text has fingerprint 0 and links like
any other; fewer words than the shingle length make one shingle of the whole
sequence; repeated rows get equal results; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks as C
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
VOTE_ROWS = 1 << 16     # shingles voted on at once: bounds memory on very long texts


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every k-word shingle (words split at ASCII white space, A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())], np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Bit i is 1 where over half of the shingle hashes have it set (as a signed 64-bit integer)."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), VOTE_ROWS):
        bits = np.unpackbits(h[a:a + VOTE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    word = np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0]
    return int(word.astype(np.int64))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document."""
    def run(batches):
        C.let_go()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": np.array(
                [fingerprint(t.encode("utf-8", "replace"), k) for t in pdf.text], np.int64)})
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """XOR masks of every 64-bit word with at most ``radius`` bits set, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct verified links (src, dst) between distinct fingerprints, enough to connect every pair
    within ``max_bits``.  Two fingerprints at an odd distance meet within the half rounded up."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball((max_bits + 1) // 2)])
    variants = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    if max_bits % 2:  # buckets then also hold pairs beyond max_bits: every pair is verified, in the bucket's bounded ball
        a, b = variants.alias("a"), variants.alias("b")
        pairs = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp"))).select(
            F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    else:
        prev = F.lag("fp").over(W.partitionBy("v").orderBy("fp"))
        pairs = variants.select(prev.alias("src"), F.col("fp").alias("dst")).filter(F.col("src").isNotNull())
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    return pairs.filter(near).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``max_bits`` bits."""
    prints = C.materialize(fingerprints(docs, k), "fingerprints")
    reps = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "representatives")
    edges = links(reps.select("fp"), max_bits)
    named = (edges.join(reps.select(F.col("fp").alias("src"), F.col("node").alias("a")), "src")
                  .join(reps.select(F.col("fp").alias("dst"), F.col("node").alias("b")), "dst").select("a", "b"))
    comp = components(named)  # node, component; only nodes with a link
    label = reps.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")
