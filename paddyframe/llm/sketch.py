"""Threshold-scaled document fingerprints (DataFrame functions only).

A document's sketch is every hash of its word shingles below a fixed fraction
of the hash range.  The rule is per hash, so the sketch of a union is the union
of the sketches, sketches of very unequal documents stay comparable, and
|A & B| / min(|A|, |B|) estimates how much of the smaller document the larger
one contains.  The smallest hash is always kept, so no non-empty text has an
empty sketch (merging keeps this: drop a smallest hash above the threshold once
another one lies below it).

Defined cases: a null text is empty; a text without words has the empty sketch
(likeness 1 with another empty sketch, 0 with any other); fewer words than the
shingle length make one shingle of all words; equal texts have equal sketches;
the only document is its own next one; rows that repeat a doc_id follow one
another in the order of their texts' hashes; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
FRACTION = 0.25
BUCKETS_PER_PARTITION = 2
MAX_BUCKETS = 1 << 14


def sketch(text: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the fraction (and the smallest one), as array<long>."""
    low = -(1 << 63)
    limit = F.lit(int(low + fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1).cast("long")
    none = F.array().cast("array<long>")
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        rolled = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) > k, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    def keep(s: Column) -> Column:
        least = F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(none)
        return F.array_sort(F.array_distinct(F.concat(F.filter(s, lambda x: x <= limit), least)))

    # a one-element transform binds each array once
    return F.transform(F.transform(F.array(hashes), shingles), keep)[0]


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the two documents' shingles together."""
    limit = F.lit(int(-(1 << 63) + fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1).cast("long")
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x <= limit)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch found in the other (1 for two empty sketches)."""
    least = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / least)).cast("double")


def as_string(s: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _bucket(bounds: list[int], key: Column) -> Column:
    """Number of sorted bounds below the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.try_element_at(arr, at + s) < key), at + s).otherwise(at))


def with_next(docs: DataFrame, cols: list[str], key: str = "doc_id",
              derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every row with ``next``: the struct of ``cols`` of the following row in ascending key order (last: first).
    ``derive`` may add columns among them.

    Keys are cut into ranges at quantile bounds, each range is one window
    partition, and the first row of each range is repeated as a sentinel at the
    end of the range before it.
    """
    spark = docs.sparkSession
    n = min(MAX_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    at = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    rows = docs.withColumn("_bucket", _bucket(sorted(set(at)), F.col(key))).withColumn("_tail", F.lit(0))
    # the smallest key of every range: one small row per range
    heads = rows.groupBy("_bucket").agg(F.min(key).alias("_head"))
    order = W.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(before.alias("_before"), "_head")  # at most MAX_BUCKETS rows: small enough to broadcast
    tie = F.xxhash64(*[c for c in cols if c in docs.columns])
    tails = (docs.join(F.broadcast(heads), F.col(key) == F.col("_head"))
             .withColumn("_n", F.row_number().over(W.partitionBy("_before").orderBy(tie))).filter("_n = 1")
             .drop("_n", "_head").withColumnRenamed("_before", "_bucket").withColumn("_tail", F.lit(1)))
    both = derive(rows.unionByName(tails))
    nxt = F.lead(F.struct(*cols)).over(W.partitionBy("_bucket").orderBy("_tail", key, tie))
    return both.withColumn("next", nxt).filter("_tail = 0").drop("_bucket", "_tail")


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketch of each document, of its edited text (last half replaced by the next document's start),
    and their likeness."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(slim, ["text", "sketch"], derive=lambda rows: rows.withColumn("sketch", sketch(F.col("text"), k, fraction)))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited"),
                        F.col("next.sketch").alias("next_sketch"))
    out = out.withColumn("edited_sketch", sketch(F.col("edited"), k, fraction))
    return out.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch",
                      containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
