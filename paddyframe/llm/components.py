"""Connected components of a link table by alternating large-star / small-star rounds.

Every round moves links towards the smallest node reachable; rounds end when
nothing changes, which takes a number of rounds logarithmic in the longest
chain.  Each round is two aggregations and two joins on Spark and is written to the
shared folder, so lost executors cost one round at most.  The centre of a large
star is a hot key: its aggregation combines map-side and its join is left to
the adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (a, b) links with a > b."""
    if large:   # every node tells its larger neighbours its smallest neighbour (or itself)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:       # every node tells its smaller neighbours (and itself) the smallest of them
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        mine = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        out = mine.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); component is the smallest node."""
    a, b = links.columns
    edges = C.materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                               .filter("a <> b").distinct(), "links")
    before = None
    while True:
        edges = C.materialize(_star(_star(edges, True), False), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())
