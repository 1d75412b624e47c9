"""Exact ranks and running totals per group without funnelling a group through one task.

A window ``partitionBy(group).orderBy(v)`` sorts every group inside a single
task, which fails when one group holds a third of the table.  Here the order
column is cut into ranges at literal bounds (approximate quantiles of the whole
table, computed once), so a row's block is a pure function of its own values:
every branch of a plan and every retried task agrees on it.  Windows run per
(group, block); block totals - one small row per (group, block) - get exclusive
offsets, which are joined back.  A block holds at most about ``rows / blocks``
rows, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 50   # quantile accuracy per block


def _position(df: DataFrame, col: str) -> Column:
    """The order column as a double (times as seconds)."""
    kind = df.schema[col].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


def block_of(df: DataFrame, order_col: str, blocks: int | None = None) -> Column:
    """Number of the order column's range: how many literal quantile bounds lie below the value."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if n < 2:
        return F.lit(0)
    at = _position(df, order_col)
    found = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], ACCURACY * n)).first()[0] or []
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # binary search in the constant array
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(
        (lo + s <= len(bounds)) & (F.try_element_at(table, lo + s) < at), lo + s).otherwise(lo))


def _with_offsets(rows: DataFrame, totals: DataFrame, group_cols: list[str], agg, total: str) -> DataFrame:
    """Rows with ``_off``: the aggregate of all earlier blocks of their group (NULL-safe in the keys).

    Blocks, never NULL, are compared NULL-safely too: from a plain equality the optimizer infers a filter
    on the totals out of the block's formula, and where the order column's attribute id equals one that Spark
    gives lambda variables for comparing plans (the first ids of a session), that filter keeps a column the totals lack.
    """
    w = Window.partitionBy(*group_cols).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    b = totals.withColumn("_off", agg(total).over(w)).select(
        F.col("_block").alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in group_cols], "_off")
    cond = [rows["_block"].eqNullSafe(b["_b"])] + [rows[c].eqNullSafe(b[f"_b_{c}"]) for c in group_cols]
    return rows.join(b, cond, "inner").drop("_b", *[f"_b_{c}" for c in group_cols])


def value_ranks(df: DataFrame, group_cols: list[str], order_col: str, blocks: int | None = None) -> DataFrame:
    """(group, value, ``n``, ``first_rank``, ``last_rank``): the 1-based ranks that each distinct value takes
    in its group, ascending.  Equal values are counted before the shuffle, so ties are one row."""
    counts = df.groupBy(*group_cols, order_col).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_block", block_of(df, order_col, blocks))
    local = Window.partitionBy("_block", *group_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy("_block", *group_cols).agg(F.sum("n").alias("_tot"))
    out = _with_offsets(counts.withColumn("_run", F.sum("n").over(local)), totals, group_cols, F.sum, "_tot")
    last = F.coalesce(F.col("_off"), F.lit(0)) + F.col("_run")
    return out.select(*group_cols, order_col, "n", (last - F.col("n") + 1).alias("first_rank"), last.alias("last_rank"))


def prefix_scan(df: DataFrame, group_cols: list[str], order_col: str, value_col: str, op: str = "sum",
                out: str = "_scan", num_partitions: int | None = None, block: Column | None = None) -> DataFrame:
    """Inclusive running ``sum`` / ``max`` of ``value_col`` per group in ``order_col`` order.

    ``order_col`` must be unique within a group; every input row comes out once.
    ``block`` reuses the ranges of an earlier ``block_of`` over the same order column.
    """
    agg = {"sum": F.sum, "max": F.max}[op]
    rows = df.withColumn("_block", block_of(df, order_col, num_partitions) if block is None else block)
    local = Window.partitionBy("_block", *group_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_block", *group_cols).agg(agg(value_col).alias("_tot"))
    res = _with_offsets(rows.withColumn("_loc", agg(value_col).over(local)), totals, group_cols, agg, "_tot")
    if op == "sum":
        val = F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.col("_loc"), F.lit(0))
        val = F.when(F.col("_off").isNull() & F.col("_loc").isNull(), F.lit(None)).otherwise(val)
    else:
        val = F.greatest(F.col("_off"), F.col("_loc"))
    return res.withColumn(out, val).drop("_block", "_loc", "_off")
