"""Data-quality checks (survey 2.M): one aggregation per table, stacked into check rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: list[tuple[str, object, object]]) -> DataFrame:
    """Evaluate ``(name, ok_expr, detail_expr)`` aggregate checks in one pass -> (name, ok, detail)."""
    aggs = []
    for i, (_, ok, detail) in enumerate(checks):
        aggs += [ok.alias(f"_ok{i}"), detail.cast("string").alias(f"_d{i}")]
    parts = ", ".join(f"'{n}', _ok{i}, _d{i}" for i, (n, _, _) in enumerate(checks))
    return df.agg(*aggs).select(F.expr(f"stack({len(checks)}, {parts}) AS (name, ok, detail)"))


def dq_report(*reports: DataFrame) -> DataFrame:
    """Union of check tables + passed / total (M1)."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    tot = out.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
    summary = tot.select(F.lit("passed/total").alias("name"), (F.col("passed") == F.col("total")).alias("ok"),
                         F.concat_ws("/", F.col("passed").cast("string"), F.col("total").cast("string")).alias("detail"))
    return out.unionByName(summary)


def dq_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once (M2 unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dq_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose foreign key has no parent (M2 foreign key); a NULL key is no orphan."""
    p = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")


def dq_domain(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Rows whose value is NULL or outside [lo, hi] (M2 domain, e.g. month 1-12)."""
    return df.filter(F.col(col).isNull() | ~F.col(col).between(lo, hi))
