"""Parquet table scans (A3).

Reads are lazy: Catalyst prunes columns to what the plan uses and pushes
filters into the parquet scan (``PushedFilters`` in ``explain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` -> DataFrame."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.base, name)
        raise AttributeError(name)


def scan_filter(df: DataFrame, entity_col: str | None = None, entity_id=None,
                year_col: str = "year", start_year: int | None = None,
                end_year: int | None = None) -> DataFrame:
    """Parameter predicates on entity and a year range (A3/B3); pushed to the scan."""
    cond = F.lit(True)
    if entity_col is not None and entity_id is not None:
        cond = cond & (F.col(entity_col) == F.lit(entity_id))
    if start_year is not None:
        cond = cond & (F.col(year_col) >= F.lit(start_year))
    if end_year is not None:
        cond = cond & (F.col(year_col) <= F.lit(end_year))
    return df.filter(cond)
