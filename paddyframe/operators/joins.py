"""Joins (survey 2.C).

Broadcast policy: a side is hinted with ``broadcast()`` only when its size is
bounded by construction (a literal rule/phrase table, a calendar spine).  Data
derived dimensions are left to AQE, which measures the shuffled size at run
time and switches to a broadcast hash join only below
``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it the plan stays a
sort-merge join, and skewed partitions are split by the AQE skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_ordinal

PERIOD = ["year", "month"]


def market_summary(production: DataFrame, dim: DataFrame, prices: DataFrame,
                   entity_col: str = "entity_id") -> DataFrame:
    """Fact -> dim INNER, fact -> fact LEFT on (entity, year, month)."""
    return (production.join(dim, on=entity_col, how="inner")
            .join(prices, on=[entity_col, *PERIOD], how="left"))


def full_dataset(weather: DataFrame, dim: DataFrame, features: DataFrame,
                 entity_col: str = "entity_id", by: str | None = None) -> DataFrame:
    """Weather INNER dim, LEFT feature view on (entity, year, month).

    ``by`` picks the key used against the feature view (``entity_col`` by id, or the
    entity name column as the training query does).
    """
    by = by or entity_col
    w = weather.join(dim, on=entity_col, how="inner")
    feats = features.drop(*[c for c in features.columns
                            if c in w.columns and c not in (by, *PERIOD)])
    return w.join(feats, on=[by, *PERIOD], how="left")


def entities_with_data(dim: DataFrame, fact: DataFrame, entity_col: str = "entity_id") -> DataFrame:
    """Dimension rows that have at least one fact row (C3): a left-semi join."""
    return dim.join(fact.select(entity_col), on=entity_col, how="left_semi")


def inner_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multi-key inner merge of two facts (C4)."""
    return left.join(right, on=keys, how="inner")


def lag_join(weather: DataFrame, outcomes: DataFrame, lag: int = 0,
             entity_col: str = "entity_id") -> DataFrame:
    """Weather at month t paired with the outcome at month t + lag.

    Calendar-exact: the join key is the month ordinal, so gaps drop rows instead
    of shifting them.  Output keeps the weather period (year, month).
    """
    w = weather.withColumn("_ym", month_ordinal("year", "month", lag))
    o = outcomes.withColumn("_ym", month_ordinal("year", "month")).drop(*PERIOD)
    return w.join(o, on=[entity_col, "_ym"], how="inner").drop("_ym")


def key_lookup(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str, id_col: str) -> DataFrame:
    """Surrogate-key lookup, unmatched rows dropped."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(id_col))
    return df.join(d, df[left_key] == d["_k"], "inner").drop("_k")


def key_lookup_ci(df: DataFrame, dim: DataFrame, left_keys: list[str], dim_keys: list[str],
                  id_col: str) -> DataFrame:
    """Composite case-insensitive lookup, e.g. (city, province) -> id."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    d = dim.select(*[norm(c).alias(f"_k{i}") for i, c in enumerate(dim_keys)], F.col(id_col))
    l = df.select("*", *[norm(c).alias(f"_l{i}") for i, c in enumerate(left_keys)])
    cond = [l[f"_l{i}"] == d[f"_k{i}"] for i in range(len(left_keys))]
    out = l.join(d, cond, "inner")
    return out.drop(*[f"_l{i}" for i in range(len(left_keys))], *[f"_k{i}" for i in range(len(dim_keys))])


def map_group_stat(df: DataFrame, stat: DataFrame, key: str) -> DataFrame:
    """Group statistic mapped back onto rows (C10); rows without a group stat get NULL."""
    return df.join(stat, on=key, how="left")
