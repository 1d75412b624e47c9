"""Scoring and explanation (survey 2.I).

All targets are scored in one job: the targets DataFrame is joined to the
(extended) panel, so the per-call "re-read the whole training set" of a
row-at-a-time scorer becomes one distributed pass.  Coefficients come from a
coefficient table with one row per feature (bounded by the feature count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period_label, py_round
from . import clean, features as feat, rollup

MARKET_COLS = ["price_lag1", "price_lag12", "yield_lag1", "production_lag1", "hist_yield", "hist_price"]


def score_features(panel_raw: DataFrame, targets: DataFrame, weather_vars: list[str], categories: list[str],
                   entity_col: str = "entity_id", name_col: str = "entity_name",
                   market_cols: list[str] = MARKET_COLS, prefix: str = "prov") -> DataFrame:
    """Feature rows for many (entity, year, month) targets at once.

    ffill/bfill market columns per entity (F7); months after the entity's last row
    up to its target are appended (D10) with weather = the entity's calendar-month
    climatology (E6, missing -> 0) and every other column copied from the last row;
    then antecedent lags, growing season, season flags, cyclical month (F2-F6),
    one-hot (D5), target row or last row (F8, ``is_fallback``), NULL -> 0 (B16).
    """
    base = feat.ffill_bfill(panel_raw, market_cols, entity_col)
    clim = rollup.climatology(base, [entity_col], weather_vars)
    ext = clean.extend_periods(base, targets, entity_col)
    w_last = Window.partitionBy(entity_col).orderBy(F.col("year").desc(), F.col("month").desc())
    last = base.withColumn("_rn", F.row_number().over(w_last)).filter("_rn = 1").drop("_rn", "year", "month",
                                                                                   *weather_vars)
    synth = (ext.join(clim, [entity_col, "month"], "left")
             .fillna(0.0, subset=weather_vars)
             .join(last, entity_col, "inner"))
    full = base.withColumn("_synth", F.lit(0)).unionByName(
        synth.select(*base.columns).withColumn("_synth", F.lit(1)))
    full = feat.antecedent_lags(full, weather_vars, entity_col=entity_col)
    full = feat.growing_season(full, weather_vars, entity_col=entity_col)
    full = feat.season_interaction(full)
    full = feat.with_cyclical_month(full)
    full = clean.one_hot(full, name_col, categories, prefix)
    # a future target picks its appended row; a missing past target falls back to the last real row
    picked = feat.target_or_last(full, targets.select(entity_col, "year", "month"), entity_col,
                                 synthetic_col="_synth").drop("_synth")
    num = [f.name for f in picked.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in (entity_col,)]
    return picked.fillna(0, subset=num)


def coef_map(coefs: DataFrame) -> list[tuple[str, float, float, float]]:
    """Collect a coefficient table (one row per feature: bounded by the model size)."""
    return [(r["feature"], float(r["mean"]), float(r["std"]), float(r["coef"]))
            for r in coefs.select("feature", "mean", "std", "coef").collect()]


def linear_expr(terms, intercept: float):
    """``intercept + sum(coef * (x - mean) / std)`` in a fixed term order."""
    e = F.lit(float(intercept))
    for f, m, s, c in terms:
        e = e + F.lit(c) * ((F.col(f).cast("double") - F.lit(m)) / F.lit(s))
    return e


def predict_batch(rows: DataFrame, terms, intercept: float, digits: int = 2, out: str = "prediction") -> DataFrame:
    """Linear prediction, clamped at 0 and rounded."""
    return rows.withColumn(out, py_round(F.greatest(F.lit(0.0), linear_expr(terms, intercept)), digits))


def contributions(rows: DataFrame, keys: list[str], terms) -> DataFrame:
    """Long (keys, feature, raw_value, contribution) with contribution = scaled value x coef."""
    parts = []
    for i, (f, m, s, c) in enumerate(terms):
        parts += [F.lit(f), F.col(f).cast("double"),
                  F.lit(c) * ((F.col(f).cast("double") - F.lit(m)) / F.lit(s))]
    n = len(terms)
    names = []
    sel = []
    for i in range(n):
        for j, col in enumerate(parts[3 * i: 3 * i + 3]):
            nm = f"_c{i}_{j}"
            names.append(nm)
            sel.append(col.alias(nm))
    stack = ", ".join(f"_c{i}_0, _c{i}_1, _c{i}_2" for i in range(n))
    return rows.select(*keys, *sel).select(
        *keys, F.expr(f"stack({n}, {stack}) AS (feature, raw_value, contribution)"))


def explain_top(contrib: DataFrame, keys: list[str], k: int = 4, year_col: str = "year",
                month_col: str = "month") -> DataFrame:
    """Top-k positive and top-k negative drivers per row, zeros dropped, rounded (I4)."""
    c = contrib.filter(F.col("contribution") != 0).withColumn(
        "direction", F.when(F.col("contribution") > 0, "UP").otherwise("DOWN"))
    w = Window.partitionBy(*keys, "direction").orderBy(
        F.when(F.col("direction") == "UP", -F.col("contribution")).otherwise(F.col("contribution")), F.col("feature"))
    top = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(*keys, period_label(year_col, month_col).alias("target_period"), "direction", "rank", "feature",
                      py_round("raw_value", 2).alias("current_value"), py_round("contribution", 3).alias("impact_score"))
