"""Window functions and time-series features (survey 2.F).

All windows partition by the entity and order by (year, month).  They run on
monthly panels that are already aggregated (entity x month rows), so a
partition holds one entity's calendar - bounded by the number of months, not
by the size of the raw tables.  Lags sharing one ``WindowSpec`` are evaluated
after a single Exchange + Sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cyclical_month, member_flag, month_ordinal

# --- fixed values: wet-season months and the season-interacted variables ----
SEASON_WET_MONTHS = (6, 7, 8, 9, 10, 11)
SEASON_INTERACTED = ("precipitation_sum", "soil_moisture_0_to_100cm_mean")
# weather variables of the feature set, in training order
WEATHER_VARS = [
    "precipitation_sum",
    "temperature_2m_mean", "temperature_2m_max", "temperature_2m_min",
    "surface_pressure_mean", "soil_moisture_0_to_100cm_mean",
    "wind_gusts_10m_max", "et0_fao_evapotranspiration", "shortwave_radiation_sum",
    "extreme_rain_days", "extreme_heat_days",
]
# ---------------------------------------------------------------------------


def entity_window(entity_col: str = "entity_id", year_col: str = "year", month_col: str = "month"):
    return Window.partitionBy(entity_col).orderBy(year_col, month_col)


def calendar_window(entity_col: str = "entity_id", ordinal_col: str = "_ym"):
    return Window.partitionBy(entity_col).orderBy(ordinal_col)


def lag_features(df: DataFrame, spec: dict, entity_col: str = "entity_id",
                 year_col: str = "year", month_col: str = "month") -> DataFrame:
    """Row-based ``LAG(col, k)`` per entity (F1). ``spec = {out: (col, k)}``."""
    w = entity_window(entity_col, year_col, month_col)
    return df.withColumns({out: F.lag(c, k).over(w) for out, (c, k) in spec.items()})


MARKET_LAGS = {
    "price_lag1": ("price", 1),
    "price_lag12": ("price", 12),
    "yield_lag1": ("yield_rate", 1),
    "hist_yield": ("yield_rate", 12),
    "production_lag1": ("volume", 1),
    "hist_price": ("price", 12),
}


def antecedent_lags(df: DataFrame, variables: list[str], max_lag: int = 4,
                    entity_col: str = "entity_id", year_col: str = "year", month_col: str = "month",
                    calendar: bool = False) -> DataFrame:
    """``{v}_lag1..{v}_lag{max_lag}`` for every variable (F2).

    Row-based by default (a gap shifts the lag, as the reference does); with
    ``calendar=True`` the lag is the value exactly k months earlier.
    """
    if not calendar:
        w = entity_window(entity_col, year_col, month_col)
        return df.withColumns({f"{v}_lag{k}": F.lag(v, k).over(w)
                               for v in variables if v in df.columns for k in range(1, max_lag + 1)})
    d = df.withColumn("_ym", month_ordinal(year_col, month_col))
    cols = {}
    for v in variables:
        if v not in df.columns:
            continue
        for k in range(1, max_lag + 1):
            wk = calendar_window(entity_col).rangeBetween(-k, -k)
            cols[f"{v}_lag{k}"] = F.first(v).over(wk)
    return d.withColumns(cols).drop("_ym")


def _is_sum_var(v: str, extra: tuple = ()) -> bool:
    return "sum" in v or "days" in v or any(t in v for t in extra)


def growing_season(df: DataFrame, variables: list[str], months: int = 4,
                   entity_col: str = "entity_id", year_col: str = "year", month_col: str = "month") -> DataFrame:
    """Aggregate over t-months..t-1 (F3): sum for sum/days/et0 variables, else mean.

    NULL unless all ``months`` values are present (full-window guard).
    """
    w = entity_window(entity_col, year_col, month_col).rowsBetween(-months, -1)
    cols = {}
    for v in variables:
        if v not in df.columns:
            continue
        agg = F.sum(v) if _is_sum_var(v, ("et0",)) else F.avg(v)
        cols[f"{v}_gs"] = F.when(F.count(v).over(w) == months, agg.over(w).cast("double"))
    return df.withColumns(cols)


def trailing_windows(df: DataFrame, variables: list[str], sizes=(1, 2, 3),
                     entity_col: str = "entity_id", year_col: str = "year", month_col: str = "month") -> DataFrame:
    """Trailing n-month windows ending at t (F4): ``{v}_{n}m``; sum for sum/days, else mean."""
    base = entity_window(entity_col, year_col, month_col)
    cols = {}
    for v in variables:
        if v not in df.columns:
            continue
        for n in sizes:
            if n == 1:
                cols[f"{v}_1m"] = F.col(v)
                continue
            w = base.rowsBetween(-(n - 1), 0)
            agg = F.sum(v) if _is_sum_var(v) else F.avg(v)
            cols[f"{v}_{n}m"] = F.when(F.count(v).over(w) == n, agg.over(w).cast("double"))
    return df.withColumns(cols)


def season_interaction(df: DataFrame, month_col: str = "month", wet_months=SEASON_WET_MONTHS,
                       interacted=SEASON_INTERACTED) -> DataFrame:
    """``is_wet`` flag and ``{v}_gs_wet = {v}_gs * is_wet``."""
    out = df.withColumn("is_wet", member_flag(month_col, wet_months))
    return out.withColumns({f"{v}_gs_wet": F.col(f"{v}_gs") * F.col("is_wet")
                            for v in interacted if f"{v}_gs" in out.columns})


def with_cyclical_month(df: DataFrame, month_col: str = "month") -> DataFrame:
    """``month_sin`` / ``month_cos``."""
    s, c = cyclical_month(month_col)
    return df.withColumns({"month_sin": s, "month_cos": c})


def ffill_bfill(df: DataFrame, cols: list[str], entity_col: str = "entity_id",
                year_col: str = "year", month_col: str = "month") -> DataFrame:
    """Forward fill then backward fill per entity."""
    w = entity_window(entity_col, year_col, month_col)
    fwd = w.rowsBetween(Window.unboundedPreceding, 0)
    bwd = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(fwd),
                                         F.first(c, ignorenulls=True).over(bwd)) for c in cols})


def target_or_last(df: DataFrame, targets: DataFrame, entity_col: str = "entity_id",
                   year_col: str = "year", month_col: str = "month", synthetic_col: str | None = None) -> DataFrame:
    """Per target (entity, year, month): the matching row, else the entity's last row (F8).

    ``is_fallback`` marks rows that are not the requested period.  With
    ``synthetic_col`` (1 = appended future row) the fallback prefers real rows,
    so a missing past target falls back to the last observed month.
    """
    t = targets.select(entity_col, F.col(year_col).alias("target_year"), F.col(month_col).alias("target_month"))
    j = df.join(t, on=entity_col, how="inner")
    hit = ((F.col(year_col) == F.col("target_year")) & (F.col(month_col) == F.col("target_month"))).cast("int")
    order = [hit.desc()] + ([F.col(synthetic_col).asc()] if synthetic_col else []) + \
        [F.col(year_col).desc(), F.col(month_col).desc()]
    w = Window.partitionBy(entity_col, "target_year", "target_month").orderBy(*order)
    return (j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .withColumn("is_fallback", ~((F.col(year_col) == F.col("target_year"))
                                         & (F.col(month_col) == F.col("target_month"))))
            .drop("_rn"))


def next_month(year="year", month="month"):
    """Month rollover (F10): returns (year, month) columns of the following month."""
    o = month_ordinal(year, month, 1)
    return F.floor(o / 12).cast("int"), (F.pmod(o, F.lit(12)) + 1).cast("int")


# --------------------------------------------------------------------------
# temporal disaggregation (quarter -> month), additive Denton-Cholette.
# --------------------------------------------------------------------------

def _denton_cholette(q: np.ndarray, per: int = 3) -> np.ndarray:
    """Minimise the sum of squared first differences subject to block sums == q (h=1), in time linear in the blocks.

    The optimality system is block tridiagonal: a block holds a quarter's ``per`` values and its multiplier, and only
    a quarter's last value meets the next one's first.  Elimination from the first block on therefore changes a single
    entry of each, and substitution from the last block back gives the values.
    """
    nq, k = len(q), per + 1
    if nq == 0:
        return np.zeros(0)
    inner = np.zeros((k, k))
    inner[:per, :per] = 2.0 * (2.0 * np.eye(per) - np.eye(per, k=1) - np.eye(per, k=-1))
    inner[:per, per] = inner[per, :per] = 1.0
    inverses, rights = np.zeros((nq, k, k)), np.zeros((nq, k))
    rights[:, per] = q
    for i in range(nq):
        block = inner.copy()
        if i == 0:
            block[0, 0] -= 2.0              # the first value has no difference before it
        else:
            block[0, 0] -= 4.0 * inverses[i - 1, per - 1, per - 1]
            rights[i, 0] += 2.0 * (inverses[i - 1, per - 1] @ rights[i - 1])
        if i == nq - 1:
            block[per - 1, per - 1] -= 2.0  # nor the last one after it
        inverses[i] = np.linalg.inv(block)
    out = np.zeros((nq, k))
    for i in range(nq - 1, -1, -1):
        if i < nq - 1:
            rights[i, per - 1] += 2.0 * out[i + 1, 0]
        out[i] = inverses[i] @ rights[i]
    return out[:, :per].ravel()


def disaggregate(quarterly: DataFrame, series_cols: list[str], value_col: str,
                 year_col: str = "year", quarter_col: str = "quarter") -> DataFrame:
    """Quarterly totals -> monthly values per series, sums preserved.

    One linear-time solve per series inside ``applyInPandas``: a series is a
    calendar, so a group is bounded by time, and different series run in parallel tasks.
    """
    out_schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in quarterly.schema.fields
                            if f.name in series_cols] + [f"{year_col} int", "month int", f"{value_col} double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([year_col, quarter_col])
        x = _denton_cholette(pdf[value_col].to_numpy(dtype=float))
        years = np.repeat(pdf[year_col].to_numpy(), 3)
        months = (np.repeat(pdf[quarter_col].to_numpy(), 3) - 1) * 3 + np.tile([1, 2, 3], len(pdf))
        res = pd.DataFrame({year_col: years.astype("int32"), "month": months.astype("int32"), value_col: x})
        for c in series_cols:
            res.insert(0, c, pdf[c].iloc[0])
        return res[series_cols + [year_col, "month", value_col]]

    return (quarterly.select(*series_cols, year_col, quarter_col, value_col)
            .groupBy(*series_cols).applyInPandas(solve, schema=out_schema))


def disaggregation_errors(monthly: DataFrame, quarterly: DataFrame, series_cols: list[str], value_col: str,
                          year_col: str = "year", quarter_col: str = "quarter") -> DataFrame:
    """Per series and quarter of a disaggregation: ``sum_error``, how far the months miss the quarter's total, and
    ``stationarity_error``, how far the derivatives of the sum of squared differences differ between the quarter's months
    (at the optimum each equals the quarter's multiplier)."""
    w = Window.partitionBy(*series_cols).orderBy(year_col, "month")
    v = F.col(value_col)
    before, after = v - F.lag(v).over(w), F.lead(v).over(w) - v
    slope = F.coalesce(before, F.lit(0.0)) - F.coalesce(after, F.lit(0.0))
    by = [*series_cols, year_col, quarter_col]
    months = monthly.withColumn("_slope", slope).withColumn(quarter_col, F.floor((F.col("month") - 1) / 3).cast("int") + 1)
    told = months.groupBy(*by).agg(F.sum(v).alias("_sum"), (F.max("_slope") - F.min("_slope")).alias("stationarity_error"))
    return told.join(quarterly.select(*by, value_col), by).withColumn("sum_error", F.abs(F.col("_sum") - v)).drop("_sum")
