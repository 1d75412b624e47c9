"""Lag-aligned Pearson correlation (survey 2.G).

One distributed pipeline replaces the per-entity loop: align weather and
outcomes with an equi-join on the shifted month ordinal, then compute every
(variable, outcome) coefficient in a single aggregation.  Pairs are masked
pairwise (a row counts for a pair only when both values are present) and
``r = covar_pop / (stddev_pop * stddev_pop)`` through ``try_divide``, so a
constant column yields NULL instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import inner_merge, lag_join

# --- fixed values: outcome enum -> fact column, weather slot enum -> variable
OUTCOME_COLUMNS = {
    "YIELD": "yield_rate",
    "PRODUCTION": "volume",
    "PRICE": "price",
}
WEATHER_VAR_MAP = {
    "RAINFALL": "precipitation_sum",
    "MEAN_TEMP": "temperature_2m_mean",
    "MAX_TEMP": "temperature_2m_max",
    "MIN_TEMP": "temperature_2m_min",
    "SOIL_MOISTURE": "soil_moisture_0_to_100cm_mean",
    "SURFACE_PRESSURE": "surface_pressure_mean",
}
# ---------------------------------------------------------------------------


def aligned_frame(weather: DataFrame, production: DataFrame, prices: DataFrame, lag: int = 0,
                  start_date: str = "2012-01-01", end_date: str = "2026-07-31",
                  entities: DataFrame | None = None, entity_col: str = "entity_id") -> DataFrame:
    """Weather + outcomes aligned per entity at a lag (G1).

    Outcomes are filtered by whole years (``year BETWEEN``), weather by the exact
    month range of the dates, as the reference does (outcomes past the end year are
    cut, so the last ``lag`` months vanish).  ``entities`` (optional) restricts and
    labels the entities (e.g. a case-insensitive name filter result).
    """
    sy, ey = int(start_date[:4]), int(end_date[:4])
    s_ord = F.lit(sy * 12 + int(start_date[5:7]) - 1)
    e_ord = F.lit(ey * 12 + int(end_date[5:7]) - 1)
    w = weather.filter((F.col("year") * 12 + F.col("month") - 1).between(s_ord, e_ord))
    outcomes = inner_merge(production.filter(F.col("year").between(sy, ey)),
                           prices.filter(F.col("year").between(sy, ey)),
                           [entity_col, "year", "month"])
    al = lag_join(w, outcomes, lag, entity_col)
    if entities is not None:
        al = al.join(entities, on=entity_col, how="inner")
    return al


def _pair_aggs(variables: list[str], outcome_cols: list[str], prefix: str = "", with_n: bool = False):
    aggs = []
    for i, v in enumerate(variables):
        for j, o in enumerate(outcome_cols):
            both = F.col(v).isNotNull() & F.col(o).isNotNull() & ~F.isnan(v) & ~F.isnan(o)
            x, y = F.when(both, F.col(v)), F.when(both, F.col(o))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(r.alias(f"_r_{i}_{j}"))
            if with_n:
                aggs.append(F.count_if(both).alias(f"_n_{i}_{j}"))
    return aggs


def _stack(wide: DataFrame, keys: list[str], variables: list[str], outcomes: list[str]) -> DataFrame:
    """Long -> wide matrix (D4): rows = (keys, variable), columns = outcomes."""
    parts = []
    for i, v in enumerate(variables):
        parts.append(f"'{v}'")
        parts += [f"_r_{i}_{j}" for j in range(len(outcomes))]
    cols = ", ".join(["weather_variable"] + list(outcomes))
    return wide.select(*keys, F.expr(f"stack({len(variables)}, {', '.join(parts)}) AS ({cols})"))


def corr_pooled(aligned: DataFrame, variables: list[str], outcomes=("YIELD", "PRODUCTION", "PRICE"),
                outcome_map: dict = OUTCOME_COLUMNS) -> DataFrame:
    """Pooled r over all entities (G2): rows = variables, columns = outcomes."""
    ocols = [outcome_map[o] for o in outcomes]
    wide = aligned.agg(*_pair_aggs(variables, ocols))
    return _stack(wide, [], variables, list(outcomes))


def corr_by_entity(aligned: DataFrame, variables: list[str], outcomes=("YIELD", "PRODUCTION", "PRICE"),
                   entity_col: str = "entity_name", outcome_map: dict = OUTCOME_COLUMNS) -> DataFrame:
    """Per-entity r (G3): rows = (entity, variable), columns = outcomes."""
    ocols = [outcome_map[o] for o in outcomes]
    wide = aligned.groupBy(entity_col).agg(*_pair_aggs(variables, ocols))
    return _stack(wide, [entity_col], variables, list(outcomes))


def corr_long(aligned: DataFrame, variables: list[str], outcomes, keys: list[str],
              outcome_map: dict = OUTCOME_COLUMNS, min_n: int = 2) -> DataFrame:
    """Long table (keys, variable, outcome, n, r); r is NULL when n < ``min_n``."""
    ocols = [outcome_map[o] for o in outcomes]
    wide = aligned.groupBy(*keys).agg(*_pair_aggs(variables, ocols, with_n=True))
    parts = []
    for i, v in enumerate(variables):
        for j, o in enumerate(outcomes):
            parts.append(f"'{v}', '{o}', _n_{i}_{j}, _r_{i}_{j}")
    n_pairs = len(variables) * len(outcomes)
    out = wide.select(*keys, F.expr(f"stack({n_pairs}, {', '.join(parts)}) AS (weather_variable, outcome, n, r)"))
    return out.withColumn("r", F.when(F.col("n") >= min_n, F.col("r")))


def corr_detailed(weather: DataFrame, production: DataFrame, prices: DataFrame, variables: list[str],
                  outcomes, start_date: str, end_date: str, entities: DataFrame, lag: int = 4,
                  entity_col: str = "entity_name"):
    """Observations and r at the selected lag (G4); returns (observations, coefficients)."""
    obs = aligned_frame(weather, production, prices, lag, start_date, end_date, entities)
    coeffs = corr_long(obs, variables, outcomes, [entity_col]).withColumn("lag", F.lit(lag))
    return obs, coeffs


def corr_lag_scan(weather: DataFrame, production: DataFrame, prices: DataFrame, variables: list[str],
                  outcomes, lags, start_date: str = "1900-01-01", end_date: str = "2999-12-31",
                  entity_col: str = "entity_name", entities: DataFrame | None = None) -> DataFrame:
    """r at every lag in one job (G5): long (lag, entity, variable, outcome, n, r).

    The weather side is replicated once per lag by exploding a literal lag array
    (bounded by the lag list), then a single equi-join and a single aggregation.
    """
    sy, ey = int(start_date[:4]), int(end_date[:4])
    s_ord = sy * 12 + int(start_date[5:7]) - 1
    e_ord = ey * 12 + int(end_date[5:7]) - 1
    wt = (weather.filter((F.col("year") * 12 + F.col("month") - 1).between(s_ord, e_ord))
          .withColumn("lag", F.explode(F.array(*[F.lit(int(l)) for l in lags])))
          .withColumn("_ym", F.col("year") * 12 + F.col("month") - 1 + F.col("lag")))
    out = inner_merge(production.filter(F.col("year").between(sy, ey)),
                      prices.filter(F.col("year").between(sy, ey)), ["entity_id", "year", "month"])
    out = out.withColumn("_ym", F.col("year") * 12 + F.col("month") - 1).drop("year", "month")
    al = wt.join(out, on=["entity_id", "_ym"], how="inner")
    if entities is not None:
        al = al.join(entities, on="entity_id", how="inner")
    return corr_long(al, variables, outcomes, ["lag", entity_col])


def strongest_lag(scan: DataFrame, keys: list[str]) -> DataFrame:
    """Lag with the largest |r| per (keys, variable, outcome); smallest lag on ties (E4 on G5)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, "weather_variable", "outcome").orderBy(F.abs("r").desc(), F.col("lag").asc())
    return scan.filter(F.col("r").isNotNull()).withColumn("_rn", F.row_number().over(w)) \
        .filter("_rn = 1").drop("_rn")


def parse_period(value_col: str, default_start: str = "2012-01-01", default_end: str = "2026-07-31"):
    """Period string -> (start, end) dates (G6): bare ``YYYY`` -> (Y-01-01, default end), else full history."""
    v = F.trim(F.col(value_col))
    is_year = F.coalesce(v.rlike(r"^\d{4}$"), F.lit(False))
    start = F.when(is_year, F.concat(v, F.lit("-01-01"))).otherwise(F.lit(default_start))
    return start.alias("start_date"), F.lit(default_end).alias("end_date")
