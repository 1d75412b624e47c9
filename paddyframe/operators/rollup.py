"""Aggregations and rollups (survey 2.E).

Every rollup is a single ``groupBy().agg()`` so Spark does a partial (map-side)
aggregation before the shuffle: a hot entity costs one partial row per task,
not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import py_round, threshold_flag
from .order_stats import value_ranks

# --- fixed values: how each daily variable collapses to a month, and the
# extreme-day thresholds (mm of rain, degrees C of daily maximum) -------------
MONTHLY_AGG = {
    "precipitation_sum": "sum",
    "temperature_2m_mean": "mean",
    "temperature_2m_max": "mean",
    "temperature_2m_min": "mean",
    "surface_pressure_mean": "mean",
    "soil_moisture_0_to_100cm_mean": "mean",
    "wind_gusts_10m_max": "max",
    "et0_fao_evapotranspiration": "sum",
    "shortwave_radiation_sum": "sum",
}
EXTREME_RAIN_THRESHOLD_MM = 54.0
EXTREME_HEAT_THRESHOLD_C = 34.0
# ---------------------------------------------------------------------------

_AGG_FN = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min}


def _agg_expr(fn_name: str, c: str):
    return _AGG_FN.get(fn_name, F.avg)(F.col(c)).alias(c)


def with_period_parts(df: DataFrame, date_col: str, tz: str | None = None) -> DataFrame:
    """Add ``year``/``month`` from a date or timestamp (optionally shifted UTC -> ``tz``)."""
    d = F.col(date_col)
    if tz:
        d = F.from_utc_timestamp(d, tz)
    return df.withColumn("year", F.year(d)).withColumn("month", F.month(d))


def monthly_rollup(daily: DataFrame, keys: list[str], date_col: str, variables: list[str],
                   agg_map: dict | None = None, tz: str | None = None,
                   rain_col: str | None = "precipitation_sum",
                   heat_col: str | None = "temperature_2m_max",
                   rain_threshold: float = EXTREME_RAIN_THRESHOLD_MM,
                   heat_threshold: float = EXTREME_HEAT_THRESHOLD_C) -> DataFrame:
    """Daily -> monthly with a per-variable function map (E1) and extreme-day counts.

    Unknown variables are averaged.  ``extreme_rain_days`` / ``extreme_heat_days`` are
    produced only when their source variable is among ``variables``.
    """
    agg_map = MONTHLY_AGG if agg_map is None else agg_map
    df = with_period_parts(daily, date_col, tz)
    aggs = [_agg_expr(agg_map.get(v, "mean"), v) for v in variables]
    if rain_col and rain_col in variables:
        aggs.append(F.sum(threshold_flag(rain_col, rain_threshold)).cast("int").alias("extreme_rain_days"))
    if heat_col and heat_col in variables:
        aggs.append(F.sum(threshold_flag(heat_col, heat_threshold)).cast("int").alias("extreme_heat_days"))
    return df.groupBy(*keys, "year", "month").agg(*aggs)


def extreme_days(daily: DataFrame, keys: list[str], date_col: str, thresholds: dict) -> DataFrame:
    """Threshold-day counts per month (E2): ``{out_col: (var, threshold)}``."""
    df = with_period_parts(daily, date_col)
    aggs = [F.sum(threshold_flag(v, t)).cast("int").alias(out) for out, (v, t) in thresholds.items()]
    return df.groupBy(*keys, "year", "month").agg(*aggs)


def granular_rollup(daily: DataFrame, keys: list[str], date_col: str, variables: list[str],
                    granularity: str = "day", fn: str = "mean", fill_gaps: bool = True) -> DataFrame:
    """Day / month / year buckets with one function on every variable.

    Buckets are labelled by their last day (month end / year end).  Unknown
    granularity -> day, unknown function -> mean.  With ``fill_gaps`` every bucket
    between an entity's first and last bucket is present (NULL measures), like a
    calendar resampler.
    """
    granularity = granularity if granularity in ("day", "month", "year") else "day"
    fn = fn if fn in ("mean", "max", "min") else "mean"
    d = F.to_date(F.col(date_col))
    if granularity == "day":
        bucket, step = d, "INTERVAL 1 DAY"
    elif granularity == "month":
        bucket, step = F.last_day(d), "INTERVAL 1 MONTH"
    else:
        bucket, step = F.make_date(F.year(d), F.lit(12), F.lit(31)), "INTERVAL 1 YEAR"
    agg = daily.withColumn("period", bucket).groupBy(*keys, "period").agg(
        *[_agg_expr(fn, v) for v in variables])
    if not fill_gaps:
        return agg
    # spine: one row per bucket between min and max per entity (bounded by the calendar)
    bounds = agg.groupBy(*keys).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    if granularity == "month":
        seq = F.expr(f"transform(sequence(0, cast(months_between(_hi, _lo) as int)), i -> last_day(add_months(_lo, i)))")
    else:
        seq = F.expr(f"sequence(_lo, _hi, {step})")
    spine = bounds.select(*keys, F.explode(seq).alias("period"))
    return spine.join(agg, on=[*keys, "period"], how="left")


def extreme_period(df: DataFrame, keys: list[str], period_col: str, var: str,
                   which: str = "highest") -> DataFrame:
    """Row whose ``var`` is highest / lowest per entity; first period wins ties, NULLs skipped.

    ``row_number() == 1`` lets Spark insert a partial group limit before the shuffle,
    so a skewed entity ships one row per task.
    """
    order = F.col(var).desc() if which == "highest" else F.col(var).asc()
    w = Window.partitionBy(*keys).orderBy(order, F.col(period_col).asc())
    return (df.filter(F.col(var).isNotNull() & ~F.isnan(F.col(var)))
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))


# --- fixed values: statistic, name parts of which a variable must hold one, parts it must not hold -------
STATISTIC_RULES = [
    ("total", ("precipitation", "rain", "duration"), ()),
    ("highest", ("max",), ()),
    ("lowest", ("min",), ()),
    ("average", ("mean",), ()),
    ("average", ("temperature",), ("max", "min")),
]
_STATISTIC = {"total": F.sum, "highest": F.max, "lowest": F.min, "average": F.avg}


def statistics_of(variable: str) -> list[str]:
    """The statistics whose rules the variable's name meets, each once."""
    met = [stat for stat, parts, never in STATISTIC_RULES
           if any(p in variable for p in parts) and not any(p in variable for p in never)]
    return list(dict.fromkeys(met))


def summary_stats(daily: DataFrame, keys: list[str], variables: list[str], digits: int = 2) -> DataFrame:
    """Summary statistics chosen by variable-name rules, long output (E5).

    rain/precipitation/duration -> total; ``max`` -> highest; ``min`` -> lowest;
    ``mean`` or a bare temperature -> average.  A variable may hit several rules.
    """
    labels = [(v, stat) for v in variables for stat in statistics_of(v)]
    aggs = [_STATISTIC[stat](v) for v, stat in labels]
    names = [f"_s{i}" for i in range(len(aggs))]
    wide = daily.groupBy(*keys).agg(*[a.cast("double").alias(n) for a, n in zip(aggs, names)])
    stack = ", ".join(f"'{v}', '{s}', {n}" for (v, s), n in zip(labels, names))
    return wide.select(*keys, F.expr(f"stack({len(names)}, {stack}) AS (variable, stat, value)")) \
        .withColumn("value", py_round("value", digits))


def climatology(df: DataFrame, keys: list[str], variables: list[str], month_col: str = "month") -> DataFrame:
    """Mean by calendar month per entity, missing -> 0."""
    return df.groupBy(*keys, month_col).agg(
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in variables])


def seasonal_mean(df: DataFrame, target: str, by: str = "month", out: str | None = None) -> DataFrame:
    """Average of ``target`` per season key (E7); mapped back to rows by a join."""
    return df.groupBy(by).agg(F.avg(target).alias(out or f"{target}_seasonal"))


def dq_counts(df: DataFrame, key_cols: list[str], null_cols: list[str], entity_col: str | None = None) -> DataFrame:
    """Row count, distinct-key count, per-column null counts."""
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(*[F.col(c) for c in key_cols]).alias("distinct_keys")]
    if entity_col:
        aggs.append(F.count_distinct(entity_col).alias("distinct_entities"))
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in null_cols]
    return df.agg(*aggs)


def latency_stats(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """Mean, upper median ``sorted[n//2]`` and p95 ``sorted[int(n*0.95)]`` (max when n < 20).

    Order statistics come from an exact distributed rank (no per-group collect),
    so a group with a third of the rows is still sorted by many tasks.
    """
    base = df.filter(F.col(value_col).isNotNull())
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"),
                                    F.max(value_col).alias("_max"))
    ranked = value_ranks(base.select(*keys, value_col), keys, value_col)
    want = stats.select(*keys, (F.floor(F.col("n") / 2) + 1).alias("_rmed"),
                        F.when(F.col("n") >= 20, F.floor(F.col("n") * F.lit(0.95)) + 1).alias("_rp95"))
    at = lambda r: F.max(F.when(F.col(r).between(F.col("first_rank"), F.col("last_rank")), F.col(value_col)))
    picked = (ranked.join(want, on=keys, how="inner")
              .groupBy(*keys).agg(at("_rmed").alias("median"), at("_rp95").alias("_p95")))
    return (stats.join(picked, on=keys, how="inner")
            .select(*keys, "n", "mean", "median", F.coalesce("_p95", "_max").alias("p95")))


def mean_positive(df: DataFrame, keys: list[str], value_col: str, out: str = "mean_positive") -> DataFrame:
    """Mean of strictly positive values, 0 when there are none."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col(value_col) > 0, F.col(value_col))), F.lit(0.0)).alias(out))


def success_rate(df: DataFrame, keys: list[str], flag_col: str, out: str = "success_rate") -> DataFrame:
    """Percentage of rows whose flag is true."""
    return df.groupBy(*keys).agg((F.avg(F.col(flag_col).cast("double")) * 100).alias(out))


def outcome_lookup(requests: DataFrame, production: DataFrame, prices: DataFrame,
                   entity_col: str = "entity_id", volume: str = "volume", area: str = "area",
                   price: str = "price") -> DataFrame:
    """Outcome for many requests at once.

    ``requests``: (request_id, entity_id, metric in YIELD/PRODUCTION/PRICE, start_date, end_date).
    Facts are matched on entity and the month falling inside [start, end]; YIELD is
    sum(volume)/sum(area), PRODUCTION sum(volume), PRICE avg(price).
    """
    def month_start(df):
        return df.withColumn("_d", F.make_date("year", "month", F.lit(1)))

    req = requests.select("request_id", entity_col, "metric",
                          F.to_date("start_date").alias("_s"), F.to_date("end_date").alias("_e"))
    facts = (month_start(production).select(entity_col, "_d", F.col(volume).alias("_v"), F.col(area).alias("_a"),
                                            F.lit(None).cast("double").alias("_p"))
             .unionByName(month_start(prices).select(entity_col, "_d", F.lit(None).cast("double").alias("_v"),
                                                     F.lit(None).cast("double").alias("_a"),
                                                     F.col(price).alias("_p"))))
    joined = req.join(facts, on=[req[entity_col] == facts[entity_col],
                                 facts["_d"] >= F.trunc(req["_s"], "month"), facts["_d"] <= req["_e"]],
                      how="left").drop(facts[entity_col])
    agg = joined.groupBy("request_id", entity_col, "metric").agg(
        F.sum("_v").alias("_sv"), F.sum("_a").alias("_sa"), F.avg("_p").alias("_ap"))
    return agg.select("request_id", entity_col, "metric",
                      F.when(F.col("metric") == "YIELD", F.try_divide("_sv", "_sa"))
                      .when(F.col("metric") == "PRODUCTION", F.col("_sv"))
                      .when(F.col("metric") == "PRICE", F.col("_ap")).alias("value"))
