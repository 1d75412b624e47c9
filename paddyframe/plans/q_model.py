"""Catalogue entries for modelling and scoring (survey 2.H, 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear, score
from ..operators import features as feat
from ..session import written
from .catalog import query
from .fixtures import DAILY_VARS, MONTHLY_VARS, PANEL_START_YEAR, TRAIN_END_YEAR
from ..functions.columns import py_round_sql
from .oracle import CTE, oracle

W6, W8 = DAILY_VARS, MONTHLY_VARS
NATIONS = [f"NATION_{i}" for i in range(25)]
TEST_START_YEAR = TRAIN_END_YEAR + 1
LAGS = list(feat.MARKET_LAGS)
TARGET_COL = {"yield": "target_yield", "price": "target_price", "production": "target_production"}

# double columns of the training matrix (for the oracle's normalisation)
_TM_DBL = (W6 + ["target_yield", "target_price", "target_production"] + LAGS + ["month_sin", "month_cos"]
           + [f"{v}_lag{k}" for v in W6 for k in range(1, 5)] + [f"{v}_gs" for v in W8]
           + ["precipitation_sum_gs_wet", "soil_moisture_0_to_100cm_mean_gs_wet"] + [f'"prov_{n}"' for n in NATIONS])
_PANEL_COLS = (["entity_id", "year", "month"] + W8 + ["entity_name", "group_name", "target_yield", "target_price",
               "target_production"] + LAGS + ["month_sin", "month_cos"]
               + [f"{v}_lag{k}" for v in W8 for k in range(1, 5)] + [f"{v}_gs" for v in W8]
               + ["is_wet", "precipitation_sum_gs_wet", "soil_moisture_0_to_100cm_mean_gs_wet"])
_TM_SQL_BODY = ("SELECT * EXCLUDE (entity_name), " + ", ".join(f"CAST(entity_name = '{n}' AS DOUBLE) AS \"prov_{n}\"" for n in NATIONS)
                + f" FROM panel WHERE year >= {PANEL_START_YEAR} AND "
                + " AND ".join(f"{c} IS NOT NULL" for c in _PANEL_COLS))
_TM_CTE = f"tm AS ({_TM_SQL_BODY})"

# the Ridge design: trailing windows instead of lags, growing season and season interaction
_TRAIL_COLS = [f"{v}_{n}m" for v in W8 for n in (1, 2, 3)]
_RPANEL_COLS = _PANEL_COLS[:_PANEL_COLS.index("month_cos") + 1] + _TRAIL_COLS
_RTM_SQL_BODY = _TM_SQL_BODY[:_TM_SQL_BODY.index(" FROM panel")] + f" FROM rpanel WHERE year >= {PANEL_START_YEAR} AND " \
    + " AND ".join(f"{c} IS NOT NULL" for c in _RPANEL_COLS)


def _trail(v, n):
    fn = "sum" if "sum" in v or "days" in v else "avg"
    frame = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{v} AS {v}_1m" if n == 1 else \
        f"CASE WHEN count({v}) OVER {frame} = {n} THEN CAST({fn}({v}) OVER {frame} AS DOUBLE) END AS {v}_{n}m"


_RPANEL_CTE = ("rpanel AS (SELECT *, " + ", ".join(_trail(v, n) for v in W8 for n in (1, 2, 3))
               + " FROM combined WINDOW w AS (PARTITION BY entity_id ORDER BY year, month))")
_RTM_CTE = f"rtm AS ({_RTM_SQL_BODY})"
_RTM_DBL = (W6 + ["target_yield", "target_price", "target_production"] + LAGS + ["month_sin", "month_cos"]
            + [f"{v}_{n}m" for v in W8 for n in (1, 2, 3) if n > 1 or v in W6] + [f'"prov_{n}"' for n in NATIONS])


def _categories(fx):
    # one-hot categories from the entity dimension (bounded, sorted like get_dummies)
    return sorted(r[0] for r in fx.dim().select("entity_name").distinct().collect())


def _tm(fx, kind="lasso"):
    panel = fx.panel() if kind == "lasso" else fx.ridge_panel()
    return linear.train_matrix(panel, "entity_name", _categories(fx), PANEL_START_YEAR)


@query("train_matrix", "H1 D5 B8 B10", oracle(["panel"], _TM_SQL_BODY, _TM_DBL))
def q_train_matrix(fx):
    return _tm(fx)


@query("ridge_train_matrix", "H1 H6 F4", oracle(["combined"], _RTM_SQL_BODY, _RTM_DBL, extra=[_RPANEL_CTE]))
def q_ridge_train_matrix(fx):
    return _tm(fx, "ridge")


@query("complete_cases", "B8", oracle(["panel"], "SELECT count(*) AS n FROM panel WHERE "
                                       + " AND ".join(f"{c} IS NOT NULL" for c in _PANEL_COLS)))
def q_complete_cases(fx):
    from ..operators.clean import complete_cases
    return complete_cases(fx.panel()).agg(F.count(F.lit(1)).alias("n"))


@query("temporal_split", "H2", oracle(["panel"], f"""SELECT CASE WHEN year <= {TRAIN_END_YEAR} THEN 'train'
       WHEN year >= {TEST_START_YEAR} THEN 'test' END AS split, count(*) AS n FROM tm GROUP BY 1""", extra=[_TM_CTE]))
def q_temporal_split(fx):
    return linear.temporal_split(_tm(fx), TRAIN_END_YEAR, TEST_START_YEAR).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))


# the columns of each feature group, spelled out for the oracle
_GROUP_COLS = {
    "lasso": {"weather": [f"{v}_lag{k}" for v in W8 for k in range(1, 5)] + W8 + [f"{v}_gs" for v in W8]
              + ["precipitation_sum_gs_wet", "soil_moisture_0_to_100cm_mean_gs_wet"]},
    "ridge": {"weather": W8 + _TRAIL_COLS},
}


def _feature_sets_sql():
    parts, ctes = [], []
    for kind, table in (("lasso", "tm"), ("ridge", "rtm")):
        groups = _GROUP_COLS[kind] | {"prov_*": [f"prov_{n}" for n in NATIONS]}
        sets = {t: [c for g in gs for c in groups.get(g, [g])] for t, gs in linear.FEATURE_GROUPS[kind].items()}
        every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
        ctes.append(f"m_{kind} AS (" + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS feature, count(\"{c}\") AS n, avg(CAST(\"{c}\" AS DOUBLE)) AS mean FROM {table}" for c in every) + ")")
        parts += [f"SELECT '{kind}' AS model, '{t}' AS target, feature, n, mean FROM m_{kind} WHERE feature IN ({', '.join(repr(c) for c in cols)})"
                  for t, cols in sets.items()]
    return "\nUNION ALL\n".join(parts), ctes


@query("feature_sets", "H3", oracle(["panel"], _feature_sets_sql()[0], ["mean"],
                                    extra=[_TM_CTE, _RPANEL_CTE, _RTM_CTE, *_feature_sets_sql()[1]]))
def q_feature_sets(fx):
    """Every feature of every set with its row count and mean over its family's training matrix."""
    out = None
    for kind in linear.FEATURE_GROUPS:
        tm = _tm(fx, kind)
        rows = [(kind, t, c) for t, cols in linear.feature_sets(tm.columns, kind).items() for c in cols]
        members = fx.spark.createDataFrame(rows, "model string, target string, feature string")
        every = list(dict.fromkeys(c for _, _, c in rows))
        long = tm.select(*[F.col(c).cast("double").alias(c) for c in every]).unpivot([], every, "feature", "value")
        stats = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
        one = stats.join(members, "feature").select("model", "target", "feature", "n", "mean")
        out = one if out is None else out.unionByName(one)
    return out


def _yield_feats(tm):
    return linear.feature_sets(tm.columns, "lasso")["yield"]


@query("standardize", "H4", oracle(["panel"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg(CAST({q} AS DOUBLE)) AS mean, stddev_pop(CAST({q} AS DOUBLE)) AS std FROM tm WHERE year <= {TRAIN_END_YEAR}"
    for c, q in [(c, f'"{c}"' if c.startswith("prov_") else c) for c in
                 [f"{v}_lag{k}" for v in W8 for k in range(1, 5)] + W8 + [f"{v}_gs" for v in W8]
                 + ["precipitation_sum_gs_wet", "soil_moisture_0_to_100cm_mean_gs_wet", "is_wet", "hist_yield",
                    "hist_price", "month_sin", "month_cos"] + [f"prov_{n}" for n in NATIONS]]),
    ["mean", "std"], extra=[_TM_CTE]))
def q_standardize(fx):
    tm = _tm(fx)
    train = tm.filter(F.col("year") <= TRAIN_END_YEAR)
    return linear.moments_long(train, _yield_feats(tm))


@query("regression_metrics", "H7", oracle(["features"], f"""SELECT count(*) AS n, avg(abs(price - price_lag1)) AS mae,
         sqrt(avg((price - price_lag1) * (price - price_lag1))) AS rmse,
         1 - sum((price - price_lag1) * (price - price_lag1)) / (count(*) * var_pop(price)) AS r2
       FROM features WHERE year >= {TEST_START_YEAR} AND price IS NOT NULL AND price_lag1 IS NOT NULL""",
    ["mae", "rmse", "r2"]))
def q_regression_metrics(fx):
    f = fx.market_features().filter(F.col("year") >= TEST_START_YEAR)
    return _metrics_with_n(f, "price", "price_lag1")


def _metrics_with_n(df, y, yhat):
    ok = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    e = F.when(ok, F.col(y) - F.col(yhat))
    yy = F.when(ok, F.col(y))
    return df.agg(F.count_if(ok).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                  (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(yy) * F.var_pop(yy))).alias("r2"))


_BASELINES = [("yield", "prev_year", "target_yield", "hist_yield"),
              ("yield", "seasonal", "target_yield", None),
              ("price", "prev_month", "target_price", "price_lag1"),
              ("price", "prev_year", "target_price", "price_lag12"),
              ("production", "prev_month", "target_production", "production_lag1"),
              ("production", "seasonal", "target_production", None)]


def _baseline_sql():
    parts = []
    for t, b, y, p in _BASELINES:
        src = "test" if p else (f"(SELECT t.*, s.seas FROM test t LEFT JOIN (SELECT month, avg({y}) AS seas FROM tm "
                                f"WHERE year <= {TRAIN_END_YEAR} GROUP BY month) s ON t.month = s.month)")
        yh = p or "seas"
        parts.append(f"""SELECT '{t}' AS target, '{b}' AS model, avg(abs({y} - {yh})) AS mae,
            sqrt(avg(({y} - {yh}) * ({y} - {yh}))) AS rmse,
            1 - sum(({y} - {yh}) * ({y} - {yh})) / (count({y} - {yh}) * var_pop(CASE WHEN {yh} IS NOT NULL THEN {y} END)) AS r2
          FROM {src} q WHERE {y} IS NOT NULL AND {yh} IS NOT NULL""")
    return "\nUNION ALL\n".join(parts)


def baseline_metrics(tm, models: dict | None = None):
    """Metrics of all baselines (and fitted ``models``: {(target, name): prediction column}) in one aggregation:
    seasonal means are joined once, every prediction becomes a row (target, model, y, yhat)."""
    seasonal = [t for t, _, _, p in _BASELINES if p is None]
    seas = tm.filter(F.col("year") <= TRAIN_END_YEAR).groupBy("month").agg(
        *[F.avg(TARGET_COL[t]).alias(f"_seas_{t}") for t in seasonal])
    test = tm.filter(F.col("year") >= TEST_START_YEAR).join(seas, "month", "left")
    preds = [(t, b, F.col(p or f"_seas_{t}")) for t, b, _, p in _BASELINES] + [(*k, c) for k, c in (models or {}).items()]
    long = test.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(b).alias("model"), F.col(TARGET_COL[t]).cast("double").alias("y"),
                 c.cast("double").alias("yhat")) for t, b, c in preds])).alias("_p")).select("_p.*")
    return linear.regression_metrics(long, "y", "yhat", ["target", "model"])


@query("baseline_metrics", "H8 C10", oracle(["panel"], _baseline_sql(), ["mae", "rmse", "r2"],
       extra=[_TM_CTE, f"test AS (SELECT * FROM tm WHERE year >= {TEST_START_YEAR})"]))
def q_baseline_metrics(fx):
    return baseline_metrics(_tm(fx))


def _fit_all(fx, kind: str, full: bool = False):
    """Training matrix and models fitted on it now.  The matrix (a row per entity and month) is computed once and
    written to the shared folder: the passes of the fit and whoever scores its rows read it, and the optimizer does not carry the
    constraints of its hundred derived columns into their plans."""
    tm = written(_tm(fx, kind))
    train = tm if full else tm.filter(F.col("year") <= TRAIN_END_YEAR)
    sets = linear.feature_sets(tm.columns, kind)
    specs = {t: (cols, TARGET_COL[t]) for t, cols in sets.items()}
    # all three targets share one moments pass and one Gram pass over the training rows
    return tm, linear.fit_targets(train, specs, kind, "entity_id", ["year", "month"])


def _coef_table(fx, models):
    out = None
    for m in models.values():
        c = m.coefficients(fx.spark)
        out = c if out is None else out.unionByName(c)
    return out


@query("lasso_cv", "H5 H4", round_output=True)
def q_lasso_cv(fx):
    _, models = _fit_all(fx, "lasso")
    return _coef_table(fx, models)


@query("ridge_cv", "H6 H4")
def q_ridge_cv(fx):
    _, models = _fit_all(fx, "ridge")
    return _coef_table(fx, models)


def _checked_sql(rows):
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ")"


@query("lasso_kkt", "H5 H4 H10 H11", oracle([], _checked_sql(
    [f"('{rows}', '{t}', {linear.LASSO_N_ALPHAS}, 0)" for rows in ("train", "full") for t in TARGET_COL])
    + " AS t(fitted_on, target, n_alphas, n_off)"))
def q_lasso_kkt(fx):
    """Per target, alphas of the path and how many miss the optimality conditions by over KKT_TOL of the largest
    correlation, told from the rows: for the fit on the training years and for the refit on all years."""
    out = []
    for rows, full in (("train", False), ("full", True)):
        tm, models = _fit_all(fx, "lasso", full)
        used = tm if full else tm.filter(F.col("year") <= TRAIN_END_YEAR)
        for t, m in models.items():
            off = linear.optimality(used, m)
            out.append((rows, t, len(off), int((off > linear.KKT_TOL).sum())))
    return fx.spark.createDataFrame(out, "fitted_on string, target string, n_alphas int, n_off int")


@query("ridge_check", "H6 H4", oracle([], _checked_sql([f"('{t}', {len(linear.RIDGE_ALPHAS)}, 0, 0)" for t in TARGET_COL])
                                      + " AS t(target, n_alphas, n_off, n_loo_off)"))
def q_ridge_check(fx):
    """Per target, how many alphas miss the normal equations, and how many sums of squared leave-one-out errors
    differ from those of models refitted without each row, by over KKT_TOL."""
    tm, models = _fit_all(fx, "ridge")
    used, out = tm.filter(F.col("year") <= TRAIN_END_YEAR), []
    for t, m in models.items():
        off, loo = linear.optimality(used, m), linear.refitted_loo(used, m)
        far = abs(m.extra["loo_sse"] - loo) > linear.KKT_TOL * loo
        out.append((t, len(off), int((off > linear.KKT_TOL).sum()), int(far.sum())))
    return fx.spark.createDataFrame(out, "target string, n_alphas int, n_off int, n_loo_off int")


def leaderboard(tm, lasso: dict, rtm, ridge: dict):
    """Baselines and models (prediction columns by target), each family on its own test rows; the Lasso
    design serves the baselines, as it has fewer of them."""
    out = baseline_metrics(tm, {(t, "lasso"): p for t, p in lasso.items()})
    scored = rtm.filter(F.col("year") >= TEST_START_YEAR).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit("ridge").alias("model"), F.col(TARGET_COL[t]).cast("double").alias("y"),
                 p.alias("yhat")) for t, p in ridge.items()])).alias("_p")).select("_p.*")
    return out.unionByName(linear.regression_metrics(scored, "y", "yhat", ["target", "model"]))


@query("leaderboard", "H9 H7 H8")
def q_leaderboard(fx):
    tm, lasso = _fit_all(fx, "lasso")
    rtm, ridge = _fit_all(fx, "ridge")
    return leaderboard(tm, {t: linear.predict_column(m) for t, m in lasso.items()},
                       rtm, {t: linear.predict_column(m) for t, m in ridge.items()})


# models with stated coefficients: (intercept, {column: coefficient}) by target
_STATED = {
    "lasso": {"yield": (2.0, {"hist_yield": 0.7, "month_sin": -0.25}), "price": (40000.0, {"price_lag1": 0.5, "price_lag12": 0.25}),
              "production": (25.0, {"production_lag1": 0.75, "precipitation_sum_gs": 0.001})},
    "ridge": {"yield": (3.5, {"hist_yield": 0.5, "precipitation_sum_2m": 0.0005}), "price": (50000.0, {"price_lag1": 0.375, "hist_yield": 12.0}),
              "production": (60.0, {"production_lag1": 0.5})},
}


def _stated_sql():
    parts = []
    for kind, table in (("lasso", "test"), ("ridge", "rtest")):
        for t, (b, terms) in _STATED[kind].items():
            yh = " + ".join([f"{b}", *[f"{c} * CAST({f} AS DOUBLE)" for f, c in terms.items()]])
            y = TARGET_COL[t]
            parts.append(f"""SELECT '{t}' AS target, '{kind}' AS model, avg(abs({y} - ({yh}))) AS mae, sqrt(avg(pow({y} - ({yh}), 2))) AS rmse,
                1 - sum(pow({y} - ({yh}), 2)) / (count({y}) * var_pop({y})) AS r2 FROM {table} q""")
    return "\nUNION ALL\n".join(parts)


@query("leaderboard_stated", "H9 H7 H8", oracle(["panel"], _baseline_sql() + "\nUNION ALL\n" + _stated_sql(), ["mae", "rmse", "r2"],
       extra=[_TM_CTE, f"test AS (SELECT * FROM tm WHERE year >= {TEST_START_YEAR})", _RPANEL_CTE, _RTM_CTE,
              f"rtest AS (SELECT * FROM rtm WHERE year >= {TEST_START_YEAR})"]))
def q_leaderboard_stated(fx):
    """The leaderboard over models whose coefficients are stated."""
    def columns(kind):
        out = {}
        for t, (b, terms) in _STATED[kind].items():
            p = F.lit(b)
            for f, c in terms.items():
                p = p + F.lit(c) * F.col(f).cast("double")
            out[t] = p
        return out
    return leaderboard(_tm(fx), columns("lasso"), _tm(fx, "ridge"), columns("ridge"))


@query("top_features", "H10")
def q_top_features(fx):
    _, models = _fit_all(fx, "lasso")
    return linear.top_features(_coef_table(fx, models))


@query("refit_full", "H11")
def q_refit_full(fx):
    _, models = _fit_all(fx, "lasso", full=True)
    return _coef_table(fx, models)


# ---- 2.I scoring with a fixed coefficient table ---------------------------

FIXED_TERMS = [("price_lag1", 150000.0, 20000.0, 9000.0), ("price_lag12", 150000.0, 20000.0, 1500.0),
               ("yield_lag1", 13.0, 2.0, -400.0), ("production_lag1", 300.0, 120.0, 250.0),
               ("hist_yield", 13.0, 2.0, 0.0)]
FIXED_INTERCEPT = 140000.0


def _lin_sql():
    e = f"{FIXED_INTERCEPT}"
    for f, m, s, c in FIXED_TERMS:
        e = f"({e} + {c} * ((CAST({f} AS DOUBLE) - {m}) / {s}))"
    return e


@query("predict_batch", "I2", oracle(["features"],
       f"SELECT entity_id, year, month, {py_round_sql('greatest(0.0, ' + _lin_sql() + ')', 2)} AS prediction FROM features WHERE "
       + " AND ".join(f"{f} IS NOT NULL" for f, *_ in FIXED_TERMS), ["prediction"]))
def q_predict_batch(fx):
    rows = fx.market_features().dropna(subset=[f for f, *_ in FIXED_TERMS])
    return score.predict_batch(rows, FIXED_TERMS, FIXED_INTERCEPT).select("entity_id", "year", "month", "prediction")


def _contrib_sql():
    return "\nUNION ALL\n".join(
        f"SELECT entity_id, year, month, '{f}' AS feature, CAST({f} AS DOUBLE) AS raw_value, "
        f"{c} * ((CAST({f} AS DOUBLE) - {m}) / {s}) AS contribution FROM features WHERE year >= {TEST_START_YEAR}"
        for f, m, s, c in FIXED_TERMS)


@query("contributions", "I3", oracle(["features"], _contrib_sql(), ["raw_value", "contribution"]))
def q_contributions(fx):
    rows = fx.market_features().filter(F.col("year") >= TEST_START_YEAR)
    return score.contributions(rows, ["entity_id", "year", "month"], FIXED_TERMS)


@query("explain_top", "I4 D8 K12", oracle(["features"], f"""SELECT entity_id, year, month,
         printf('%d-%02d', year, month) AS target_period, direction, rank, feature,
         {py_round_sql('raw_value', 2)} AS current_value, {py_round_sql('contribution', 3)} AS impact_score
       FROM (SELECT *, CASE WHEN contribution > 0 THEN 'UP' ELSE 'DOWN' END AS direction,
                    row_number() OVER (PARTITION BY entity_id, year, month, CASE WHEN contribution > 0 THEN 'UP' ELSE 'DOWN' END
                       ORDER BY CASE WHEN contribution > 0 THEN -contribution ELSE contribution END, feature) AS rank
             FROM ({_contrib_sql()}) c WHERE contribution <> 0 AND contribution IS NOT NULL) r WHERE rank <= 4""",
    ["current_value", "impact_score"]))
def q_explain_top(fx):
    rows = fx.market_features().filter(F.col("year") >= TEST_START_YEAR)
    c = score.contributions(rows, ["entity_id", "year", "month"], FIXED_TERMS)
    return score.explain_top(c.filter(F.col("contribution").isNotNull()), ["entity_id", "year", "month"])


_SCORE_TARGETS = [(2001, 10), (2002, 3), (1990, 1)]


_OVER = "OVER (PARTITION BY entity_id ORDER BY year, month ROWS BETWEEN"
_SCORE_NUM = [c for c in _PANEL_COLS if c not in ("entity_id", "year", "month", "entity_name", "group_name", "is_wet", "month_sin", "month_cos")]
_SCORE_CTES = [
    "base AS (SELECT * REPLACE (" + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) {_OVER} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) {_OVER} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in LAGS) + ") FROM combined)",
    "clim AS (SELECT entity_id, month, " + ", ".join(f"avg({v}) AS {v}" for v in W8) + " FROM base GROUP BY 1, 2)",
    "tgt AS (SELECT entity_id, y AS target_year, m AS target_month FROM dim, (VALUES " + ", ".join(map(str, _SCORE_TARGETS)) + ") t(y, m))",
    """ext AS (SELECT entity_id, CAST(unnest(range(a + 1, b + 1)) AS INTEGER) AS o
      FROM (SELECT entity_id, max(year * 12 + month - 1) AS a FROM base GROUP BY 1)
      JOIN (SELECT entity_id, max(target_year * 12 + target_month - 1) AS b FROM tgt GROUP BY 1) USING (entity_id))""",
    "final AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY year DESC, month DESC) = 1)",
    "future AS (SELECT l.* REPLACE (CAST(o // 12 AS INTEGER) AS year, CAST(o % 12 + 1 AS INTEGER) AS month, "
    + ", ".join(f"coalesce(c.{v}, 0) AS {v}" for v in W8)
    + ") FROM final l JOIN ext ON l.entity_id = ext.entity_id LEFT JOIN clim c ON c.entity_id = ext.entity_id AND c.month = o % 12 + 1)",
    "calendar AS (SELECT *, 0 AS later FROM base UNION ALL BY NAME SELECT *, 1 AS later FROM future)",
    CTE["panel0"].replace("panel0 AS", "lagged AS", 1).replace("FROM combined", "FROM calendar"),
    CTE["panel"].replace("panel AS", "full_panel AS", 1).replace("FROM panel0", "FROM lagged"),
    """picked AS (SELECT f.*, target_year, target_month FROM full_panel f JOIN tgt USING (entity_id)
      QUALIFY row_number() OVER (PARTITION BY entity_id, target_year, target_month
        ORDER BY year = target_year AND month = target_month DESC, later, year DESC, month DESC) = 1)"""]
_SCORE_SQL = oracle(["combined"], "SELECT entity_id, entity_name, group_name, year, month, is_wet, target_year, target_month, "
                    "NOT (year = target_year AND month = target_month) AS is_fallback, "
                    "sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos, "
                    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in _SCORE_NUM) + ", "
                    + ", ".join(f"CAST(entity_name = '{n}' AS DOUBLE) AS \"prov_{n}\"" for n in NATIONS) + " FROM picked",
                    _SCORE_NUM + ["month_sin", "month_cos"] + [f'"prov_{n}"' for n in NATIONS], extra=_SCORE_CTES)


@query("score_features", "I1 D10 E6 F7 F8 B16", _SCORE_SQL)
def q_score_features(fx):
    t = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in _SCORE_TARGETS]))
    targets = fx.dim().select("entity_id", t.alias("t")).select("entity_id", "t.year", "t.month")
    raw = fx.combined()
    return score.score_features(raw, targets, W8, _categories(fx))


@query("score_and_explain", "I1 I2 I3 I4")
def q_score_and_explain(fx):
    """End-to-end: fit Lasso price model, score all entities at future targets, explain the top drivers."""
    tm, models = _fit_all(fx, "lasso")
    m = models["price"]
    t = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(mm).alias("month")) for y, mm in _SCORE_TARGETS]))
    targets = fx.dim().select("entity_id", t.alias("t")).select("entity_id", "t.year", "t.month")
    rows = score.score_features(fx.combined(), targets, W8, _categories(fx))
    terms = [(f, float(mu), float(sd), float(c)) for f, mu, sd, c in zip(m.features, m.mean, m.std, m.coef) if c != 0]
    keys = ["entity_id", "target_year", "target_month"]
    pred = score.predict_batch(rows, terms, m.intercept).select(*keys, "is_fallback", "prediction")
    if not terms:
        return pred
    top = score.explain_top(score.contributions(rows, keys, terms).withColumnRenamed("target_year", "year")
                            .withColumnRenamed("target_month", "month"), ["entity_id", "year", "month"])
    drivers = top.groupBy("entity_id", "year", "month").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "direction", F.col("rank").cast("string"), "feature"))),
                     ";").alias("drivers"))
    return pred.join(drivers.withColumnRenamed("year", "target_year").withColumnRenamed("month", "target_month"),
                     keys, "left")
