"""Regularised linear models on Spark-aggregated sufficient statistics (survey 2.H).

Rows never leave the executors.  One pass computes the population mean/std of
every feature (the scaler is fitted on the whole training set, before CV); a
second pass builds, per CV fold, the Gram matrix of ``[1, z, y]`` where ``z``
is the standardised feature vector.  Each partition emits its (d+2)^2 partial
sums per fold from ``mapInPandas`` and ``groupBy(fold, i, j).sum`` combines
them, so the driver only ever holds ``folds x (d+2)^2`` numbers, independent of
row count.  Lasso (coordinate descent on the Gram) and Ridge (closed form)
then run on those small matrices; held-out errors come from the held-out fold's
Gram, so CV needs no further data pass.  Ridge leave-one-out needs one scoring
pass with the (d x d) inverse broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import WEATHER_VARS
from .homotopy import kkt_violation, lasso_path

# --- fixed values: model search settings ------------------------------------
LASSO_CV_FOLDS = 5
LASSO_N_ALPHAS = 100
LASSO_EPS = 1e-3
LASSO_MAX_ITER = 10000
LASSO_TOL = 1e-4
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 500.0)
# ---------------------------------------------------------------------------

KKT_TOL = 1e-8      # share of the largest correlation by which a path's solution may miss the optimum


@dataclass
class LinearModel:
    """Scaler + linear coefficients; ``coefficients()`` gives the registry table."""
    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float
    kind: str
    target: str
    extra: dict = field(default_factory=dict)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(m), float(s), float(c)) for f, m, s, c in zip(self.features, self.mean, self.std, self.coef)]
        df = spark.createDataFrame(rows, "feature string, mean double, std double, coef double")
        return df.withColumns({"intercept": F.lit(float(self.intercept)), "alpha": F.lit(float(self.alpha)),
                               "model": F.lit(self.kind), "target": F.lit(self.target)})


# ---- H1 / H2 / H3 ---------------------------------------------------------

def train_matrix(panel: DataFrame, entity_name_col: str, categories: list[str], start_year: int,
                 year_col: str = "year", prefix: str = "prov") -> DataFrame:
    """Training matrix (H1): rows from ``start_year``, entity one-hot, complete cases only."""
    df = panel.filter(F.col(year_col) >= start_year)
    df = df.withColumns({f"{prefix}_{v}": (F.col(entity_name_col) == F.lit(v)).cast("double") for v in categories})
    df = df.drop(entity_name_col)
    return df.dropna(how="any")


def temporal_split(df: DataFrame, train_end_year: int, test_start_year: int, year_col: str = "year") -> DataFrame:
    """Temporal holdout label (H2): ``train`` <= end year, ``test`` >= start year."""
    return df.withColumn("split", F.when(F.col(year_col) <= train_end_year, "train")
                         .when(F.col(year_col) >= test_start_year, "test"))


# --- fixed values: feature groups per target, in order (a trailing * is a name prefix) -------------------
_SEASON = ["month_sin", "month_cos"]
FEATURE_GROUPS = {
    "lasso": {
        "yield": ["weather", "is_wet", "hist_yield", "hist_price", *_SEASON, "prov_*"],
        "price": ["price_lag1", "price_lag12", "yield_lag1", "production_lag1", "hist_yield", *_SEASON,
                  "weather", "is_wet", "prov_*"],
        "production": ["weather", "is_wet", "production_lag1", *_SEASON, "prov_*"],
    },
}
FEATURE_GROUPS["ridge"] = {t: [g for g in groups if g != "is_wet"] for t, groups in FEATURE_GROUPS["lasso"].items()}
# ----------------------------------------------------------------------------------------------------------


def feature_sets(columns: list[str], kind: str = "lasso", weather_vars=WEATHER_VARS) -> dict[str, list[str]]:
    """Feature lists per target (H3): each group of FEATURE_GROUPS opened to the columns that belong to it."""
    def opened(group: str) -> list[str]:
        starts = tuple(weather_vars) if group == "weather" else (group[:-1],) if group.endswith("*") else None
        return [group] if starts is None else [c for c in columns if c.startswith(starts)]
    return {target: [c for g in groups for c in opened(g)] for target, groups in FEATURE_GROUPS[kind].items()}


# ---- H4 -----------------------------------------------------------------

def moments_long(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) with population std (H4).

    Features are unpivoted to (feature, value) inside the scan pipeline and
    aggregated by feature: two aggregate expressions regardless of d, partial
    aggregation before the shuffle, d output rows.
    """
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def standardize_stats(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Population mean / std of every feature (H4); d rows reach the driver."""
    got = {r["feature"]: (r["mean"], r["std"]) for r in moments_long(df, features).collect()}
    mean = np.array([got[f][0] for f in features], dtype=float)
    std = np.array([got[f][1] for f in features], dtype=float)
    std = np.where((std == 0) | np.isnan(std), 1.0, std)   # constant column: scale 1 (as a standard scaler)
    return mean, std


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Standardised columns ``(x - mean) / std_pop`` (H4); the 2d moments are literals."""
    mean, std = standardize_stats(df, features)
    return df.withColumns({f: (F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))
                           for f, m, s in zip(features, mean, std)})


# ---- fold assignment ------------------------------------------------------

def fold_ids(df: DataFrame, order_cols: list[str], entity_col: str, folds: int = LASSO_CV_FOLDS) -> DataFrame:
    """Contiguous K folds in (entity, period) row order, sizes like an unshuffled K-fold.

    Per-entity counts (one row per entity) give cumulative offsets; the global
    ordinal is offset + row number inside the entity, so no global window is used.
    """
    counts = df.groupBy(entity_col).agg(F.count(F.lit(1)).alias("_c"))
    # one number per entity: the dimension's size, summed on the driver like the models themselves
    sizes = sorted((tuple(r) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0]))
    n = sum(c for _, c in sizes)
    starts, at = [], 0
    for entity, c in sizes:
        starts.append((entity, at))
        at += c
    offs = df.sparkSession.createDataFrame(starts, T.StructType([counts.schema[entity_col], T.StructField("_off", T.LongType())]))
    w = Window.partitionBy(entity_col).orderBy(*order_cols)
    rows = df.withColumn("_rn", F.row_number().over(w) - 1)
    d = rows.join(F.broadcast(offs.withColumnRenamed(entity_col, "_e")), rows[entity_col].eqNullSafe(F.col("_e"))).drop("_e")
    o = F.col("_off") + F.col("_rn")
    base, rem = divmod(n, folds)
    # the first `rem` folds have base + 1 rows; with fewer rows than folds the last ones stay empty
    big = rem * (base + 1)
    fold = F.when(o < big, F.floor(o / (base + 1))).otherwise(rem + F.floor((o - big) / max(base, 1)))
    return d.withColumn("fold", fold.cast("int")).drop("_rn", "_off")


# ---- Gram pass ------------------------------------------------------------

def gram_pass(df: DataFrame, cols: list[str], mean: np.ndarray, std: np.ndarray,
              fold_col: str | None = "fold") -> dict[int, np.ndarray]:
    """Per-fold Gram of ``[1, (x - mean) / std]`` over ``cols`` via per-partition numpy partials.

    Each partition emits (folds x (d+1)^2) partial sums; ``groupBy(fold, i, j).sum``
    combines them, so only folds x (d+1)^2 numbers reach the driver.
    """
    d = len(cols)
    m_b, s_b = mean.astype(float), std.astype(float)
    fold_expr = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    src = df.select(fold_expr.alias("_fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])

    def partials(it):
        acc: dict[int, np.ndarray] = {}
        for pdf in it:
            if pdf.empty:
                continue
            Z = (pdf[[f"_x{i}" for i in range(d)]].to_numpy(dtype=float) - m_b) / s_b
            A = np.column_stack([np.ones(len(pdf)), Z])
            fold = pdf["_fold"].to_numpy()
            for f in np.unique(fold):
                sel = A[fold == f]
                acc[int(f)] = acc.get(int(f), 0) + sel.T @ sel
        for f, G in acc.items():
            ii, jj = np.meshgrid(np.arange(d + 1), np.arange(d + 1), indexing="ij")
            yield pd.DataFrame({"fold": np.int32(f), "i": ii.ravel().astype("int32"),
                                "j": jj.ravel().astype("int32"), "v": G.ravel()})

    parts = src.mapInPandas(partials, "fold int, i int, j int, v double")
    tot = parts.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for f, g in tot.groupby("fold"):
        G = np.zeros((d + 1, d + 1))
        G[g["i"].to_numpy(), g["j"].to_numpy()] = g["v"].to_numpy()
        out[int(f)] = G
    return out


def fold_grams(df: DataFrame, features: list[str], target: str, mean: np.ndarray, std: np.ndarray,
               fold_col: str | None = "fold") -> dict[int, np.ndarray]:
    """Per-fold Gram of ``[1, z, y]`` (z standardised, y raw)."""
    return gram_pass(df, features + [target], np.concatenate([mean, [0.0]]), np.concatenate([std, [1.0]]), fold_col)


def _centered(G: np.ndarray):
    """From an augmented Gram [1, z, y]: n, means, centred Z'Z, Z'y, y'y."""
    n = G[0, 0]
    sz, sy = G[0, 1:-1], G[0, -1]
    mz, my = sz / n, sy / n
    ZZ = G[1:-1, 1:-1] - n * np.outer(mz, mz)
    Zy = G[1:-1, -1] - n * mz * my
    yy = G[-1, -1] - n * my * my
    return n, mz, my, ZZ, Zy, yy


def _heldout_mse(G_test: np.ndarray, w: np.ndarray, b: float) -> float:
    """Mean squared error of y - b - z'w on a fold from that fold's augmented Gram."""
    v = np.concatenate([[-b], -w, [1.0]])       # residual = v . [1, z, y]
    return float(v @ G_test @ v / G_test[0, 0])


def lasso_cd(ZZ: np.ndarray, Zy: np.ndarray, n: float, alpha: float, w0: np.ndarray | None = None,
             max_iter: int = LASSO_MAX_ITER, tol: float = LASSO_TOL, yy: float | None = None) -> np.ndarray:
    """Coordinate descent for (1/2n)||y - Zw||^2 + alpha ||w||_1 on the centred Gram.

    Stops like the usual CD solvers: once the largest coefficient step is small
    relative to the largest coefficient, the duality gap is checked against
    ``tol * ||y||^2``.  The gradient ``Z'y - Z'Z w`` is updated incrementally.
    """
    d = len(Zy)
    w = np.zeros(d) if w0 is None else w0.copy()
    diag = np.diag(ZZ).copy()
    lam = n * alpha
    if yy is None:
        yy = float(Zy @ Zy) if d else 0.0
    gtol = tol * max(yy, 1e-300)
    g = Zy - ZZ @ w                       # Z'R
    for it in range(max_iter):
        w_max = d_max = 0.0
        # coordinates at zero that satisfy |g_j| <= lam would stay at zero: visit only the
        # active set and the current KKT violators (the gap test below still checks all)
        for j in np.flatnonzero((w != 0) | (np.abs(g) > lam)):
            dj = diag[j]
            if dj <= 0:
                continue
            old = w[j]
            rho = g[j] + dj * old
            new = (rho - lam if rho > lam else rho + lam if rho < -lam else 0.0) / dj
            if new != old:
                g -= (new - old) * ZZ[:, j]
                w[j] = new
            d_max = max(d_max, abs(new - old))
            w_max = max(w_max, abs(new))
        if it % 5 == 4:
            exact = _active_set_solution(ZZ, Zy, w, lam)
            if exact is not None:
                return exact
        if w_max == 0.0 or d_max / w_max < tol:
            r2 = yy - 2.0 * (w @ Zy) + w @ (ZZ @ w)
            dual = float(np.max(np.abs(g))) if d else 0.0
            const = lam / dual if dual > lam else 1.0
            gap = 0.5 * r2 * (1.0 + const * const) + lam * np.abs(w).sum() - const * (yy - w @ Zy)
            if gap < gtol:
                break
    return w


def _active_set_solution(ZZ: np.ndarray, Zy: np.ndarray, w: np.ndarray, lam: float):
    """Exact Lasso solution on the current support/signs, if it satisfies the KKT conditions."""
    A = np.flatnonzero(w)
    if A.size == 0:
        return None
    s = np.sign(w[A])
    rhs = Zy[A] - lam * s
    # least squares handles a rank-deficient support (e.g. a full set of dummies)
    wA = np.linalg.lstsq(ZZ[np.ix_(A, A)], rhs, rcond=None)[0]
    if not np.all(np.sign(wA) == s):
        return None
    out = np.zeros_like(w)
    out[A] = wA
    g = Zy - ZZ @ out
    scale = max(float(np.max(np.abs(Zy))), 1e-300)
    if np.any(np.abs(g[A] - lam * s) > 1e-9 * scale):
        return None
    inactive = np.ones(len(w), dtype=bool)
    inactive[A] = False
    if np.any(np.abs(g[inactive]) > lam + 1e-9 * scale):
        return None
    return out


def _alpha_grid(G_all: np.ndarray, n_alphas: int, eps: float) -> np.ndarray:
    n, _, _, _, Zy, _ = _centered(G_all)
    alpha_max = np.max(np.abs(Zy)) / n if len(Zy) else 0.0
    if alpha_max <= 0:
        return np.array([1.0])
    return np.logspace(np.log10(alpha_max), np.log10(alpha_max * eps), n_alphas)


def _path(G: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coefficients along the falling alphas (a row each): the homotopy's, which are checked against the
    optimality conditions; coordinate descent mends what does not meet them."""
    n, _, _, ZZ, Zy, yy = _centered(G)
    path = lasso_path(ZZ, Zy, n * alphas)
    if path is None:
        path = np.full((len(alphas), len(Zy)), np.nan)
    for k, a in enumerate(alphas):
        if not kkt_violation(ZZ, Zy, path[k], n * a) <= KKT_TOL:
            path[k] = lasso_cd(ZZ, Zy, n, a, path[k - 1] if k else None, yy=yy)
    return path


def _intercept(G: np.ndarray, w: np.ndarray) -> float:
    _, mz, my, _, _, _ = _centered(G)
    return float(my - mz @ w)


_PATH_SCHEMA = "model string, fold int, a int, mse double, w array<double>"


def _lasso_paths(spark: SparkSession, subs: dict[str, dict[int, np.ndarray]], n_alphas: int, eps: float):
    """All paths of several models at once: one Spark task per (model, held-out fold), whose rows tell the
    held-out errors, and one per model on all rows (fold null), whose rows tell the coefficients.

    The tasks carry only (d+2)^2 Gram numbers, independent of the row count.
    Returns {model: (alphas, mse[alpha, fold], coefficients[alpha, feature])}.
    """
    grids = {name: _alpha_grid(sum(g.values()), n_alphas, eps) for name, g in subs.items()}
    rows = []
    for name, grams in subs.items():
        G_all = sum(grams.values())
        for f, G in [(None, np.zeros_like(G_all)), *grams.items()]:
            rows.append((name, f, int(G_all.shape[0]), G_all.ravel().tolist(), G.ravel().tolist(), grids[name].tolist()))
    tasks = spark.createDataFrame(rows, "model string, fold int, dim int, g_all array<double>, "
                                        "g_test array<double>, alphas array<double>")

    def solve(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                k, alphas = int(r.dim), np.asarray(r.alphas, float)
                G_test = np.asarray(r.g_test, float).reshape(k, k)
                G = np.asarray(r.g_all, float).reshape(k, k) - G_test
                path = _path(G, alphas)
                if G_test[0, 0]:
                    told = [(r.model, int(r.fold), i, _heldout_mse(G_test, w, _intercept(G, w)), None) for i, w in enumerate(path)]
                else:
                    told = [(r.model, None, i, None, w.tolist()) for i, w in enumerate(path)]
                out = pd.DataFrame(told, columns=["model", "fold", "a", "mse", "w"])
                yield out.astype({"fold": "Int32", "a": "int32"})

    res = tasks.repartition(len(rows), "model", "fold").mapInPandas(solve, _PATH_SCHEMA).collect()
    out = {}
    for name, grid in grids.items():
        folds = sorted(subs[name])
        mse, coefs = np.zeros((len(grid), len(folds))), [None] * len(grid)
        for r in res:
            if r["model"] == name and r["fold"] is None:
                coefs[r["a"]] = r["w"]
            elif r["model"] == name:
                mse[r["a"], folds.index(r["fold"])] = r["mse"]
        out[name] = (grid, mse, np.array(coefs, float).reshape(len(grid), -1))
    return out


def fit_targets(df: DataFrame, specs: dict[str, tuple[list[str], str]], kind: str = "lasso",
                entity_col: str | None = None, order_cols: list[str] | None = None,
                folds: int = LASSO_CV_FOLDS, n_alphas: int = LASSO_N_ALPHAS, eps: float = LASSO_EPS,
                alphas=RIDGE_ALPHAS) -> dict[str, LinearModel]:
    """Fit several models that share training rows in one moments pass and one Gram pass (H5/H6).

    ``specs``: {name: (features, target)}.  The Gram of ``[1, z(union of features),
    targets]`` holds every model's Gram as a sub-block, so three targets cost the
    same data passes as one.  Ridge leave-one-out errors for every model and alpha
    come from one further scoring pass.
    """
    feats: list[str] = []
    for fs, _ in specs.values():
        feats += [f for f in fs if f not in feats]
    ys = []
    for _, y in specs.values():
        if y not in ys:
            ys.append(y)
    mean, std = standardize_stats(df, feats)
    cols = feats + ys
    m_ext = np.concatenate([mean, np.zeros(len(ys))])
    s_ext = np.concatenate([std, np.ones(len(ys))])
    if kind == "lasso":
        grams = gram_pass(fold_ids(df, order_cols, entity_col, folds), cols, m_ext, s_ext, "fold")
    else:
        grams = gram_pass(df, cols, m_ext, s_ext, None)
    pos = {c: i + 1 for i, c in enumerate(cols)}
    out: dict[str, LinearModel] = {}
    ridge_sols = {}
    lasso_subs = {}
    for name, (fs, y) in specs.items():
        idx = [0] + [pos[f] for f in fs] + [pos[y]]
        sub = {k: G[np.ix_(idx, idx)] for k, G in grams.items()}
        fi = [feats.index(f) for f in fs]
        if kind == "lasso":
            lasso_subs[name] = (fs, y, fi, sub)
        else:
            ridge_sols[name] = (fs, y, *_ridge_path(sub[0], alphas))
    if lasso_subs:
        paths = _lasso_paths(df.sparkSession, {k: v[3] for k, v in lasso_subs.items()}, n_alphas, eps)
        for name, (fs, y, fi, sub) in lasso_subs.items():
            grid, mse, coefs = paths[name]
            best = int(np.argmin(mse.mean(axis=1)))
            w = coefs[best]
            out[name] = LinearModel(fs, mean[fi], std[fi], w, _intercept(sum(sub.values()), w), float(grid[best]), "lasso", y,
                                    {"alphas": grid, "mse_path": mse, "coef_path": coefs})
    if kind != "lasso":
        sse = _ridge_loo_pass(df, feats, mean, std, ridge_sols)
        for name, (fs, y, _, mz, my, _, _, W) in ridge_sols.items():
            best = int(np.argmin(sse[name]))
            fi = [feats.index(f) for f in fs]
            out[name] = LinearModel(fs, mean[fi], std[fi], W[:, best], float(my - mz @ W[:, best]), float(alphas[best]), "ridge", y,
                                    {"alphas": np.array(alphas, float), "loo_sse": sse[name], "coef_path": W.T})
    return out


def _ridge_path(G: np.ndarray, alphas):
    """(n, means, target mean, V, shrink[eigenvalue, alpha], W[feature, alpha]): Z'Z = V diag(e) V' once, then
    every alpha divides by e + alpha."""
    n, mz, my, ZZ, Zy, _ = _centered(G)
    e, V = np.linalg.eigh(ZZ)
    shrink = 1.0 / (np.maximum(e, 0.0)[:, None] + np.asarray(alphas, float)[None])
    return n, mz, my, V, shrink, V @ (shrink * (V.T @ Zy)[:, None])


def _ridge_loo_pass(df: DataFrame, feats: list[str], mean: np.ndarray, std: np.ndarray, ridge_sols: dict) -> dict:
    """Sum of squared leave-one-out errors per (model, alpha) in one pass: ``e_i / (1 - h_ii)`` with
    ``h_ii = 1/n + sum_k (zc_i V)_k^2 / (e_k + alpha)``, so all leverages of all alphas are one matrix product
    (V, d x d, is broadcast per model)."""
    names = list(ridge_sols)
    ys = list(dict.fromkeys(ridge_sols[n_][1] for n_ in names))
    fidx = {n_: [feats.index(f) for f in ridge_sols[n_][0]] for n_ in names}
    src = df.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)],
                    *[F.col(y).cast("double").alias(f"_y{j}") for j, y in enumerate(ys)])
    m_b, s_b = mean.astype(float), std.astype(float)

    def loo(it):
        acc = {n_: np.zeros(ridge_sols[n_][-1].shape[1]) for n_ in names}
        for pdf in it:
            if pdf.empty:
                continue
            Z = (pdf[[f"_x{i}" for i in range(len(feats))]].to_numpy(dtype=float) - m_b) / s_b
            for n_ in names:
                _, y, n, mz, my, V, shrink, W = ridge_sols[n_]
                Zc = Z[:, fidx[n_]] - mz
                e = (pdf[f"_y{ys.index(y)}"].to_numpy(dtype=float) - my)[:, None] - Zc @ W
                h = 1.0 / n + np.square(Zc @ V) @ shrink
                acc[n_] = acc[n_] + np.square(e / (1.0 - h)).sum(axis=0)
        rows = [(n_, k, float(v)) for n_ in names for k, v in enumerate(acc[n_])]
        yield pd.DataFrame(rows, columns=["model", "k", "sse"]).astype({"k": "int32"})

    tot = (src.mapInPandas(loo, "model string, k int, sse double").groupBy("model", "k")
           .agg(F.sum("sse").alias("sse")).toPandas())
    return {n_: g.sort_values("k")["sse"].to_numpy() for n_, g in tot.groupby("model")}


def lasso_cv(df: DataFrame, features: list[str], target: str, entity_col: str, order_cols: list[str],
             folds: int = LASSO_CV_FOLDS, n_alphas: int = LASSO_N_ALPHAS, eps: float = LASSO_EPS) -> LinearModel:
    """LassoCV (H5): scaler on all training rows, contiguous folds, automatic alpha path, refit."""
    return fit_targets(df, {target: (features, target)}, "lasso", entity_col, order_cols, folds, n_alphas, eps)[target]


def lasso_fixed(df: DataFrame, features: list[str], target: str, alpha: float) -> LinearModel:
    """Lasso at a given alpha on all rows (one Gram pass)."""
    mean, std = standardize_stats(df, features)
    G = fold_grams(df, features, target, mean, std, fold_col=None)[0]
    w = _path(G, np.array([float(alpha)]))[0]
    return LinearModel(features, mean, std, w, _intercept(G, w), float(alpha), "lasso", target)


def ridge_cv(df: DataFrame, features: list[str], target: str, alphas=RIDGE_ALPHAS) -> LinearModel:
    """RidgeCV (H6): closed form per alpha, efficient leave-one-out score in one pass."""
    return fit_targets(df, {target: (features, target)}, "ridge", alphas=alphas)[target]


# ---- optimality, told from the rows ------------------------------------------

def _rows_of(df: DataFrame, model: LinearModel):
    """(select, batch -> Z, y) of the model's standardised rows."""
    cols = [*model.features, model.target]
    src = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])

    def unpack(pdf: pd.DataFrame):
        x = pdf.to_numpy(dtype=float)
        return (x[:, :-1] - model.mean) / model.std, x[:, -1]
    return src, unpack


def residual_products(df: DataFrame, model: LinearModel) -> np.ndarray:
    """Z'(y - b - Zw) over the rows, a row per alpha of the model's path: one pass, d numbers per alpha."""
    src, unpack = _rows_of(df, model)
    paths = model.extra["coef_path"]
    center = _center_of(df, model)

    def products(it):
        acc = np.zeros_like(paths)
        for pdf in it:
            if len(pdf):
                Z, y = unpack(pdf)
                Z = Z - center[:-1]
                acc += ((y - center[-1])[:, None] - Z @ paths.T).T @ Z
        a, j = np.indices(acc.shape)
        yield pd.DataFrame({"a": a.ravel(), "j": j.ravel(), "v": acc.ravel()})

    tot = src.mapInPandas(products, "a int, j int, v double").groupBy("a", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros_like(paths)
    out[tot["a"], tot["j"]] = tot["v"]
    return out


def _center_of(df: DataFrame, model: LinearModel) -> np.ndarray:
    """Means of the standardised features and of the target over the rows."""
    cols = [*model.features, model.target]
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    x = np.array(row, float)
    return np.concatenate([(x[:-1] - model.mean) / model.std, x[-1:]])


def optimality(df: DataFrame, model: LinearModel) -> np.ndarray:
    """Per alpha of the path, how far the coefficients miss the optimum on the rows, as a share of the largest
    correlation: a Lasso's by its KKT conditions, a Ridge's by its normal equations."""
    n = df.count()
    g, w, alphas = residual_products(df, model), model.extra["coef_path"], model.extra["alphas"][:, None]
    if model.kind == "ridge":
        off = np.abs(g - alphas * w)
    else:
        off = np.where(w != 0, np.abs(g - n * alphas * np.sign(w)), np.maximum(0.0, np.abs(g) - n * alphas))
    largest = np.abs(g + (alphas * w if model.kind == "ridge" else 0.0)).max()
    return off.max(axis=1, initial=0.0) / max(float(largest), 1e-300)


def refitted_loo(df: DataFrame, model: LinearModel) -> np.ndarray:
    """Sum of squared leave-one-out errors per alpha by leaving every row out of the Gram and solving anew: the
    definition, against which the leverage formula is held.  Work is rows x alphas x d^3, in tasks."""
    src, unpack = _rows_of(df, model)
    alphas, d = model.extra["alphas"], len(model.features)
    G = fold_grams(df, model.features, model.target, model.mean, model.std, fold_col=None)[0]

    def left_out(it):
        acc = np.zeros(len(alphas))
        for pdf in it:
            if not len(pdf):
                continue
            for z, y in zip(*unpack(pdf)):
                a = np.concatenate([[1.0], z, [y]])
                _, mz, my, ZZ, Zy, _ = _centered(G - np.outer(a, a))
                for k, alpha in enumerate(alphas):
                    acc[k] += (y - my - (z - mz) @ np.linalg.solve(ZZ + alpha * np.eye(d), Zy)) ** 2
        yield pd.DataFrame({"k": np.arange(len(alphas)), "v": acc})

    tot = src.mapInPandas(left_out, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return tot.sort_values("k")["v"].to_numpy()


# ---- H7 / H8 / H9 / H10 -----------------------------------------------------

def regression_metrics(df: DataFrame, y: str, yhat: str, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2 over rows where both values are present (H7)."""
    ok = F.col(y).isNotNull() & F.col(yhat).isNotNull() & ~F.isnan(y) & ~F.isnan(yhat)
    e = F.when(ok, F.col(y) - F.col(yhat))
    yy = F.when(ok, F.col(y))
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(yy) * F.var_pop(yy))).alias("r2")]
    return df.groupBy(*(keys or [])).agg(*aggs)


def predict_column(model: LinearModel, clamp: bool = False, digits: int | None = None):
    """Column expression ``intercept + sum(coef * (x - mean) / std)``: the terms are an array that is summed,
    as a nested sum of many terms takes the optimizer minutes."""
    terms = [F.lit(float(c)) * (F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))
             for f, m, s, c in zip(model.features, model.mean, model.std, model.coef) if c != 0]
    expr = F.lit(float(model.intercept))
    if terms:
        expr = F.aggregate(F.array(*terms), expr, lambda a, x: a + x)
    if clamp:
        expr = F.greatest(F.lit(0.0), expr)
    if digits is not None:
        expr = F.round(expr, digits)
    return expr


def top_features(coefs: DataFrame) -> DataFrame:
    """Non-zero coefficients by descending magnitude."""
    w = Window.partitionBy("model", "target").orderBy(F.abs("coef").desc(), F.col("feature"))
    return coefs.filter(F.col("coef") != 0).withColumn("rank", F.row_number().over(w))
