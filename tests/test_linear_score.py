import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paddyframe.operators import linear, score


def _data(spark, n=300, d=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 10
    y = X @ np.array([1.5, -2.0, 0.0, 0.5, 0.0]) + rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(d)])
    pdf["y"] = y
    pdf["entity_id"] = np.sort(np.arange(n) % 6)
    pdf["year"] = 2000 + (np.arange(n) % 50) // 12
    pdf["month"] = (np.arange(n) % 12) + 1
    return spark.createDataFrame(pdf), X, y


def test_ridge_matches_closed_form_and_loo(spark):
    df, X, y = _data(spark)
    feats = [f"x{i}" for i in range(5)]
    m = linear.ridge_cv(df, feats, "y", alphas=(1.0,))
    Z = (X - X.mean(0)) / X.std(0)
    Zc, yc = Z - Z.mean(0), y - y.mean()
    w = np.linalg.solve(Zc.T @ Zc + np.eye(5), Zc.T @ yc)
    assert np.allclose(m.coef, w, atol=1e-8)
    # leave-one-out identity vs brute force
    loo = 0.0
    for i in range(len(y)):
        k = np.ones(len(y), bool); k[i] = False
        Zk = Z[k]; mu = Zk.mean(0); yk = y[k]
        wk = np.linalg.solve((Zk - mu).T @ (Zk - mu) + np.eye(5), (Zk - mu).T @ (yk - yk.mean()))
        loo += (y[i] - (yk.mean() + (Z[i] - mu) @ wk)) ** 2
    assert abs(m.extra["loo_sse"][0] - loo) / loo < 1e-8


def test_lasso_kkt_and_cv(spark):
    df, X, y = _data(spark, seed=1)
    feats = [f"x{i}" for i in range(5)]
    m = linear.lasso_fixed(df, feats, "y", alpha=0.1)
    Z = (X - X.mean(0)) / X.std(0)
    Zc, yc = Z - Z.mean(0), y - y.mean()
    g = Zc.T @ (yc - Zc @ m.coef) / len(y)
    nz = m.coef != 0
    assert np.allclose(g[nz], 0.1 * np.sign(m.coef[nz]), atol=1e-5)
    assert (np.abs(g[~nz]) <= 0.1 + 1e-6).all()
    cv = linear.lasso_cv(df, feats, "y", "entity_id", ["year", "month"])
    assert cv.alpha > 0 and len(cv.extra["alphas"]) == 100
    assert abs(cv.coef[2]) < 0.2 and abs(cv.coef[0]) > 1


def test_optimality_is_told_from_the_rows(spark):
    df, _, _ = _data(spark, seed=2)
    feats = [f"x{i}" for i in range(5)]
    lasso, ridge = linear.lasso_cv(df, feats, "y", "entity_id", ["year", "month"]), linear.ridge_cv(df, feats, "y")
    for m in (lasso, ridge):
        assert (linear.optimality(df, m) < 1e-10).all()
    assert np.allclose(linear.refitted_loo(df, ridge), ridge.extra["loo_sse"], rtol=1e-9)
    for m in (lasso, ridge):
        m.extra["coef_path"] = m.extra["coef_path"] + 1e-3
        assert (linear.optimality(df, m) > linear.KKT_TOL).all()


def test_fold_sizes_like_unshuffled_kfold(spark):
    df, _, _ = _data(spark, n=303)
    f = linear.fold_ids(df, ["year", "month"], "entity_id").groupBy("fold").count().orderBy("fold").collect()
    sizes = [r["count"] for r in f]
    n = sum(sizes)
    assert sizes == [n // 5 + (1 if i < n % 5 else 0) for i in range(5)]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, None), (4.0, 4.0)], "y double, p double")
    r = linear.regression_metrics(df, "y", "p").collect()[0]
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 1.5, 4.0])
    assert abs(r["mae"] - np.abs(y - p).mean()) < 1e-12
    assert abs(r["r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12


def test_predict_clamp_and_contributions(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (2, -50.0, 3.0)], "id int, a double, b double")
    terms = [("a", 0.0, 10.0, 2.0), ("b", 1.0, 1.0, -1.0)]
    p = {r["id"]: r["prediction"] for r in score.predict_batch(df, terms, 1.0).collect()}
    assert p[1] == 3.0 and p[2] == 0.0
    top = score.explain_top(score.contributions(df.withColumn("year", F.lit(2024)).withColumn("month", F.lit(6)),
                                                ["id", "year", "month"], terms), ["id", "year", "month"]).collect()
    assert {(r["id"], r["direction"], r["feature"]) for r in top} == {(1, "UP", "a"), (2, "DOWN", "a"), (2, "DOWN", "b")}
    assert top[0]["target_period"] == "2024-06"


def test_score_features_extends_with_climatology_and_flags_fallback(spark):
    # one entity, Jan..Jun 2020; target Aug 2020 lies two months past the last row
    rows = [(1, "E1", 2020, m, float(m), None if m == 6 else 10.0 * m) for m in range(1, 7)]
    panel = spark.createDataFrame(rows, "entity_id int, entity_name string, year int, month int, "
                                        "precipitation_sum double, price_lag1 double")
    targets = spark.createDataFrame([(1, 2020, 8), (1, 2019, 1)], "entity_id int, year int, month int")
    out = {(r["target_year"], r["target_month"]): r for r in score.score_features(
        panel, targets, ["precipitation_sum"], ["E1", "E2"], market_cols=["price_lag1"]).collect()}
    fut = out[(2020, 8)]
    assert not fut["is_fallback"] and (fut["year"], fut["month"]) == (2020, 8)
    # Jul and Aug have no history -> climatology 0; lags reach back into real months
    assert fut["precipitation_sum"] == 0.0
    assert fut["precipitation_sum_lag1"] == 0.0 and fut["precipitation_sum_lag2"] == 6.0
    assert fut["precipitation_sum_gs"] == 0.0 + 6 + 5 + 4       # t-4..t-1 = May, Jun, Jul(0), ... summed
    assert fut["price_lag1"] == 50.0                             # forward-filled market value copied forward
    assert fut["prov_E1"] == 1.0 and fut["prov_E2"] == 0.0
    past = out[(2019, 1)]
    assert past["is_fallback"] and (past["year"], past["month"]) == (2020, 6)
