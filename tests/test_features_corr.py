import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paddyframe.operators import corr, features as feat


def _panel(spark, values, months=None):
    months = months or list(range(1, len(values) + 1))
    rows = [(1, 2020, m, v) for m, v in zip(months, values)]
    return spark.createDataFrame(rows, "entity_id int, year int, month int, precipitation_sum double")


def test_growing_season_needs_full_window(spark):
    df = _panel(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0])
    out = [r["precipitation_sum_gs"] for r in feat.growing_season(df, ["precipitation_sum"]).orderBy("month").collect()]
    # rows t-4..t-1; any NULL (or fewer than 4 rows) -> NULL; sum variable -> sum
    assert out[:7] == [None, None, None, None, None, None, None] and out[7] == 4.0 + 5 + 6 + 7


def test_trailing_windows_sum_rule(spark):
    df = _panel(spark, [1.0, 2.0, 3.0])
    out = feat.trailing_windows(df, ["precipitation_sum"]).orderBy("month").collect()
    assert [r["precipitation_sum_2m"] for r in out] == [None, 3.0, 5.0]
    assert [r["precipitation_sum_3m"] for r in out] == [None, None, 6.0]


def test_row_lag_vs_calendar_lag(spark):
    df = _panel(spark, [1.0, 2.0, 3.0], months=[1, 2, 4])
    row = feat.antecedent_lags(df, ["precipitation_sum"], 1).orderBy("month").collect()
    cal = feat.antecedent_lags(df, ["precipitation_sum"], 1, calendar=True).orderBy("month").collect()
    assert [r["precipitation_sum_lag1"] for r in row] == [None, 1.0, 2.0]
    assert [r["precipitation_sum_lag1"] for r in cal] == [None, 1.0, None]


def test_ffill_then_bfill(spark):
    df = _panel(spark, [None, 2.0, None, None, 5.0, None])
    out = [r["precipitation_sum"] for r in feat.ffill_bfill(df, ["precipitation_sum"]).orderBy("month").collect()]
    assert out == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]


def test_disaggregation_preserves_quarter_sums(spark):
    q = [(1, 2020, 1, 30.0), (1, 2020, 2, 60.0), (1, 2020, 3, 30.0), (1, 2020, 4, 90.0)]
    df = spark.createDataFrame(q, "s int, year int, quarter int, v double")
    out = feat.disaggregate(df, ["s"], "v").toPandas().sort_values(["year", "month"])
    sums = out.groupby((out["month"] - 1) // 3)["v"].sum().to_numpy()
    assert np.allclose(sums, [30, 60, 30, 90])
    # constant quarters -> flat monthly path
    flat = feat.disaggregate(spark.createDataFrame([(1, 2020, i, 9.0) for i in range(1, 5)], df.schema), ["s"], "v")
    assert np.allclose(flat.toPandas()["v"], 3.0)


def test_disaggregation_against_the_dense_system():
    rng = np.random.default_rng(0)
    for nq in (1, 2, 3, 17):
        q = rng.normal(size=nq) * 50
        n = nq * 3
        D, C = np.diff(np.eye(n), axis=0), np.kron(np.eye(nq), np.ones((1, 3)))
        kkt = np.block([[2 * D.T @ D, C.T], [C, np.zeros((nq, nq))]])
        want = np.linalg.lstsq(kkt, np.r_[np.zeros(n), q], rcond=None)[0][:n]
        assert np.allclose(feat._denton_cholette(q), want, atol=1e-9)
    assert len(feat._denton_cholette(np.zeros(0))) == 0


def test_disaggregation_of_a_long_series(spark):
    import time
    q = 100 + np.cumsum(np.random.default_rng(1).normal(size=100_000))
    t0 = time.time()
    x = feat._denton_cholette(q)
    assert time.time() - t0 < 30 and np.allclose(x.reshape(-1, 3).sum(1), q)
    slope = np.convolve(x, [-1, 2, -1], "same")
    slope[0], slope[-1] = x[0] - x[1], x[-1] - x[-2]
    assert np.ptp(slope.reshape(-1, 3), axis=1).max() < 1e-8
    df = spark.createDataFrame([(1, 2000 + i // 4, i % 4 + 1, float(v)) for i, v in enumerate(q[:40])], "s int, year int, quarter int, v double")
    months = feat.disaggregate(df, ["s"], "v")
    err = feat.disaggregation_errors(months, df, ["s"], "v").agg(F.max("sum_error"), F.max("stationarity_error"), F.count("*")).first()
    assert err[0] < 1e-9 and err[1] < 1e-9 and err[2] == 40
    bent = feat.disaggregation_errors(months.withColumn("v", F.col("v") + F.col("month") % 2), df, ["s"], "v")
    assert bent.filter("sum_error > 0.5 and stationarity_error > 0.5").count() == 40


def test_next_month_rollover(spark):
    df = spark.createDataFrame([(2023, 12), (2024, 1)], "year int, month int")
    y, m = feat.next_month()
    assert [(r[0], r[1]) for r in df.select(y, m).collect()] == [(2024, 1), (2024, 2)]


def test_pearson_pairwise_null_and_constant(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=50), rng.normal(size=50)
    x[3] = np.nan
    pdf = pd.DataFrame({"entity_name": "e", "v": x, "const": 1.0, "yield_rate": y, "volume": y * 2, "price": y})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    out = corr.corr_by_entity(df, ["v", "const"], ["YIELD"]).collect()
    got = {r["weather_variable"]: r["YIELD"] for r in out}
    mask = ~np.isnan(x)
    assert abs(got["v"] - np.corrcoef(x[mask], y[mask])[0, 1]) < 1e-12
    assert got["const"] is None            # constant column -> NULL, no error


def test_corr_long_min_n(spark):
    df = spark.createDataFrame([("e", 1.0, 2.0, 2.0, 2.0)], "entity_name string, v double, yield_rate double, volume double, price double")
    r = corr.corr_long(df, ["v"], ["YIELD"], ["entity_name"]).collect()[0]
    assert r["n"] == 1 and r["r"] is None


def test_parse_period(spark):
    df = spark.createDataFrame([("2024",), ("Q3 2025",), (" 2019 ",)], "p string")
    s, e = corr.parse_period("p")
    out = [r[0] for r in df.select(s).collect()]
    assert out == ["2024-01-01", "2012-01-01", "2019-01-01"]


def test_month_bounds_reach_the_scans_and_keep_whole_months(spark):
    import datetime
    from paddyframe.operators.clean import Months
    from paddyframe.plans import catalog
    days = [(datetime.datetime(y, m, d, 23, 59),) for y in (1999, 2000, 2001) for m in (1, 6, 7, 12) for d in (1, 30 if m != 12 else 31)] + [(None,)]
    df = spark.createDataFrame(days, "t timestamp")
    kept = lambda months: sorted(r.t for r in months.rows(df, "t").collect())
    given = sorted(d for d, in days if d)
    assert kept(Months((1999, 7), (2001, 6))) == [d for d in given if (1999, 7) <= (d.year, d.month) <= (2001, 6)]
    assert kept(Months.years(2000, 2000)) == [d for d in given if d.year == 2000]
    assert kept(Months.dates("2000-06-15", "2000-12-02")) == [d for d in given if d.year == 2000 and d.month >= 6]
    assert kept(Months(end=(1999, 12))) == [d for d in given if d.year == 1999] and Months().rows(df, "t").count() == len(days)
    q = catalog.queries()
    for name, dates, sides in (("scan_filter", ["l_shipdate"], "<>"), ("year_between", ["l_shipdate"], "<>"), ("corr_pooled", ["l_shipdate", "o_orderdate"], "<>"),
                               ("lag_join", ["l_shipdate", "o_orderdate"], "<>"), ("period_filter", ["l_shipdate", "o_orderdate"], "<"), ("train_matrix", ["l_shipdate"], ">")):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        pushed = [x for x in plan.splitlines() if "PushedFilters" in x]
        for c in dates:
            for op in sides:
                assert any({"<": "LessThan", ">": "GreaterThanOrEqual"}[op] + f"({c}," in x for x in pushed), (name, c, op)
