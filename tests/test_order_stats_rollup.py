import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paddyframe.operators import rollup
from paddyframe.operators.order_stats import prefix_scan, value_ranks


def test_value_ranks_match_pandas_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.34, "hot", rng.choice(["a", "b", "c"], 3000))
    v = rng.normal(size=3000).round(1)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    out = value_ranks(df, ["g"], "v", blocks=7).toPandas()
    want = pd.DataFrame({"g": g, "v": v})
    want["r"] = want.groupby("g")["v"].rank(method="min").astype(int)
    want = want.groupby(["g", "v"]).agg(first_rank=("r", "first"), n=("r", "size")).reset_index()
    got = out.sort_values(["g", "v"]).reset_index(drop=True)
    assert (got[["g", "v", "first_rank", "n"]].values == want[["g", "v", "first_rank", "n"]].values).all()
    assert (got.last_rank == got.first_rank + got.n - 1).all()


@pytest.mark.parametrize("partitions", [None, 40])
def test_scans_and_ranks_keep_every_row_at_size(spark, partitions):
    """1.2 million rows, wide payload, three hot groups: equal to plain windows."""
    n = 1_200_000
    df = spark.range(n, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("g"),
        ((F.col("id") * 7919) % n).alias("t"), (F.xxhash64("id") % 11).cast("double").alias("v"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("payload"))
    s = prefix_scan(df, ["g"], "t", "v", "sum", "s", num_partitions=partitions)
    s = prefix_scan(s, ["g"], "t", "v", "max", "m", num_partitions=partitions)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "t", F.sum("v").over(w).alias("ws"), F.max("v").over(w).alias("wm"))
    both = s.join(want, ["g", "t"])
    assert s.count() == n
    assert both.filter("s = ws and m = wm and length(payload) = 192").count() == n
    r = value_ranks(df, ["g"], "t", blocks=partitions)
    wr = df.select("g", "t", F.row_number().over(Window.partitionBy("g").orderBy("t")).alias("rn"))
    assert r.join(wr, ["g", "t"]).filter("first_rank = rn and last_rank = rn and n = 1").count() == n


def test_latency_stats_upper_median_and_p95_rule(spark):
    rows = [("x", float(i)) for i in [5, 1, 4, 2, 3, 6]] + [("y", float(i)) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "k string, v double")
    r = {x["k"]: x for x in rollup.latency_stats(df, ["k"], "v").collect()}
    # n=6: sorted[3] = 4 (upper median), n < 20 -> p95 = max
    assert r["x"]["median"] == 4.0 and r["x"]["p95"] == 6.0 and r["x"]["n"] == 6
    # n=20: sorted[10] = 11, sorted[int(19.0)] = 20
    assert r["y"]["median"] == 11.0 and r["y"]["p95"] == 20.0


def test_monthly_rollup_function_map_and_extreme_days(spark):
    rows = [(1, "2024-01-01", 60.0, 35.0, 10.0), (1, "2024-01-02", 10.0, 30.0, 20.0), (1, "2024-02-01", 54.0, 34.0, 5.0)]
    df = spark.createDataFrame(rows, "e int, d string, precipitation_sum double, temperature_2m_max double, "
                                     "wind_gusts_10m_max double").withColumn("d", F.to_date("d"))
    out = {(r["year"], r["month"]): r for r in rollup.monthly_rollup(
        df, ["e"], "d", ["precipitation_sum", "temperature_2m_max", "wind_gusts_10m_max"]).collect()}
    jan, feb = out[(2024, 1)], out[(2024, 2)]
    assert jan["precipitation_sum"] == 70.0          # sum
    assert jan["temperature_2m_max"] == 32.5         # mean
    assert jan["wind_gusts_10m_max"] == 20.0         # max
    assert jan["extreme_rain_days"] == 1 and jan["extreme_heat_days"] == 1
    assert feb["extreme_rain_days"] == 1 and feb["extreme_heat_days"] == 1   # thresholds are inclusive


def test_granular_rollup_fills_empty_buckets(spark):
    rows = [(1, "2024-01-15", 1.0), (1, "2024-03-02", 3.0)]
    df = spark.createDataFrame(rows, "e int, d string, v double").withColumn("d", F.to_date("d"))
    out = rollup.granular_rollup(df, ["e"], "d", ["v"], "month", "mean").orderBy("period").collect()
    assert [str(r["period"]) for r in out] == ["2024-01-31", "2024-02-29", "2024-03-31"]
    assert out[1]["v"] is None


def test_extreme_period_first_tie_wins(spark):
    rows = [(1, 3, 5.0), (1, 1, 5.0), (1, 2, None), (1, 4, 1.0)]
    df = spark.createDataFrame(rows, "e int, p int, v double")
    hi = rollup.extreme_period(df, ["e"], "p", "v", "highest").collect()[0]
    lo = rollup.extreme_period(df, ["e"], "p", "v", "lowest").collect()[0]
    assert hi["p"] == 1 and lo["p"] == 4


def test_prefix_scan_matches_pandas_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 4000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b"], n))
    t = rng.permutation(n)
    v = rng.integers(0, 5, n).astype(float)
    v[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"g": g, "t": t, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    s = prefix_scan(df, ["g"], "t", "v", "sum", "s", num_partitions=9).toPandas()
    m = prefix_scan(df, ["g"], "t", "v", "max", "m", num_partitions=9).toPandas()
    ref = pdf.sort_values(["g", "t"]).copy()
    ref["s"] = ref.groupby("g")["v"].cumsum()
    ref["m"] = ref.groupby("g")["v"].cummax()
    got_s = s.set_index(["g", "t"])["s"].sort_index()
    got_m = m.set_index(["g", "t"])["m"].sort_index()
    want = ref.set_index(["g", "t"]).sort_index()
    # pandas leaves NaN where the current value is NaN; compare on rows with a value
    mask = want["v"].notna()
    assert np.allclose(got_s[mask].to_numpy(), want["s"][mask].to_numpy())
    assert np.allclose(got_m[mask].to_numpy(), want["m"][mask].to_numpy())


def test_rank_and_scan_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 5.0)], "g string, t int, v double")
    r = {(x["g"], x["v"]): x["first_rank"] for x in value_ranks(df, ["g"], "v").collect()}
    assert r == {(None, 1.0): 1, (None, 2.0): 2, ("a", 5.0): 1}
    s = {(x["g"], x["t"]): x["s"] for x in prefix_scan(df, ["g"], "t", "v", "sum", "s").collect()}
    assert s == {(None, 1): 1.0, (None, 2): 3.0, ("a", 1): 5.0}


FIRST_QUERY = """
import sys
from pyspark.sql import functions as F
from paddyframe.operators import conversation as conv
from paddyframe.session import build_session
spark = build_session("local[2]", 8, extra={"spark.driver.memory": "1g", "spark.driver.host": "127.0.0.1"})
c = spark.read.parquet(sys.argv[1])
blk = conv.latest_tool_block(c, F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn")
print("rows", sorted(tuple(r) for r in blk.collect()))
"""


def test_scan_as_the_first_query_of_a_session(spark, tmpdir_path):
    """The first attribute ids of a session are those that Spark gives lambda variables for comparing plans."""
    rows = [(k, t, "assistant" if t % 3 == k else "user", "x") for k in (0, 1) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmpdir_path}/c")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", FIRST_QUERY, f"{tmpdir_path}/c"], cwd=root, capture_output=True, text=True,
                         timeout=300, env={**os.environ, "PYTHONPATH": root})
    assert got.returncode == 0, got.stderr[-2000:]
    assert got.stdout.splitlines()[-1].endswith("rows [(0, 7), (1, 5), (1, 6)]")


def test_statistic_rules():
    assert rollup.statistics_of("precipitation_sum") == ["total"]
    assert rollup.statistics_of("temperature_2m_max") == ["highest"]
    assert rollup.statistics_of("temperature_2m_mean") == ["average"]
    assert rollup.statistics_of("temperature_2m") == ["average"]
    assert rollup.statistics_of("rain_max_duration_min") == ["total", "highest", "lowest"]
