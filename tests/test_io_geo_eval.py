import json
import os

from pyspark.sql import functions as F

from paddyframe.operators import clean, conversation as conv, evaluate as ev, geo
from paddyframe.sources import io


def test_csv_scan_and_wide_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "wide.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Geolocation,2012 Quarter 1,2012 Quarter 2\n..Tarlac,10,..\n....Capas,..,5.5\n")
    df, label, periods = io.read_wide_csv(spark, p)
    long = clean.wide_csv_to_long(df, label, periods).withColumn("end", clean.parse_period_label("period"))
    rows = {(r["Geolocation"], str(r["end"])): r["value"] for r in long.collect()}
    assert rows[("Tarlac", "2012-03-31")] == 10.0 and rows[("Tarlac", "2012-06-30")] is None
    assert rows[("Capas", "2012-06-30")] == 5.5
    assert clean.drop_any_missing(long, "period", "value").count() == 0      # each quarter has a missing series
    assert clean.drop_cell_missing(long, "value").count() == 2


def test_wide_csv_with_two_label_columns(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "two.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Crop,Geolocation,2012 January,2012 February\nRice,..Tarlac,10,..\nRice,....Capas,7,5.5\n")
    for index, names in ((1, {"Tarlac", "Capas"}), (0, {"Rice"})):
        df, label, periods = io.read_wide_csv(spark, p, label_index=index, label_cols=2)
        long = clean.wide_csv_to_long(df, label, periods)
        assert periods == ["2012 January", "2012 February"] and {r[label] for r in long.collect()} == names
        assert sorted(r["value"] for r in clean.drop_cell_missing(long, "value").collect()) == [5.5, 7.0, 10.0]


def test_insert_or_ignore_and_partition_overwrite(spark, tmpdir_path):
    existing = spark.createDataFrame([(1, 2020, 1.0)], "k int, y int, v double")
    incoming = spark.createDataFrame([(1, 2020, 9.0), (2, 2020, 2.0), (2, 2020, 3.0)], "k int, y int, v double")
    out = {r["k"]: r["v"] for r in io.insert_or_ignore(existing, incoming, ["k", "y"], ["v"]).collect()}
    assert out == {1: 1.0, 2: 2.0}
    path = os.path.join(tmpdir_path, "fact")
    io.replace_partitions(spark.createDataFrame([(1, 1.0), (2, 2.0)], "entity int, v double"), path, ["entity"])
    io.replace_partitions(spark.createDataFrame([(2, 20.0)], "entity int, v double"), path, ["entity"])
    got = {r["entity"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {1: 1.0, 2: 20.0}


def test_csv_export_roundtrip_and_cases(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    p = os.path.join(tmpdir_path, "out_csv")
    io.write_csv(df, p)
    back = io.read_csv(spark, p, "id int, name string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    j = os.path.join(tmpdir_path, "cases.json")
    with open(j, "w") as f:
        json.dump({"location": [{"query": "Tarlac", "expected_status": "RESOLVED"},
                                {"query": "", "expected_status": "NOT_FOUND"}]}, f)
    cases = io.read_cases(spark, j, "location", "query string, expected_status string")
    assert cases.count() == 2


def test_series_explode_end_exclusive(spark):
    df = spark.createDataFrame([(1, 0, 3 * 86400, 86400, [1.0, 2.0, 3.0])], "k int, s long, e long, step long, v array<double>")
    out = io.series_explode(df, ["k"], "s", "e", "step", ["v"]).collect()
    assert [r["v"] for r in out] == [1.0, 2.0, 3.0]


def test_latest_model(spark):
    reg = spark.createDataFrame([("m", "a", 1.0, "2024-01-01"), ("m", "a", 2.0, "2024-02-01"), ("n", "a", 3.0, "2023-01-01")],
                                "model_type string, feature string, coef double, trained_at string")
    got = {(r["model_type"], r["coef"]) for r in io.latest_model(reg).collect()}
    assert got == {("m", 2.0), ("n", 3.0)}


def test_utm_roundtrip_and_square_centroid(spark):
    df = spark.createDataFrame([(15.5, 120.9), (14.0, 121.5)], "lat double, lon double")
    e, n = geo.utm_forward(F.col("lat"), F.col("lon"), 51)
    back = df.select(e.alias("e"), n.alias("n")).select(*geo.utm_inverse(F.col("e"), F.col("n"), 51)).collect()
    for (la, lo), r in zip([(15.5, 120.9), (14.0, 121.5)], back):
        assert abs(r[0] - la) < 1e-7 and abs(r[1] - lo) < 1e-7
    # central meridian maps to the false easting
    assert abs(spark.range(1).select(geo.utm_forward(F.lit(10.0), F.lit(123.0), 51)[0]).first()[0] - 500000.0) < 1e-6
    sq = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])],
                               "polygon_id int, ring int, seq int, x double, y double")
    c = geo.polygon_centroid(sq).collect()[0]
    assert (c["area"], c["cx"], c["cy"]) == (4.0, 1.0, 1.0)


def test_conversation_ops(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", ""), (1, 2, "user", "r1"), (1, 3, "assistant", "call"),
            (1, 4, "user", "r2"), (1, 5, "user", "r3"), (1, 6, "system", "s")]
    c = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    last = [r["turn"] for r in conv.last_n_turns(c, 2).orderBy("recency").collect()]
    assert last == [5, 4]
    blk = sorted(r["turn"] for r in conv.latest_tool_block(c, F.col("role") == "assistant", F.col("role") == "user").collect())
    assert blk == [4, 5]
    tr = conv.transcript(c).collect()[0]["transcript"]
    assert tr.splitlines()[0] == "User: q1" and "s" not in tr.splitlines()


def test_slot_carry_reset(spark):
    allowed = {"A": ["loc"], "B": []}
    ev_rows = [(1, 1, "A", True, "loc", "x"), (1, 2, "A", True, "loc", ""), (1, 3, "A", False, "loc", "ignored"),
               (1, 4, "B", True, "loc", "y"), (1, 5, "A", True, "loc", None), (1, 6, "A", True, "loc", "z")]
    df = spark.createDataFrame(ev_rows, "conv_id int, turn int, action string, confident boolean, slot string, value string")
    out = [r["state"] for r in conv.slot_carry(df, allowed).orderBy("turn").collect()]
    assert out == ["x", "x", "x", None, None, "z"]


def test_binary_metrics_zero_safe(spark):
    df = spark.createDataFrame([(False, False), (False, True)], "p boolean, l boolean")
    r = ev.binary_metrics(df, "p", "l").collect()[0]
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
