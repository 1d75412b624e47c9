import os

from paddyframe.streaming.ingest import stream_daily_facts


def test_stream_insert_or_ignore(spark, tmpdir_path):
    landing, sink = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "sink")
    schema = "entity_id int, day date, precipitation_sum double"
    spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", 7.0)], "entity_id int, day string, precipitation_sum double") \
        .selectExpr("entity_id", "to_date(day) AS day", "precipitation_sum").write.parquet(os.path.join(landing, "b1"))
    q = stream_daily_facts(spark, os.path.join(landing, "*"), schema, sink, ["entity_id", "day"], name="t1")
    q.awaitTermination(120)
    # a revised value for an existing key is ignored, a new key is inserted
    spark.createDataFrame([(1, "2024-01-02", 99.0), (2, "2024-01-02", 1.0)], "entity_id int, day string, precipitation_sum double") \
        .selectExpr("entity_id", "to_date(day) AS day", "precipitation_sum").write.parquet(os.path.join(landing, "b2"))
    q = stream_daily_facts(spark, os.path.join(landing, "*"), schema, sink, ["entity_id", "day"], name="t1")
    q.awaitTermination(120)
    got = {(r["entity_id"], str(r["day"])): r["precipitation_sum"] for r in spark.read.parquet(sink).collect()}
    assert got == {(1, "2024-01-01"): 5.0, (1, "2024-01-02"): 7.0, (2, "2024-01-02"): 1.0}
