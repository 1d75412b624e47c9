import json
import os

import pytest

from paddyframe.sources import io, registry

COEFS = "feature string, mean double, std double, coef double"


def coefs(spark, x):
    return spark.createDataFrame([("a", 0.0, 1.0, x), ("b", 0.0, 1.0, -x)], COEFS)


def loaded(spark, where):
    return {(r.model_type, r.feature): r.coef for r in registry.load_latest(spark, where, COEFS).collect()}


def test_registry_loads_the_latest_committed_version(spark, tmpdir_path):
    where = os.path.join(tmpdir_path, "models")
    assert loaded(spark, where) == {} and registry.commits(spark, where).count() == 0
    registry.save(coefs(spark, 2.0), where, "m", "2026-02-01 00:00:00")
    registry.save(coefs(spark, 1.0), where, "m", "2026-01-01 00:00:00")
    registry.save(coefs(spark, 7.0), where, "other", "2020-01-01 00:00:00")
    assert loaded(spark, where) == {("m", "a"): 2.0, ("m", "b"): -2.0, ("other", "a"): 7.0, ("other", "b"): -7.0}


def test_a_writer_that_dies_leaves_nothing_that_counts(spark, tmpdir_path):
    where = os.path.join(tmpdir_path, "models")
    registry.save(coefs(spark, 1.0), where, "m", "2026-01-01 00:00:00")
    registry.write_version(coefs(spark, 9.0), where, "m")       # written whole, never committed
    broken = spark.range(2).selectExpr("'a' as feature", "0D as mean", "1D as std", "raise_error('lost') as coef")
    with pytest.raises(Exception, match="lost"):
        registry.save(broken, where, "m", "2026-03-01 00:00:00")
    assert loaded(spark, where) == {("m", "a"): 1.0, ("m", "b"): -1.0}


def test_two_writers_of_one_stamp_never_mix(spark, tmpdir_path):
    where = os.path.join(tmpdir_path, "models")
    a = registry.write_version(coefs(spark, 1.0), where, "m")
    b = registry.write_version(coefs(spark, 2.0), where, "m")
    for v in (b, a):
        registry.commit(spark, where, "m", v, "2026-01-01 00:00:00")
    x = 1.0 if a > b else 2.0
    assert loaded(spark, where) == {("m", "a"): x, ("m", "b"): -x}


def test_csv_cells_come_back_as_they_were(spark, tmpdir_path):
    cells = ["plain", "", None, " blanks at the ends\t", 'a "quoted" word', '"', "line\nbreak, comma", "\n", "back\\slash", "ünï 😀", ",", "#x", '""', "\\"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, t string").repartition(3)
    io.write_csv(df, tmpdir_path + "/csv")
    back = io.read_csv(spark, tmpdir_path + "/csv", "id int, t string", keep_corrupt=True).collect()
    assert {r.id: r.t for r in back} == dict(enumerate(cells)) and all(r[io.CORRUPT] is None for r in back)


def test_csv_rows_that_do_not_fit_are_kept(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bad.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,t\n1,a\nx,b\n2,c,extra\n3,"d\ne"\n')
    rows = io.read_csv(spark, p, "id int, t string", keep_corrupt=True).collect()
    fit = {r.id: r.t for r in rows if r[io.CORRUPT] is None}
    assert fit == {1: "a", 3: "d\ne"} and {r[io.CORRUPT] for r in rows} - {None} == {"x,b", "2,c,extra"}
    assert io.read_csv(spark, p).columns == ["id", "t"]


def test_json_cases_in_lines_with_bad_ones(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cases.json")
    with open(p, "w") as f:
        f.write(json.dumps({"k": 1, "cases": [{"q": 'a "b"\nc', "n": 1}, {"q": None}]}) + "\n{broken\n" + json.dumps({"k": 2, "cases": []}) + "\n")
    rows = io.read_cases(spark, p, "cases", "q:string,n:int", "k int", multi_line=False, keep_corrupt=True).collect()
    assert sorted((r.k or 0, r.q or "", r.n or 0, r[io.CORRUPT] or "") for r in rows) == [(0, "", 0, "{broken"), (1, "", 0, ""), (1, 'a "b"\nc', 1, "")]
    assert io.read_cases(spark, p, "cases", "q:string,n:int", "k int", multi_line=False).count() == 2


def test_append_new_writes_only_new_keys(spark, tmpdir_path):
    path = tmpdir_path + "/fact"
    spark.createDataFrame([(1, 2020, 1.0)], "k int, y int, v double").write.parquet(path)
    new = spark.createDataFrame([(1, 2020, 9.0), (2, 2020, 3.0), (2, 2020, 2.0)], "k int, y int, v double")
    for _ in range(2):      # the second time nothing is new
        io.append_new(new, path, ["k", "y"], ["v"])
        assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 2.0)]
