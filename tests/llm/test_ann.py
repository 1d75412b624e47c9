import numpy as np
import pytest
from pyspark.sql import functions as F

from paddyframe.llm import ann


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(np.square(x - x[i]).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


IS_QUERY = "vec_id % 100 = 0"


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(50, 48))
    y = ann.rotate(x, 3, 16)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert y.shape == (50, 64) and np.allclose(y @ y.T, u @ u.T)
    a = ann.axes(y, 3)
    assert (np.abs(y).argmax(1) == a[:, 0] // 2).all() and (a[:, 0] % 2 == (y[np.arange(50), a[:, 0] // 2] < 0)).all()


def test_recall_on_the_given_vectors(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = t.toPandas()
    ids, x = pdf.vec_id.tolist(), np.stack(pdf.embedding).astype(float)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = results(ann.nearest(t, IS_QUERY))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95
    place = {i: j for j, i in enumerate(ids)}
    for q, v in got.items():
        assert all(abs(s - np.linalg.norm(x[place[q]] - x[place[i]])) < 1e-12 for i, s in v) and v == sorted(v, key=lambda p: (p[1], p[0]))


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_few_vectors_are_all_found(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 5))
    rows = [(i * 50, x[i].tolist(), 1) for i in range(n)]
    got = results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, q int"), IS_QUERY))
    want = brute([r[0] for r in rows], x, [r[0] for r in rows if r[0] % 100 == 0])
    assert all(len(got.get(q, [])) == len(v) for q, v in want.items())
    if n <= 7:
        assert {q: [i for i, _ in v] for q, v in want.items() if v} == {q: [i for i, _ in v] for q, v in got.items()}


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    rng = np.random.default_rng(1)
    same = rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(0, 300)] + [(i, rng.normal(size=8).tolist()) for i in range(300, 420)]
    bad = [(500, None), (600, [0.0] * 8), (700, [float("nan")] + [1.0] * 7), (800, [float("inf")] * 8), (900, [1.0, None] + [1.0] * 6), (1000, [1.0])]
    got = results(ann.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), IS_QUERY))
    assert sorted(got) == [0, 100, 200, 300, 400]
    assert [i for i, _ in got[100]] == list(range(10)) and [i for i, _ in got[0]] == list(range(1, 11))
    assert all(s == 0 for _, s in got[200])


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), IS_QUERY).count() == 0
