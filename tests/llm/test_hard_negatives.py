import numpy as np
import pytest
from pyspark.sql import functions as F

from paddyframe.llm import hard_negatives as hn
from paddyframe.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, score int, at int"


def brute(rows, every=50):
    """Integer products of every anchor with every row."""
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows]
    out = set()
    for a, la, x in (r for r in rows if r[0] % every == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, l) for i, l, y in rows if i != a)
        for s, i, _ in [t for t in scored if t[2] == la][:5]:
            fit = [(t, j) for t, j, l in scored if l != la and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)}
    return out


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hn.mine(hn.usable(df, label), "vec_id % 50 = 0").collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2) for i, v, l in rows], SCHEMA)


def test_intervals_hold_the_score():
    rng = np.random.default_rng(0)
    for d in (1, 3, 64, 100):
        x = rng.integers(-300, 300, (200, d))
        x[0] = 0
        block = hn.Block(np.arange(200), np.zeros(200, int), x)
        for v in (x[1], x[0], rng.integers(-5, 900, d)):
            seen = []
            def keep(least, most):
                true = x @ v
                assert (least <= true + 1e-6).all() and (true <= most + 1e-6).all()
                seen.append((most - least).mean())
                return np.ones(len(least), bool)
            assert len(block.narrowed(*hn.askers(v[None]), np.arange(200), keep)) == 200
            assert seen == sorted(seen, reverse=True)
            assert (block.scores(v, np.arange(200)) == x @ v).all()


def test_codes_drop_most_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    x[:7] = x[0]
    block = hn.Block(np.arange(4000), np.zeros(4000, int), x)
    left = block.narrowed(*hn.askers(x[:1]), np.arange(1, 4000), lambda least, most: most >= hn._kth(least, 5))
    assert {1, 2, 3, 4, 5, 6} == set(left.tolist())


def test_given_vectors(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in t.collect()]
    want = brute(rows)
    assert len(want) > 20 and {tuple(r) for r in queries.op12_hard_negatives(spark, "/root/testdata/sf0.01").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_ties_and_hot_labels(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hn, "PACK_ROWS", 3)
    monkeypatch.setattr(hn, "GROUP_PACKS", 2)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 9))
    some = [(int(i), (centre[rng.integers(6)] + rng.normal(size=9) * rng.choice([0, .02, .4])).round(2).tolist(), int(rng.choice([1, 1, 1, 2, 3])))
            for i in rng.choice(4000, 500, replace=False)]
    some += [(5000 + i, centre[0].tolist(), 4) for i in range(120)] + [(-50, [0.0] * 9, 1), (-100, (-centre[0]).tolist(), 2)]
    assert mined(table(spark, some)) == brute(some)


def test_odd_rows(spark):
    good = [(50, [1.0, 0.0], 3), (1, [0.9, 0.1], 3), (2, [0.6, 0.0], 4), (3, [0.86, 0.0], 4)]
    bad = [(100, None, 1), (400, [1.0, None], 1), (150, [float("nan"), 1.0], 1), (200, [float("inf"), 1.0], 1), (250, [1.0], 1), (300, [1.0, 1.0], None)]
    odd = table(spark, good + bad + good).union(spark.createDataFrame([(None, [1.0, 0.0], 3, 0, 0)], SCHEMA))
    assert mined(odd) == brute(good) == {(50, 1, 1, 2, 58880, 39168)}
    assert mined(table(spark, good[:1])) == set() and mined(table(spark, [])) == set()


@pytest.mark.parametrize("size", [1e4, 1e7, 1e12])
def test_large_components(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i * 10, (rng.integers(1, 9, 4) * size / 256).tolist(), i % 3) for i in range(40)]
    want = {tuple(min(x, 2**63 - 1) for x in r) for r in brute(rows)}
    got = mined(table(spark, rows))
    if size < 1e12:
        assert got == want and got
    else:       # scores beyond a long are the nearest long
        assert all(r[4] <= 2**63 - 1 for r in got)
