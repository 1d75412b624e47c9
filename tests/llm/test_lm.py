import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

from paddyframe.llm import chunks as C
from paddyframe.llm import lm
from paddyframe.llm.eliasfano import EliasFano, Level, dump, load


@pytest.mark.parametrize("n,u", [(0, 10), (1, 1), (1, 1 << 40), (300, 300), (2000, 1 << 32), (5000, 70), (3000, 1 << 60)])
def test_elias_fano(n, u):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
    ef = EliasFano(v, u)
    if n:
        assert (ef.access(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64), np.array([0, u - 1], np.uint64)])
    assert (ef.successor(q) == np.searchsorted(v, q)).all()
    there = ef.find(q)
    assert ((there >= 0) == np.isin(q, v)).all() and (v[there[there >= 0]] == q[there >= 0]).all()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 32, 100_000, dtype=np.uint64))
    ef = EliasFano(v, 1 << 32)
    assert sum(getattr(ef, a).nbytes for a in ef.arrays) < 2.6 * len(v)


@pytest.mark.parametrize("n,u", [(0, 9), (1, 1 << 63), (2, 1 << 63), (300, 400)] + [(4001, 1 << k) for k in range(13, 64)])
def test_coded_sorted_values(n, u):
    v = np.unique(np.random.default_rng(n).integers(0, u, n, dtype=np.uint64) * np.uint64(2 if u >> 63 else 1))
    assert (load(dump(v)) == v).all() and load(dump(v)).dtype == np.uint64
    ends = np.array([0, (1 << 64) - 1], np.uint64)
    assert (load(dump(ends)) == ends).all()
    # low half bytes of the gaps' size, and at most about two bits and a half byte's rounding more
    gap = max(int(v[-1] - v[0]) // len(v), 1).bit_length() if n else 0
    assert len(dump(v)) <= (gap / 8 + 0.5 + 0.25) * len(v) + 40


def test_level_in_a_mapped_file():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a) * 77_777, int(b) * 1000) for a, b in zip(rng.zipf(1.3, 4000) % 50_000, rng.integers(0, 4_000_000, 4000))})
    ctx, kid = (np.array(x, np.uint64) for x in zip(*pairs))
    code = np.arange(1, len(ctx) + 1)
    with tempfile.TemporaryFile() as f:
        level = Level(ctx, kid, code).map_to(f)
        assert isinstance(level.children.upper, np.memmap)
        assert (level.codes(ctx, kid) == code).all()
        assert (level.codes(ctx, kid + np.uint64(1)) == 0).all() and (level.codes(ctx + np.uint64(1), kid) == 0).all()
        assert (level.codes(ctx[::-1], kid) > 0).sum() == sum((a, b) in set(pairs) for a, b in zip(ctx[::-1].tolist(), kid.tolist()))


def slow(rows, order):
    words = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    train = [w for w, h in zip(words, held) if not h]
    c = Counter(x for w in train for x in w)
    n, v, ones = sum(c.values()), len(c), sum(k == 1 for k in c.values())
    grams = [Counter() for _ in range(order + 1)]
    for w in train:
        p = [None] + w
        for k in range(2, order + 1):
            grams[k].update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    return words, held, c, n, v, ones, grams


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_counts(spark, docs, order, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10 + i, f"the cat sat on the mat {i % 4} the end") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, held, c, n, v, ones, grams = slow(rows, order)
    fitted = {}
    fit = lm.fit_heaps
    monkeypatch.setattr(lm, "fit_heaps", lambda s: fitted.setdefault("x", fit(s)))
    monkeypatch.setattr(C, "SHARD_KEYS", 100)
    got = sorted(tuple(r) for r in lm.score(df, order).collect())
    scale, power = fitted["x"]
    want = []
    for (d, _), w, h in zip(rows, words, held):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        p = [None] + w
        for i in range(1, len(p)):
            pr = (1 - ones / n) * c[p[i]] / n if c[p[i]] else ones / n
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                ctx = tuple(p[i - k + 1:i])
                total = c[ctx[0]] if k == 2 else grams[k - 1][ctx]
                if not total:
                    continue
                new = min(max(scale * power * total ** (power - 1), 1e-4), 0.999)
                pr = (1 - new) * grams[k][ctx + (p[i],)] / total + new * pr
            score += math.log10(pr)
        want.append((d, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5] for g in got], [w[5] for w in sorted(want)])
    # codes round probabilities down by up to 0.1 % a factor of ten in steps of 0.001
    for g, w in zip(got, sorted(want)):
        assert abs(g[6] - w[6]) <= 0.0011 * order * g[2] + 1e-6


def test_beats_the_unigram_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score >= got.base_score).mean() > 0.95


def test_probabilities_sum_to_one():
    scale, power = lm.fit_heaps(np.array([[5.0, 5, 5], [4, 10, 9], [3, 15, 11], [1, 20, 13]]))
    assert 0 < power < 1
    c, follow = 20, {"a": 12, "b": 8}
    uni = {"a": 0.5, "b": 0.3, "z": 0.1, "unknown": 0.1}
    new = scale * power * c ** (power - 1)
    assert abs(sum((1 - new) * follow.get(w, 0) / c + new * uni[w] for w in uni) - 1) < 1e-12


def test_empty_and_all_held_out(spark, docs):
    assert lm.score(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_production_sees_two_words_back(spark):
    # "p" and "q" follow "x" as often; only the word before it tells which
    rows = [(i, ("a x p " if i % 2 else "b x q ") * 20) for i in range(200)] + [(1000, "a x p"), (1001, "a x q")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] - got[1001] > 0.5
