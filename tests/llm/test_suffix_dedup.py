import numpy as np
import pytest

from paddyframe.llm import chunks as C
from paddyframe.llm import suffix_dedup as sd


def slow(rows, k):
    """All k-byte strings in order of (doc_id, row, start)."""
    seen, gone = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0], i)):
        raw = (rows[i][1] or "").encode()
        gone[i] = np.zeros(len(raw), bool)
        for p in range(len(raw) - k + 1):
            if raw[p:p + k] in seen:
                gone[i][p:p + k] = True
            seen.add(raw[p:p + k])
    out = []
    for i, (d, t) in enumerate(rows):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        g = gone[i]
        out.append((d, len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()),
                    raw[~g].tobytes()))
    return out


def fast(df, k=100):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_suffixes(df, k).collect())


@pytest.fixture()
def edits(spark):
    """Near copies with scattered edits, shared passages in other surroundings, periodic texts."""
    rng = np.random.default_rng(9)
    base = bytes(rng.integers(97, 107, 1500, dtype=np.uint8)).decode()
    rows = []
    for d in range(25):
        t = list(base)
        for p in rng.integers(0, len(t), rng.integers(1, 14)):
            t[p] = "É"
        t = "".join(t)
        a, b = sorted(rng.integers(0, len(t), 2))
        rows.append((d * 3 % 25, t if d % 3 else bytes(rng.integers(97, 123, 150, dtype=np.uint8)).decode() + t[a:b]))
    rows += [(30, "ab" * 400), (31, "x" + "ab" * 90 + "y"), (32, base[:99]), (33, base[:100]), (34, base[:101])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(spark, docs, edits):
    for df in (docs.select("doc_id", "text").coalesce(1), edits.coalesce(1)):
        rows = [tuple(r) for r in df.collect()]
        assert fast(df) == sorted(slow(rows, 100))


def test_small_blocks_segments_shards(spark, edits, monkeypatch):
    rows = [tuple(r) for r in edits.coalesce(1).collect()]
    want = sorted(slow(rows, 100))
    monkeypatch.setattr(C, "SHARD_KEYS", 50)
    monkeypatch.setattr(C, "BLOCK_BYTES", 3000)
    assert fast(edits.coalesce(1)) == want
    monkeypatch.setattr(C, "BLOCK_BYTES", 1 << 22)
    block = C.Block(C.pack(edits.coalesce(1)).toPandas().iloc[0])
    whole = sd.elected(block, 100, 32)
    monkeypatch.setattr(sd, "SEGMENT", 700)
    parts = sd.elected(block, 100, 32)
    assert (parts[1] - parts[0] + 1).sum() == (whole[1] - whole[0] + 1).sum()
    assert fast(edits.coalesce(1)) == want


def test_other_threshold_and_empty(spark, edits):
    rows = [tuple(r) for r in edits.coalesce(1).collect()]
    for k in (64, 70, 300):
        assert fast(edits.coalesce(1), k) == sorted(slow(rows, k))
    assert sd.dedup_suffixes(edits.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.dedup_suffixes(edits, 40)
