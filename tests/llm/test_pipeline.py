import sys
from collections import Counter
from pathlib import Path

import pytest
from test_chunk_dedup import slow as slow_removal
from test_simhash import slow_components, slow_fingerprint

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402
from paddyframe.llm import chunk_dedup, packing  # noqa: E402

pytest.importorskip("public_tokenizers")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], str(r)))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    junk = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "?? 123 !!", None, "s", 9),
                                  (10**6 + 2, "慶应 愛知 " * 90, None, "s", 0)], docs.schema)
    first = cp.language_id(spark, docs.union(junk), "")
    assert first.columns == docs.columns and rows_of(first) == rows_of(docs)

    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    comp = slow_components(fps, 2)
    second = cp.simhash_dedup(spark, docs, "")
    assert second.columns == docs.columns
    assert rows_of(second) == [r for r in rows_of(docs) if comp[r[0]] == r[0]]

    third = cp.substring_dedup(spark, second.coalesce(1), "")
    assert third.schema.simpleString() == docs.schema.simpleString()
    left = dict(slow_removal([(r.doc_id, r.text) for r in second.coalesce(1).collect()], chunk_dedup.MIN_RUN))
    want = [(d, left[d], lang, src, len(left[d])) for d, _, lang, src, _ in rows_of(second)]
    assert rows_of(third) == want

    last = cp.best_fit_packing(spark, third, "").collect()
    enc = packing.WordEncoder(cp.BYTE_BPE)
    assert Counter(r.doc_id for r in last) == {d: -(-(len(enc.encode(t)) // 4 + 1) // 2048) for d, t, *_ in want}


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, f in cp.STAGES:
        docs = f(spark, docs, "")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in df.collect())
    assert key(cp.run(spark, "/root/testdata/sf0.001")) == key(docs)


def test_odd_rows(spark, docs):
    third = docs
    for _, f in cp.STAGES[:3]:
        third = f(spark, third, "")
        assert third.columns == docs.columns
        assert third.limit(0).count() == 0 and f(spark, docs.limit(0), "").count() == 0
    ids = [r.doc_id for r in third.collect()]
    assert len(ids) == len(set(ids))
    # columns of any type and null texts travel along
    kept = chunk_dedup.without_repeats(docs)
    assert rows_of(kept.drop("text")) == rows_of(docs.drop("text"))
    assert [r.text for r in kept.filter("doc_id = 1").collect()] == [None]
