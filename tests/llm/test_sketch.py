from pyspark.sql import functions as F

from paddyframe.llm import sketch as S


def test_edited_text_next_and_likeness(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = S.fingerprints(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    texts, ids = {}, sorted({d for d, _ in rows})
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        t = texts[r.doc_id]
        nxt = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        want = {t[:len(t) - half] + x[:half] for x in ([nxt, t] if r.doc_id == 5 else [nxt])}  # doc 5 comes twice
        assert r.n_chars == len(t) and r.edited in want
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[5].sketch == by[12].sketch and by[2].sketch == [] and by[1].near_next == 1.0
    assert by[12].near_next > 0.9  # document 13 holds all of document 12
    assert 0.85 < by[11].near_edited < 0.95  # 1500 of the 1700 words of its edited text


def test_sketch_is_scaled_and_mergeable(spark):
    text = lambda a, b: " ".join(f"w{i * 7919 % 10007}" for i in range(a, b))
    df = spark.createDataFrame([(text(0, 4000), text(3000, 3600), text(0, 4000) + " " + text(3000, 3600))], "a string, b string, ab string")
    r = df.select(S.sketch(F.col("a")).alias("a"), S.sketch(F.col("b")).alias("b"),
                  S.sketch(F.col("ab")).alias("ab")).select("*", S.merge(F.col("a"), F.col("b")).alias("m"),
                                                          S.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert 0.2 < len(r.a) / 3996 < 0.3 and r.a == sorted(set(r.a))
    assert r.c == 1.0  # b is a part of a, however unequal they are
    assert set(r.m) == set(r.a) | set(r.b) and set(r.m) <= set(r.ab) and len(set(r.ab) - set(r.m)) <= 4


def test_next_over_many_ranges(spark):
    ids = [i * i % 100003 for i in range(3000)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    want = sorted(set(ids))
    got = {(r.doc_id, r.t) for r in S.with_next(df.dropDuplicates(), ["text"]).select("doc_id", F.col("next.text").alias("t")).collect()}
    assert got == {(d, f"t{want[(i + 1) % len(want)]}") for i, d in enumerate(want)}


def test_empty_and_single(spark, docs):
    assert S.fingerprints(docs.limit(0)).count() == 0
    r = S.fingerprints(docs.filter("doc_id = 14")).first()
    assert r.edited == "THE QuicTHE Qui"
    assert r.near_next == 1.0


def test_no_python_in_the_plan(spark, docs):
    plan = S.fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
