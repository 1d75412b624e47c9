import xxhash

from paddyframe.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    words += [cur] * bool(cur)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, most):
    comp = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for d, a in fps:
            for e, b in fps:
                if bin(a ^ b).count("1") <= most and comp[e] < comp[d]:
                    comp[d], changed = comp[e], True
    return comp


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted((d, f) for d, f, _ in got) == sorted(fps)
    comp = slow_components(fps, 2)
    assert all(c == comp[d] for d, _, c in got)


def test_links_connect_every_close_pair(spark):
    import random
    random.seed(1)
    fps = []
    for _ in range(40):  # chains that drift apart by one to three bits
        f = random.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            for b in random.sample(range(64), random.choice([1, 2, 3])):
                f ^= 1 << b
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for most in (0, 1, 2, 3):
        got = [(r.src, r.dst) for r in simhash.links(df, most).collect()]
        dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert all(dist(a, b) <= most for a, b in got)
        names = {f: i for i, f in enumerate(fps)}
        want = slow_components([(names[f], f & (2**64 - 1)) for f in fps], most)
        edges = spark.createDataFrame([(names[a], names[b]) for a, b in got], "a long, b long")
        from paddyframe.llm.components import components
        comp = {r.node: r.component for r in components(edges).collect()}
        assert {i: comp.get(i, i) for i in want} == want


def test_empty(spark, docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
