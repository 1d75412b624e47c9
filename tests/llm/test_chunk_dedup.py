import re

import numpy as np

from paddyframe.llm import chunk_dedup as cd
from paddyframe.llm import chunks as C


def goes(raw, start, end, min_run):
    """A run of repeated chunks goes if it is long, or if it and the 80 bytes on either side (of its document) hold over 50 words."""
    return end - start >= min_run or len(re.findall(rb"[^\x20\x09-\x0D]+", raw[max(0, start - 80):end + 80])) > 50


def slow(rows, min_run):
    """One pass over all documents in order, with a dictionary of first copies."""
    seen, out = {}, []
    cuts_of = []
    for order, (d, t) in enumerate(rows):
        raw = (t or "").encode()
        cuts = cd.cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        cuts_of.append((d, order, raw, [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]))
    flags = {}
    for d, order, raw, parts in sorted(cuts_of, key=lambda x: (x[0], x[1])):
        for a, b in parts:
            flags[order, a] = raw[a:b] in seen
            seen.setdefault(raw[a:b], 1)
    for d, order, raw, parts in cuts_of:
        kept, run = b"", []
        for a, b in parts + [(len(raw), len(raw) + 1)]:
            if b <= len(raw) and flags[order, a]:
                run.append((a, b))
                continue
            if run and not goes(raw, run[0][0], run[-1][1], min_run):
                kept += raw[run[0][0]:run[-1][1]]
            run = []
            kept += raw[a:b]
        out.append((d, kept.decode()))
    return out


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = cd.dedup_substrings(docs.coalesce(1)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(slow(rows, cd.MIN_RUN))
    by = {r.doc_id: r for r in got}
    assert by[7].n_removed > 300 and by[6].n_removed == 0 and by[11].n_removed == 0
    assert by[12].text == "" and by[1].text == ""


def test_small_blocks_and_many_shards_agree(spark, docs, monkeypatch):
    want = sorted((r.doc_id, r.text) for r in cd.dedup_substrings(docs.coalesce(1)).collect())
    monkeypatch.setattr(C, "SHARD_KEYS", 8)
    monkeypatch.setattr(C, "BLOCK_BYTES", 600)
    assert sorted((r.doc_id, r.text) for r in cd.dedup_substrings(docs.coalesce(1)).collect()) == want


def test_boundaries_resist_insertions():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 20000, dtype=np.uint8))
    cut = lambda b: {b[a:z] for a, z in zip(*(lambda c: (c, c[1:]))(
        cd.cut_points(np.frombuffer(b, np.uint8), np.array([0, len(b)])).tolist()))}
    a, b = cut(text), cut(text[:7000] + b"INSERTED" + text[7000:])
    assert len(a & b) > 0.97 * len(a)


def test_empty(spark, docs):
    assert cd.dedup_substrings(docs.limit(0)).count() == 0


def test_passages_of_51_short_words_go(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda most: "".join(rng.choice(letters, rng.integers(1, most + 1)))
    say = lambda n, most: " ".join(word(most) for _ in range(n))
    rows, planted = [], {}
    for i in range(150):
        passage = say(51, 3 + i % 5)
        rows += [(2 * i, f"{say(60, 9)} {passage} {say(60, 9)}"), (2 * i + 1, f"{say(60, 9)} {passage} {say(60, 9)}")]
        planted[2 * i + 1] = passage
    phrase = say(12, 6)     # a phrase is no passage
    rows += [(1000, f"{say(60, 9)} {phrase} {say(60, 9)}"), (1001, f"{say(60, 9)} {phrase} {say(60, 9)}")]
    text = dict(rows)
    for r in cd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id not in planted:
            assert r.n_removed == 0
            continue
        # by brute force: what went stands in the first copy, and all that is left of the passage are its ends
        raw = text[r.doc_id].encode()
        assert r.n_spans == 1 and raw[r.spans[0].start:r.spans[0].end] in text[r.doc_id - 1].encode()
        at = raw.index(planted[r.doc_id].encode())
        assert max(0, r.spans[0].start - at) <= cd.EDGE
        assert max(0, at + len(planted[r.doc_id]) - r.spans[0].end) <= cd.EDGE
