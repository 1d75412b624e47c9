import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paddyframe.llm import packing as P

path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def fewest(items, capacity):
    """Fewest bins by exhaustive search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    random.seed(3)
    reduced = 0
    for _ in range(400):
        cap = random.choice([10, 17, 24])
        items = [random.randint(1, cap) for _ in range(random.randint(1, 10))]
        left = dict(Counter(items))
        fixed = P.reduce_by_dominance(left, cap)
        used = sum(n for _, n in fixed)
        rest = [x for x, c in left.items() for _ in range(c)]
        assert all(sum(s) <= cap for s, _ in fixed)
        assert used + fewest(rest, cap) == fewest(items, cap)
        reduced += sum(len(s) * n for s, n in fixed)
    assert reduced > 500


def test_best_fit_equals_one_by_one():
    random.seed(4)
    for _ in range(60):
        cap = 40
        items = sorted((random.randint(1, 40) for _ in range(random.randint(1, 300))), reverse=True)
        bins = []
        for x in items:
            fit = [i for i, b in enumerate(bins) if b + x <= cap]
            if fit:
                bins[max(fit, key=lambda i: bins[i])] += x
            else:
                bins.append(x)
        got = P.best_fit(dict(Counter(items)), cap)
        assert sorted(sum(s) for s, n in got for _ in range(n)) == sorted(bins)
        assert Counter(x for s, n in got for _ in range(n) for x in s) == Counter(items)


@pytest.mark.parametrize("text", ["plain words here", "two  spaces   three", " lead", "trail ", "trail  ", "a\n b", "a \nb",
                                  "a\n\n  b\t c", "don't we'll  'tis", "x\u3000 y", "\u00a0 z", "日本 語", "<|endoftext|> x", "a <|endoftext|> b",
                                  "1 23  4", " ", "  ", "\n", "a\x85 b", "a\x1c  b \x1c", "A\u200b \u200bB", "ends \n ",
                                  "don't. we'll, 's. a.b. ... ?! x.) y).", ". a", "a, <|endoftext|>. é. 1. x1. ª. \u02b0. e\u0301."])
def test_word_encoding_equals_the_library(text):
    enc = P.WordEncoder(path)
    for _ in range(2):  # from the tokenizer, then from memory
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_random_white_space_equals_the_library():
    random.seed(0)
    enc = P.WordEncoder(path)
    for _ in range(3000):
        t = "".join(random.choice(["a", "bc", " ", "  ", "\n", "\t", "'s", "1", ".", ",", "\u00a0", "é", "\x1f", "\u2003", "!"]) for _ in range(9))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_every_letter_taken_for_known_equals_the_library():
    enc = P.WordEncoder(path)
    marks = [chr(c) for c in [*range(33, 127), *range(0xa0, 0x600)]]
    for before in ("a", "1", "!", "\n"):
        text = " ".join(f"x{before}{c}{before}{c}" for c in marks)
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_mixed_words_equal_the_library(monkeypatch):
    monkeypatch.setattr(P, "MEMO_WORDS", 50)   # the memo is given up again and again
    random.seed(7)
    parts = ["Ab", "é", "ñandú", "日本", "слово", "12", "½", "²", ".", "\n", "***", "'s", "'", "’", "<|endoftext|>", "_", "|", "\t", "e\u0301", "🙂", "x" * 70]
    words = ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(600)]
    texts = [random.choice(["", " ", "  "]) .join(["", " ".join(random.choices(words, k=random.randint(1, 40)))]) for _ in range(300)] + ["", " "]
    enc = P.WordEncoder(path)
    for batch in (texts, texts[::-1], texts[:1], []):
        ids, bounds = enc.encode_all(pa.array(batch, pa.string()))
        got = [np.frombuffer(ids[a:b], "<u4").tolist() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in batch]


def test_fresh_words_share_calls():
    class Counting:
        def __init__(self, tok):
            self.tok, self.n = tok, 0

        def encode_batch_fast(self, *args, **kw):
            self.n += 1
            return self.tok.encode_batch_fast(*args, **kw)

    enc = P.WordEncoder(path)
    enc.tok, enc.bare = full, bare = Counting(enc.tok), Counting(enc.bare)
    random.seed(8)
    texts = [" ".join("".join(random.choices("abcdé", k=9)) + random.choice(["", ".", ".\nThe", "***"]) for _ in range(50)) for _ in range(40)]
    enc.encode_all(pa.array(texts))
    assert full.n + bare.n < 10     # 2000 different words


def test_rows_in_batches_by_size(monkeypatch):
    monkeypatch.setattr(P, "TEXT_BATCH", 1000)
    random.seed(9)
    texts = ["x" * random.choice([0, 1, 100, 900, 5000]) for _ in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    got = list(P._by_size(iter([rows.slice(0, 7), rows.slice(7, 0), rows.slice(7, 100), rows.slice(107)])))
    assert [d for b in got for d in b.column("doc_id").to_pylist()] == list(range(200))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    size = [sum(len(t) + P.ROW_BYTES for t in b.column("text").to_pylist()) for b in got]
    assert all(n <= 1000 or b.num_rows == 1 for n, b in zip(size, got)) and len(got) < 160


def test_pack(spark, docs):
    enc = P.WordEncoder(path)
    for cap in (64, 2048):
        got = P.pack(docs, path, cap).collect()
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.append(np.array(enc.tok.encode(r.text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
            n = len(ids)
            first = n % cap or cap
            cuts = [0] + list(range(first, n, cap)) + [n] if n > cap else [0, n]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == want
        seqs = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
        for s in seqs.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
            assert sum(n for _, n in s) <= cap
        total = sum(r["length"] for r in got)
        assert len(seqs) <= -(-total // cap) * 1.1 + 1


def test_empty(spark, docs):
    assert P.pack(docs.limit(0), path).count() == 0
