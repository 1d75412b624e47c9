import random

import numpy as np
import pytest

from paddyframe.llm import pieces as P

spm = pytest.importorskip("sentencepiece")
path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def as_unigram(buf):
    """The model file with its algorithm set to Unigram, for the library (trainer_spec.model_type = 1)."""
    out, at = bytearray(buf), 0

    def varint(i):
        v = s = 0
        while True:
            v |= (buf[i] & 127) << s
            s, i = s + 7, i + 1
            if buf[i - 1] < 128:
                return v, i
    while at < len(buf):
        tag, at = varint(at)
        size, at = varint(at)
        if tag >> 3 == 2:
            i = at
            while i < at + size:
                t, i = varint(i)
                if t & 7 == 0:
                    if t >> 3 == 3:
                        out[i] = 1
                        return bytes(out)
                    _, i = varint(i)
                else:
                    n, i = varint(i) if t & 7 == 2 else ({1: 8, 5: 4}[t & 7], i)
                    i += n
        at += size
    raise AssertionError


@pytest.fixture(scope="module")
def model():
    return P.PieceModel.load(path)


@pytest.fixture(scope="module")
def library():
    with open(path, "rb") as f:
        return spm.SentencePieceProcessor(model_proto=as_unigram(f.read()))


TEXTS = ["Hello world", " two  spaces ", "tab\tand\nnewline", "naïve Übergröße", "日本語 テキスト", "emoji 🙂🙃 x", "a", " ", "   ", "",
         "1234567 89", "x" * 60, "don't!!", "▁ marked", "mixed🙂word ünd ͸", "end  "]


def test_best_path_of_the_library_lattice(model, library):
    """The library's n-best search finds no better path, and the same score where its 32-bit sums are exact."""
    random.seed(1)
    bits = ["the", "ing", " ", "  ", "é", "日", "Qz", "0", "tion", "-", "er", "W"]
    texts = [t for t in TEXTS if t] + ["".join(random.choice(bits) for _ in range(random.randint(1, 12))) for _ in range(600)]
    texts += [t + "🙂͸" for t in texts[:50]]
    s = model.surfaces()
    for t, (ids, score, n_bytes) in zip(texts, model.encode(texts)):
        got, want = np.frombuffer(ids, "<u4").tolist(), library.nbest_encode(t, nbest_size=4)[0]
        assert model.decode(got, s) == library.decode(got) == t.replace("▁", " "), t
        assert n_bytes == sum(library.is_byte(i) for i in got)
        if score > -1e6 and not n_bytes:
            assert score == sum(model.scores[got]) == sum(model.scores[want]), t


def test_viterbi_against_all_segmentations():
    rng = random.Random(2)
    vocab = [P.MARK, "a", "b", "ab", "ba", "aab", P.MARK + "a", P.MARK + "ab", "bbb", "abab"]
    m = P.PieceModel(["<unk>"] + vocab, np.array([0.0] + [-rng.uniform(1, 6) for _ in vocab]),
                     np.array([P.UNKNOWN] + [P.NORMAL] * len(vocab)), True, False)
    score = dict(zip(vocab, m.scores[1:]))

    def best(t):
        if not t:
            return 0.0
        out = [score[t[:n]] + best(t[n:]) for n in range(1, 6) if t[:n] in score]
        if t[:1] not in score:
            out.append(m.unknown_score + best(t[1:]))
        return max(out)

    for _ in range(300):
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9)))
        (ids, s, _), = m.encode([t])
        assert abs(s - best(m.normalize(t))) < 1e-9
        if "c" in t:
            assert 0 in np.frombuffer(ids, "<u4")


def test_double_array_holds_all_and_only_its_keys(model):
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"abcd\xff\x00") for _ in range(rng.randint(1, 6))) for _ in range(3000)})
    t = P.DoubleArray(keys)

    def find(k):
        s = 0
        for b in k:
            c = int(t.base[s]) + b + 1
            if t.check[c] != s:
                return -1
            s = c
        return int(t.value[s])
    assert [find(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.choice(b"abcd\xff\x00") for _ in range(rng.randint(1, 7))) for _ in range(2000)} - set(keys)
    assert all(find(k) == -1 for k in others)


def test_queries_round_trip(spark, docs):
    rows = {}
    for r in docs.select("doc_id", "text").collect():
        rows.setdefault(r.doc_id, r.text or "")
    got = P.decode(P.encode(docs, path), path).collect()
    assert len(got) == docs.count() and all(r.text == rows[r.doc_id] for r in got)
    assert {r.doc_id: len(r.ids) for r in got}[1] == 0
    assert P.decode(P.encode(docs.limit(0), path), path).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [5, 300])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in P.decode(odd, path).collect()}[1] == ""


def test_bounded_memo_and_parts_change_no_encoding(monkeypatch):
    """Words forgotten, met again, too long to keep or cut into parts give what a fresh model gives each text."""
    rng = random.Random(4)
    bits = ["the", "ing", "é", "日", "Q" * 40, "🙂͸", " ", "  ", "▁", "\n", "0", "\0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    vocab = [P.MARK, "t", "h", "e", "the", P.MARK + "the", "in", "g", "ing", "0", "Q", "QQQ", "é"]
    size = len(vocab)
    for n_bytes in (0, 256):
        def build():
            return P.PieceModel(["<unk>", *vocab, *(f"<0x{c:02X}>" for c in range(n_bytes))],
                                np.array([0.0] + [-1.0 - i / 7 for i in range(size)] + [0.0] * n_bytes),
                                np.array([P.UNKNOWN] + [P.NORMAL] * size + [P.BYTE] * n_bytes), True, False)
        want = [build().encode([t])[0] for t in texts]
        with monkeypatch.context() as small:
            for name, value in (("MEMO_WORDS", 40), ("MEMO_IDS", 400), ("TEXT_BATCH", 60), ("WORD_BATCH", 25)):
                small.setattr(P, name, value)
            m = build()
            for i in range(0, len(texts), 25):
                assert m.encode(texts[i:i + 25]) == want[i:i + 25]
                assert m.encode(texts[i:i + 25][::-1]) == want[i:i + 25][::-1]
            m._forget()
            assert len(m.memo) == m.memo.n <= 20 and m.n_flat <= 200 and all(len(w) <= P.MEMO_CHARS for w in m.memo)
            assert m.encode([]) == [] and m.encode(["", "the"])[0] == (b"", 0, 0)
