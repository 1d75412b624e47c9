import numpy as np
import pandas as pd

from paddyframe.llm import langid as L


def counts_of(words):
    rows = {}
    for lang, w in words:
        p = f" {w} "
        for n in range(1, L.ORDER + 1):
            for i in range(len(p) - n + 1):
                rows[lang, p[i:i + n]] = rows.get((lang, p[i:i + n]), 0) + 1
    return pd.DataFrame([(a, g, c) for (a, g), c in rows.items()], columns=["lang", "gram", "c"])


WORDS = [("a", w) for w in "the then them other mother another bath bathe the the of off often".split()] + \
        [("b", w) for w in "und unter hund bunt rund stund gesund der die das dem der".split()]


def test_distributions_sum_to_one():
    model = L.fit(counts_of(WORDS), ["a", "b"])
    alphabet = sorted({c for _, w in WORDS for c in w})
    for history in ("", "t", "th", "the", "othe", "xq", "unte"):
        # P(history + next symbol) summed over the next symbol, by the difference of word scores
        whole = np.zeros(2)
        for c in alphabet + ["一"]:
            word = history + c
            padded = model.score_words([word])[0] - end_of(model, word)
            whole += np.exp(padded - prefix(model, history))
        whole += np.exp(end_of(model, history)) if history else np.exp(end_of(model, ""))
        assert np.allclose(whole, 1, atol=2e-4), (history, whole)


def prefix(model, word):
    return model.score_words([word])[0] - end_of(model, word) if word else np.zeros(2)


def end_of(model, word):
    """Log-probability of the end after the word, by plain back-off over strings."""
    padded = f" {word} "
    out = []
    for lang in range(2):
        lp = model.base[lang]
        for n in range(1, min(L.ORDER, len(padded)) + 1):
            if n == len(padded) and len(padded) > L.ORDER:
                break
            g, h = padded[-n:], padded[-n:-1]
            i = find(model, g)
            if i is not None:
                lp = model.logp[n - 1][i][lang]
            elif n > 1 and (j := find(model, h)) is not None:
                lp = lp + model.logb[n - 2][j][lang]
        out.append(lp)
    return np.array(out, dtype=float)


def find(model, g):
    codes = np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64)
    k = L._gram_hashes(codes, len(g))[-1]
    i = int(np.searchsorted(model.keys[len(g) - 1], k))
    return i if i < len(model.keys[len(g) - 1]) and model.keys[len(g) - 1][i] == k else None


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.filter(~L.held_out()))
    got = docs.select("doc_id", "lang").join(L.identify(docs, model), "doc_id").filter(L.held_out()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    rng = np.random.default_rng(1)
    junk = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 8)) for _ in range(60))
    odd = spark.createDataFrame([(1, junk, 5), (2, None, 5), (3, "123 __ !?", 5), (4, "", 5), (5, "the " * 9000, 5)],
                                "doc_id long, text string, entropy int")
    rows = {r.doc_id: r for r in L.identify(odd, model).collect()}
    assert rows[1].rejected and rows[1].lang_pred in model.langs
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0 for i in (2, 3, 4))
    assert rows[5].lang_pred == "en" and not rows[5].rejected


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = L.train(df)
    assert [r.lang_pred for r in L.identify(df, model).collect()] == ["und"]
    assert L.identify(df.limit(0), model).count() == 0
