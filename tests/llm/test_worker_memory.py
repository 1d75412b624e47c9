"""What a Python worker, which Spark uses for one operator after another, keeps of each."""

import random
import tracemalloc
import weakref
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from paddyframe.llm import chunks, langid, packing, simhash


def task(operator, *args):
    """The function that ``operator`` runs in its tasks."""
    context = SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: "256")))
    docs.select = lambda *columns: docs
    docs.mapInPandas = lambda run, schema: run
    return operator(docs, *args)


def model():
    gram = ["e", " ", "t", "h", "th", "he"]
    return langid.fit(pd.DataFrame({"lang": ["a"] * 6 + ["b"] * 6, "gram": gram * 2, "c": range(1, 13)}), ["a", "b"])


def test_an_operator_drops_what_another_kept(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    pdf = pd.DataFrame({"doc_id": [1], "text": ["the other"]})
    for run in (lambda: list(task(langid._scored, model(), "doc_id long", ["doc_id"])([pdf])),
                lambda: list(task(simhash.fingerprints)([pdf])),
                lambda: list(chunks._blocks(iter([]), 1))):
        encoder = packing._encoder(path)
        assert packing._encoder(path) is encoder        # the next task of the same stage goes on with it
        gone = weakref.ref(encoder)
        del encoder
        run()
        assert gone() is None


def test_scoring_a_long_text_takes_little_memory(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(100_000)] + ["q" * 40, "the"]
    pdf = pd.DataFrame({"doc_id": [1, 2], "text": [" ".join(words), "the the"]})
    known, run = model(), task(langid._scored, model(), "doc_id long", ["doc_id"])
    tracemalloc.start()
    out = list(run([pdf]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = [known.score_words([w])[0] for w in words[-2:]]
    whole = known.score_words(words[:-2]).sum(axis=0) + one[0] + one[1]
    n = [sum(map(len, words)) + len(words), 8]
    assert np.allclose(np.stack(out.entropy), [-whole / n[0], -2 * one[1] / n[1]]) and out.n_symbols.tolist() == n
    assert peak < 60e6, peak
