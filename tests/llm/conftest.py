import numpy as np
import pytest


@pytest.fixture()
def docs(spark):
    """Small documents table: nulls, empties, blanks, repeated rows, copies, a long text, clashing extra columns."""
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "naïve", "omega", "pi", "rho", "sigma", "tau", "日本", "x"]
    say = lambda n: " ".join(f"{words[rng.integers(len(words))]}{rng.integers(900)}" for _ in range(n))
    passage = say(70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, say(200)), (6, say(40) + " " + passage + " " + say(30)),
            (7, passage + " " + say(25)), (8, say(60) + "\n" + passage), (9, "a" * 5000), (10, "a" * 4000 + "b"),
            (11, say(3000))]
    rows += [(12, rows[4][1]), (13, rows[4][1] + " z"), (5, rows[4][1]), (14, "THE Quick brown"), (15, "the quick  brown")]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "k") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, block long, "
                                 "fp int, component_id string")
