"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character model of order 5 over lower-cased words (runs of
letters between white space marks), smoothed by interpolated Kneser-Ney: raw
counts at the highest order and for n-grams at a word's start, continuation
counts below.  All languages share one sorted array of n-gram hashes per order;
beside it lie the interpolated log-probability and the back-off weight under
every language, so one search serves them all.  The language with the lowest
cross-entropy per character wins.  The score is the winner's share of
exp(-temperature * cross-entropy); temperature and the limit above which a text
counts as no learned language are fitted on sample documents kept out of the
counts.

Models are fitted on a bounded sample: per language at most ``sample_docs``
documents of at most ``SAMPLE_CHARS`` characters, the ones with the smallest
id hashes.  Prediction reads all documents, whole.

Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected; with no labelled document everything is ``und``; ties go to the
first language in alphabetical order; repeated rows get equal results; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks as C

ORDER = 5
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
CALIBRATION_SHARE = 5       # every fifth sample document calibrates
UNDETERMINED = "und"
MEMO_WORDS = 1 << 18
MEMO_CHARS = 32
SCORE_WORDS = 1 << 13       # words scored at once: bounds a worker's memory on long texts
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points ending at each position (the first n - 1 positions are meaningless)."""
    h = np.full(len(codes), n, np.uint64)
    for j in range(n - 1, -1, -1):
        back = codes if j == 0 else np.concatenate([np.zeros(j, np.uint64), codes[:-j]])[:len(codes)]
        h = (h ^ (back + np.uint64(1))) * _MULT
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Sorted hash arrays per order, with a column per language."""

    langs: list[str]
    keys: list[np.ndarray]      # [order - 1] -> sorted uint64
    logp: list[np.ndarray]      # [order - 1] -> float32 (n, languages)
    logb: list[np.ndarray]      # back-off weight of the n-gram as a context
    floor: float                # log-probability of any symbol under the uniform base
    base: np.ndarray            # log-probability of an unknown symbol without context, per language
    temperature: float = 1.0
    usual: np.ndarray | None = None     # cross-entropy that long texts of a language stay below
    spread: np.ndarray | None = None    # median squared deviation times length: what short texts may add

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (its letters and its end) under every language."""
        codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
        start = np.cumsum(lens) - lens
        pos = np.arange(len(codes)) - np.repeat(start, lens)  # position inside the padded word
        lp = np.tile(self.base.astype(np.float32), (len(codes), 1))
        before = np.full(len(codes), -1)
        for n in range(1, ORDER + 1):
            keys = self.keys[n - 1]
            at = np.flatnonzero(pos >= n - 1)
            idx = np.full(len(codes), -1)
            if len(keys) and len(at):
                h = _gram_hashes(codes, n)[at]
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                idx[at] = np.where(keys[i] == h, i, -1)
            hit = (idx >= 0) & (pos >= 1)
            if n > 1:
                context = np.concatenate([[-1], before[:-1]])
                miss = (idx < 0) & (pos >= n - 1) & (context >= 0)
                lp[miss] += self.logb[n - 2][context[miss]]
            lp[hit] = self.logp[n - 1][idx[hit]]
            before = idx
        lp[pos == 0] = 0
        return np.add.reduceat(lp, start, axis=0).astype(np.float64)


def fit(counts: pd.DataFrame, langs: list[str]) -> Model:
    """Kneser-Ney models from (lang, gram, c): raw counts of the n-grams of padded words, all orders."""
    tables: list[dict[str, list]] = []
    symbols = {g for g in counts.gram if len(g) == 1}
    floor = -np.log(len(symbols) + 1)
    for lang in langs:
        own = counts[counts.lang == lang]
        raw: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        for g, c in zip(own.gram, own.c):
            raw[len(g)][g] = float(c)
        cont: list[dict[str, float]] = [{}, *({} for _ in range(ORDER))]
        for n in range(2, ORDER + 1):
            for g in raw[n]:
                cont[n - 1][g[1:]] = cont[n - 1].get(g[1:], 0) + 1
        used = [{}] + [{g: c if n == ORDER or (g[0] == " " and n > 1) else cont[n].get(g, 0.0) for g, c in raw[n].items()
                        if not (n == 1 and g == " " and not cont[1].get(" "))} for n in range(1, ORDER + 1)]
        prob: list[dict[str, float]] = [{}]
        lam: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            seen = list(used[n].values())
            ones, twos = seen.count(1.0), seen.count(2.0)
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, float] = defaultdict(float)
            types: dict[str, int] = defaultdict(int)
            for g, c in used[n].items():
                if c > 0:
                    total[g[:-1]] += c
                    types[g[:-1]] += 1
            lam[n - 1] = {h: d * types[h] / total[h] for h in total}
            below = np.exp(floor)
            p = {}
            for g, c in used[n].items():
                h = g[:-1]
                if h not in total:
                    continue
                p[g] = max(c - d, 0) / total[h] + lam[n - 1][h] * (prob[n - 1].get(g[1:], below) if n > 1 else below)
            prob.append(p)
        tables.append({"prob": prob, "lam": lam})

    def backed_off(t: dict, g: str) -> float:
        weight = 1.0
        while g:
            if g in t["prob"][len(g)]:
                return weight * t["prob"][len(g)][g]
            weight *= t["lam"][len(g) - 1].get(g[:-1], 1.0)
            g = g[1:]
        return weight * float(np.exp(floor))

    keys, logp, logb = [], [], []
    for n in range(1, ORDER + 1):
        grams = sorted(set().union(*(t["prob"][n] for t in tables), *(t["lam"][n] for t in tables)))
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = _gram_hashes(codes, n)[n - 1::n] if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        keys.append(h[order])
        logp.append(np.log(np.array([[backed_off(t, g) for t in tables] for g in grams], np.float64)
                           .reshape(len(grams), len(langs)))[order].astype(np.float32))
        logb.append(np.log(np.array([[t["lam"][n].get(g, 1.0) for t in tables] for g in grams], np.float64)
                           .reshape(len(grams), len(langs)))[order].astype(np.float32))
    base = floor + np.log([t["lam"][0].get("", 1.0) for t in tables])
    return Model(langs, keys, logp, logb, float(floor), np.asarray(base, np.float64))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, c) for all n-grams of the padded words of (lang, word, c)."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    size = F.length(padded)

    def cut(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.when(size >= n, F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(cut, range(1, ORDER + 1))))
    return words.select("lang", "c", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def sample(docs: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents per language: those with the smallest id hashes."""
    fit_for = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    slim = fit_for.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    have = {r["lang"]: r["n"] for r in slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    share = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, 1.2 * limit / n + 30 / n))]) if have else None
    if share is None:
        return slim.limit(0).withColumn("n", F.lit(0))
    # keep hashes below the share first, so that few rows reach the exact cut
    low = (F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return slim.filter(low).withColumn("n", rank).filter(F.col("n") <= limit)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on (doc_id, text, lang) rows; the driver gets counts of a bounded sample."""
    part = C.materialize(sample(docs, sample_docs), "language-sample")
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    words = (part.filter(F.col("n") % CALIBRATION_SHARE != 0).select("lang", F.explode(letters).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")))
    counts = gram_counts(words).toPandas()
    langs = sorted(counts.lang.unique().tolist())
    model = fit(counts, langs)
    if not langs:
        return model
    held = part.filter(F.col("n") % CALIBRATION_SHARE == 0).select("lang", "text")
    scored = _scored(held, model, "lang string", ["lang"]).toPandas()
    scored = scored[scored.n_symbols > 0]
    ce = np.stack(scored.entropy.to_numpy()) if len(scored) else np.zeros((0, len(langs)))
    true = np.array([langs.index(x) if x in langs else -1 for x in scored.lang], np.int64)
    ce, true, n = ce[true >= 0], true[true >= 0], scored.n_symbols.to_numpy()[true >= 0]
    at = ce[np.arange(len(true)), true]
    none = -model.floor
    per = [at[true == i] for i in range(len(langs))]
    model.usual = np.array([max(1.5 * x.mean(), 1.1 * np.quantile(x, 0.99)) if len(x) else none for x in per])
    model.spread = np.array([np.median((x - np.median(x)) ** 2 * n[true == i]) if len(x) else 1.0 for i, x in enumerate(per)])
    best = None
    for t in 2.0 ** np.arange(0, 9):
        x = -t * ce
        loss = (np.logaddexp.reduce(x, axis=1) - x[np.arange(len(true)), true]).mean() if len(true) else 0.0
        # a wrong label must not force the temperature up: losses are averaged, the flattest best one wins
        if best is None or loss < best - 1e-4:
            best, model.temperature = loss, float(t)
    return model


def _scored(docs: DataFrame, model: Model, key_schema: str, keys: list[str]) -> DataFrame:
    """Per row: the keys, number of symbols scored and cross-entropy under every language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    memo: dict[str, int] = {}
    rows: list[np.ndarray] = []

    def run(batches):
        C.let_go()
        model = shared.value
        known = np.zeros((0, len(model.langs)))
        for pdf in batches:
            texts = [words_of(t) for t in pdf.text]
            flat = [w for ws in texts for w in ws]
            if len(memo) > MEMO_WORDS:
                memo.clear()
                rows.clear()
                known = np.zeros((0, len(model.langs)))
            fresh = [w for w in dict.fromkeys(flat) if w not in memo]
            short = [w for w in fresh if len(w) <= MEMO_CHARS]
            size = sum(map(len, rows))
            if short:
                rows.extend(model.score_words(short[a:a + SCORE_WORDS]) for a in range(0, len(short), SCORE_WORDS))
                memo.update(zip(short, range(size, size + len(short))))
                size += len(short)
            if len(known) != size:
                known = np.concatenate(rows) if rows else known
                rows[:] = [known]
            long = [w for w in fresh if len(w) > MEMO_CHARS]
            table, beside = known, {}
            if long:
                table = np.concatenate([known, *[model.score_words([w]) for w in long]])
                beside = dict(zip(long, range(size, size + len(long))))
            at = (memo[w] if w in memo else beside[w] for w in flat) if long else map(memo.__getitem__, flat)
            idx = np.fromiter(at, np.int64, len(flat))
            ends = np.cumsum([len(ws) for ws in texts])
            n = np.array([sum(map(len, ws)) + len(ws) for ws in texts])
            total = np.zeros((len(texts), len(model.langs)))
            has = [i for i, ws in enumerate(texts) if ws]
            if has:
                total[has] = np.add.reduceat(table[idx], [ends[i] - len(texts[i]) for i in has], axis=0)
            ce = -total / np.maximum(n, 1)[:, None]
            yield pdf[keys].assign(n_symbols=n, entropy=list(ce))

    C.small_batches(docs.sparkSession)
    return docs.mapInPandas(run, f"{key_schema}, n_symbols long, entropy array<double>")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every document, from its text alone."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not model.langs:
        return slim.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    scored = _scored(slim, model, "doc_id long", ["doc_id"])
    best: Column = F.array_min("entropy")
    i = F.array_position("entropy", best)
    share = F.lit(1.0) / F.aggregate("entropy", F.lit(0.0), lambda a, x: a + F.exp(F.lit(model.temperature) * (best - x)))
    pick = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), i.cast("int"))
    limit = pick(model.usual.tolist(), "double") + 12 * F.sqrt(pick(model.spread.tolist(), "double") / F.greatest("n_symbols", F.lit(1)))
    some = F.col("n_symbols") > 0
    return scored.select("doc_id", F.when(some, pick(model.langs, "string")).otherwise(UNDETERMINED).alias("lang_pred"),
                         F.when(some, share).otherwise(0.0).alias("score"), F.when(some, best).alias("entropy"),
                         F.when(some, best > limit).otherwise(True).alias("rejected"))


def held_out(parts: int = 3, part: int = 1, key: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves ``part``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == part
