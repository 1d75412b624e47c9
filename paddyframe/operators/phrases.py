"""Large phrase lists against whole texts (survey 2.K, K2/K3): one automaton, one pass per text.

The distinct lower-cased phrases become an Aho-Corasick automaton, which finds every phrase of any length while
it reads a text once, in time linear in the text and the hits.  A list of up to AUTOMATON_CHARS characters
(its size is measured first) is one automaton, built once and broadcast; texts are scanned where they
are, in Arrow batches, and nothing but hits is shuffled.  A longer list is dealt by hash into parts of about that
size; every part meets the texts, block by block, in tasks that hold one part's automaton and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTOMATON_CHARS = 1 << 20       # characters of phrases in one automaton: at most 32 bytes each
BLOCK_CHARS = 32 << 20          # characters of texts that meet one part in a task


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds the (non-empty) phrases; every hit's value is the phrase."""
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def found(a: ahocorasick.Automaton, text: str | None) -> set[str]:
    """The automaton's phrases that the text holds, overlapping ones too."""
    return {p for _, p in a.iter(text)} if text and len(a) else set()


def phrase_hits(texts: DataFrame, key: str, text_col: str, phrases: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """(key, phrase) for every phrase that a text holds, ignoring case, once each.

    Null and empty texts and phrases hit nothing; phrases are told in lower case; rows that share a key are told together.
    """
    ph = phrases.select(F.lower(F.col(phrase_col).cast("string")).alias("p")).filter(F.length("p") > 0).distinct()
    low = texts.select(F.col(key).alias("k"), F.lower(F.col(text_col).cast("string")).alias("t")).filter(F.length("t") > 0)
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField(phrase_col, T.StringType())])
    chars = ph.agg(F.sum(F.length("p"))).first()[0] or 0
    if chars <= AUTOMATON_CHARS:
        hits = _with_broadcast(low, ph, schema)
    else:
        hits = _in_parts(low, ph, -(-chars // AUTOMATON_CHARS), schema)
    return hits.distinct()


def _with_broadcast(low: DataFrame, ph: DataFrame, schema: T.StructType) -> DataFrame:
    """Every text by the one automaton; the list's size has been checked."""
    spark = low.sparkSession
    one = spark.sparkContext.broadcast(automaton([r.p for r in ph.collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, told = [], []
            for i, t in enumerate(b.column(1)):
                for p in found(one.value, t.as_py()):
                    at.append(i)
                    told.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(told, pa.string())], names=schema.names)

    return low.mapInArrow(scan, schema)


def _in_parts(low: DataFrame, ph: DataFrame, parts: int, schema: T.StructType) -> DataFrame:
    """Every block of texts by every part of the list."""
    total = low.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    key, phrase = schema.names
    dealt = low.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lists = ph.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        a = automaton(right.column("p").to_pylist())
        at, told = [], []
        for i, t in enumerate(left.column("t")):
            for p in found(a, t.as_py()):
                at.append(i)
                told.append(p)
        return pa.table({key: left.column("k").take(pa.array(at, pa.int64())), phrase: pa.array(told, pa.string())})

    by = ["part", "block"]
    return dealt.groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(scan, schema)
