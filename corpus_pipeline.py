"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup, substring dedup, best-fit packing.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared folder and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.

Defined cases: null, empty and letterless texts are rejected by language ID; rows that repeat a
doc_id count as one document from the near-dedup on (the row with the smallest text hash stays);
a text that repeats earlier ones throughout ends up empty and is packed as its end token; further
columns are kept by the first three stages; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddyframe.llm import chunks, langid, packing
from paddyframe.llm.chunk_dedup import without_repeats
from paddyframe.llm.queries import BYTE_BPE
from paddyframe.llm.simhash import near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go."""
    model = langid.train(docs.filter(~langid.held_out()))
    told = langid.identify(docs, model).groupBy("doc_id").agg(F.min(F.col("rejected").cast("int")).alias("r"))
    gone = chunks.materialize(told.filter("r = 1").select("doc_id"), "rejected")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    told = near_duplicates(docs).groupBy("doc_id").agg(
        F.min(F.col("doc_id") != F.col("component_id")).alias("copy"), F.count(F.lit(1)).alias("n"))
    told = chunks.materialize(told.filter("copy or n > 1"), "copies")  # few rows beside the texts
    gone, twice = told.filter("copy").select("doc_id"), told.filter("not copy").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = kept.join(twice, "doc_id", "left_semi").select(docs.columns).withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; the rest of every document stays."""
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences."""
    return packing.pack(docs, BYTE_BPE)


#: (name, function): the operators 1, 10, 8 and 6 in this order.
STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A character model, XXH64 fingerprints and a tokenizer are beyond SQL; tests/llm/test_pipeline.py
#: checks every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = chunks.materialize(stage(spark, docs, sf_dir), name)
    return chunks.materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
