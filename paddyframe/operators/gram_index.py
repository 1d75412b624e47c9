"""Inverted index of character grams for exact substring search (survey 2.J: J2, J3, C9).

Every text is taken apart into its distinct grams of 1 to ``GRAM_MAX`` characters.  Three tables lie in the shared folder:

    nodes      the indexed rows with ``_ref``, a 64-bit name of the row
    postings   (gram, part, ids): the sorted names of the rows of one part whose text holds the gram, by ranges of (gram, part)
    grams      (gram, n): in how many rows each gram stands

Rows are dealt to parts of about ``PART_NODES`` by their name, and all lists are cut alike; so a gram that a third of all
rows hold is many lists of bounded length, and two grams' lists meet part by part.

A search takes the two rarest grams of each different list of words, intersects their lists and tests what is left
against the texts.  Whatever holds the words holds both grams, and two rows of one name are tested each by its own
text, so the result equals comparing every list with every text.

An index belongs to the rows it was built from: ``of`` names it by their digest, so a second search of the application
over the same rows finds it and changed rows get another one.  It counts only once its commit row is written.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import registry

GRAM_MAX = 4
PART_NODES = 4096


@dataclass
class GramIndex:
    nodes: DataFrame
    postings: DataFrame
    grams: DataFrame
    text_col: str


def text_grams(text: Column, longest: int = GRAM_MAX) -> Column:
    """Distinct substrings of 1 to ``longest`` characters of ``text``."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    g = F.flatten(F.transform(at, lambda i: F.array(*[F.substring(text, i, k) for k in range(1, longest + 1)])))
    return F.array_distinct(F.filter(g, lambda s: s != ""))


def word_grams(word: Column, longest: int = GRAM_MAX) -> Column:
    """All substrings of a word that are as long as a gram can be: a text that holds the word holds each of them."""
    q = F.least(F.length(word), F.lit(longest))
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - q + 1, F.lit(1)))
    return F.transform(at, lambda i: F.substring(word, i, q))


def build(nodes: DataFrame, text_col: str, folder: str) -> None:
    """Write the three tables of the index of ``nodes`` into ``folder``.  Rows without a text are not indexed."""
    nodes.filter(F.col(text_col).isNotNull()).withColumn("_ref", F.xxhash64(*nodes.columns)).write.parquet(f"{folder}/nodes")
    rows = nodes.sparkSession.read.parquet(f"{folder}/nodes")
    part = F.pmod(F.col("_ref"), F.lit(rows.count() // PART_NODES + 1)).cast("int")
    lists = (rows.select("_ref", part.alias("part"), F.explode(text_grams(F.col(text_col))).alias("gram"))
             .groupBy("gram", "part").agg(F.sort_array(F.collect_set("_ref")).alias("ids")))
    lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.parquet(f"{folder}/postings")
    sizes = nodes.sparkSession.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")


def of(nodes: DataFrame, text_col: str) -> GramIndex:
    """The index of ``nodes``: the one that this application has built of the same rows, else a new one."""
    spark = nodes.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/gram-index-{spark.sparkContext.applicationId}"
    row = F.xxhash64(*nodes.columns)
    told = nodes.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    name = "-".join(str(x) for x in (text_col, *nodes.columns, *told))
    done = registry.commits(spark, root).filter(F.col("model_type") == name).agg(F.min("version")).first()[0]
    if done is None:
        done = registry.new_version()
        build(nodes, text_col, registry.folder(root, name, done))
        registry.commit(spark, root, name, done, datetime.datetime.now().isoformat())
    at = registry.folder(root, name, done)
    return GramIndex(*(spark.read.parquet(f"{at}/{t}") for t in ("nodes", "postings", "grams")), text_col)


def candidates(wanted: DataFrame, words_col: str, index: GramIndex) -> DataFrame:
    """(words_col, _ref): the rows that hold the two rarest grams of each different list of words."""
    each = wanted.select(words_col).distinct()
    keys = each.select(words_col, F.explode(F.array_distinct(F.flatten(F.transform(words_col, lambda w: word_grams(w))))).alias("gram"))
    first = Window.partitionBy(words_col).orderBy("n", "gram")
    rare = (keys.join(index.grams, "gram", "left").select(words_col, "gram", F.coalesce("n", F.lit(0)).alias("n"))
            .withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2")
            .groupBy(words_col).agg(F.min(F.struct("n", "gram")).alias("a"), F.max(F.struct("n", "gram")).alias("b"))
            .filter("a.n > 0")          # a gram that stands nowhere: no row holds the words
            .select(words_col, F.col("a.gram").alias("g1"), F.when(F.col("a.gram") != F.col("b.gram"), F.col("b.gram")).alias("g2")))
    lists = lambda n: index.postings.toDF(f"g{n}", "part", f"ids{n}")
    both = rare.join(lists(1), "g1").join(lists(2), ["g2", "part"], "left")
    ids = F.when(F.col("g2").isNull(), F.col("ids1")).otherwise(F.array_intersect("ids1", "ids2"))
    return both.select(words_col, F.explode(ids).alias("_ref"))


def containing(wanted: DataFrame, words_col: str, index: GramIndex) -> DataFrame:
    """``words_col`` and the indexed columns: each different list of words with every row whose text holds all of them.
    A list without words finds nothing."""
    met = candidates(wanted, words_col, index).join(index.nodes, "_ref").drop("_ref")
    return met.filter(F.forall(words_col, lambda w: F.instr(F.col(index.text_col), w) > 0))
