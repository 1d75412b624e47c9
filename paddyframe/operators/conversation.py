"""Conversation tables (survey 2.L, L1-L5, L13).

Input: ``(conv_id, turn, role, text)`` plus optional tool-call columns.
Windows partition by conversation.  Top-n style outputs use
``row_number() <= n`` (a partial group limit runs before the shuffle, so a
very long conversation ships n rows per task); running counts and
last-value carries for gaps-and-islands use the distributed prefix scan of
``order_stats``, so one conversation never has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import block_of, prefix_scan

RECENT_TURNS = 4          # history turns given to the classifier / extractor
MEMORY_WINDOW = 10        # turns kept verbatim; older ones are summarised


def eligible(role_col: str = "role", text_col: str = "text", calls_col: str | None = None):
    """User turns, or assistant turns with text and no pending tool call."""
    ok_assistant = (F.col(role_col) == "assistant") & F.coalesce(F.length(F.col(text_col)) > 0, F.lit(False))
    if calls_col:
        ok_assistant = ok_assistant & (F.coalesce(F.size(F.col(calls_col)), F.lit(0)) <= 0)
    return (F.col(role_col) == "user") | ok_assistant


def last_n_turns(conv: DataFrame, n: int = RECENT_TURNS, key: str = "conv_id", order: str = "turn",
                 calls_col: str | None = None) -> DataFrame:
    """Last n eligible turns per conversation (L1)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (conv.filter(eligible(calls_col=calls_col)).withColumn("recency", F.row_number().over(w))
            .filter(F.col("recency") <= n))


def window_split(conv: DataFrame, keep: int = MEMORY_WINDOW, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Label the latest ``keep`` turns 'recent' and the rest 'older' (L2).

    The recent set comes from a top-n (partial group limit), then a join labels
    every row; no window sorts a whole conversation.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    recent = conv.select(key, order).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep) \
        .select(key, order, F.lit(True).alias("_recent"))
    return (conv.join(recent, [key, order], "left")
            .withColumn("bucket", F.when(F.col("_recent"), "recent").otherwise("older")).drop("_recent"))


def latest_tool_block(conv: DataFrame, is_call, is_result, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Results of the latest contiguous tool-result block (L3).

    Walking backwards, results are collected until a call turn is met after at
    least one result.  Equivalently: number each result by the count of call
    turns *after* it (island id); keep results of the smallest island id that
    has any result.  The count is a distributed prefix scan in descending turn
    order, so a very long conversation is split over many tasks.
    """
    d = conv.withColumn("_is_call", is_call.cast("int")).withColumn("_is_res", is_result) \
        .withColumn("_rev", -F.col(order))
    d = prefix_scan(d, [key], "_rev", "_is_call", "sum", "_calls_incl")
    d = d.withColumn("_island", F.col("_calls_incl") - F.col("_is_call"))
    res = d.filter("_is_res")
    first = res.groupBy(key).agg(F.min("_island").alias("_island"))
    return res.join(first, [key, "_island"], "inner").drop("_is_call", "_is_res", "_island", "_rev", "_calls_incl")


def resolved_calls(calls: DataFrame, results: DataFrame, key: str = "conv_id", ids_col: str = "call_ids",
                   result_id_col: str = "call_id") -> DataFrame:
    """Keep call turns whose call ids are all answered by a result in the same conversation (L4).

    Ids are exploded and anti-joined against the results (no per-conversation collect).
    """
    ex = calls.select("*", F.explode_outer(ids_col).alias("_id"))
    res = results.select(key, F.col(result_id_col).alias("_id")).distinct()
    missing = ex.filter(F.col("_id").isNotNull()).join(res, [key, "_id"], "left_anti") \
        .select(key, "turn").distinct()
    return calls.join(missing, [key, "turn"], "left_anti")


def slot_carry(events: DataFrame, allowed: dict, key: str = "conv_id", order: str = "turn",
               action_col: str = "action", slot_col: str = "slot", value_col: str = "value",
               confident_col: str = "confident") -> DataFrame:
    """Slot carry-forward with reset (L5), long form: one row per (turn, slot) proposal.

    A slot value survives only while every turn's action allows that slot; a
    newer non-empty value overrides; empty values never override; low-confidence
    turns change nothing.  Output: state per (conversation, turn, slot).

    ``events``: (conv, turn, action, confident, slot, value) with one row per slot
    in the vocabulary for every turn (value NULL/empty when not proposed).
    """
    amap = F.create_map(*[x for a, slots in allowed.items()
                          for x in (F.lit(a), F.array(*[F.lit(s) for s in slots]))])
    allows = F.coalesce(F.array_contains(F.element_at(amap, F.col(action_col)), F.col(slot_col)), F.lit(False))
    conf = F.coalesce(F.col(confident_col), F.lit(False))
    d = events.withColumn("_reset", (conf & ~allows).cast("int")) \
        .withColumn("_val", F.when(conf & allows & (F.coalesce(F.length(value_col), F.lit(0)) > 0), F.col(value_col)))
    # island id = running count of resets; state = value at the latest turn with a value
    # in the same island up to this turn.  Both are distributed prefix scans, then an
    # equi-join fetches the value, so no conversation is processed by a single task.
    block = block_of(events, order)
    d = prefix_scan(d, [key, slot_col], order, "_reset", "sum", "_island", block=block)
    d = d.withColumn("_vt", F.when(F.col("_val").isNotNull(), F.col(order)))
    d = prefix_scan(d, [key, slot_col, "_island"], order, "_vt", "max", "_src", block=block)
    vals = d.filter(F.col("_val").isNotNull()).select(key, slot_col, F.col(order).alias("_src"),
                                                      F.col("_val").alias("state"))
    return d.join(vals, [key, slot_col, "_src"], "left").select(key, order, slot_col, "state")


def transcript(conv: DataFrame, key: str = "conv_id", order: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``User:`` / ``Assistant:`` lines in turn order, tool and system turns skipped."""
    line = F.concat(F.when(F.col(role_col) == "user", "User: ").otherwise("Assistant: "),
                    F.coalesce(F.col(text_col), F.lit("")))
    d = conv.filter(F.col(role_col).isin("user", "assistant"))
    agg = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), line.alias("l")))).alias("_ls"))
    return agg.select(key, F.concat_ws("\n", F.transform("_ls", lambda s: s["l"])).alias("transcript"))
