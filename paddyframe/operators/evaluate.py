"""Evaluation operators (survey 2.L, L6-L12): all single aggregations or column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import py_round

# --- fixed values: expectation -> tool that must appear ----------------------
EXPECT_TOOL = {"weather": "get_monthly_weather_tool", "correlation": "analyze_correlation_tool"}
NO_TOOL_EXPECTATIONS = ["clarify", "reject", "general"]
MIN_GROUNDEDNESS, MIN_HELPFULNESS = 4, 3
# ---------------------------------------------------------------------------


def trajectory(calls: DataFrame, run_key: str, seq_col: str, name_col: str) -> DataFrame:
    """Ordered tool list per run (L6). The list is one run's tool calls (bounded by the run)."""
    return calls.groupBy(run_key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("s"), F.col(name_col).alias("n")))),
                    lambda x: x["n"]).alias("tools"))


def trajectory_match(runs: DataFrame, tools_col: str = "tools", exp_col: str = "exp",
                     expected_path_col: str | None = None, grounded_col: str | None = None,
                     helpful_col: str | None = None) -> DataFrame:
    """Trajectory correctness (L6) and task success (E11 rule).

    weather/correlation: the named tool was called; clarify/reject/general: no
    tool; optional exact path equality; success = trajectory ok and (no-tool
    expectation or groundedness >= 4 and helpfulness >= 3).
    """
    tools = F.coalesce(F.col(tools_col), F.array().cast("array<string>"))
    emap = F.create_map(*[x for k, v in EXPECT_TOOL.items() for x in (F.lit(k), F.lit(v))])
    need = F.element_at(emap, F.col(exp_col))
    no_tool = F.col(exp_col).isin(NO_TOOL_EXPECTATIONS)
    ok = F.when(need.isNotNull(), F.array_contains(tools, need)).when(no_tool, F.size(tools) == 0).otherwise(False)
    out = runs.withColumn("traj_ok", ok).withColumn(
        "actual", F.when(ok, F.col(exp_col)).otherwise(F.lit("")))
    if expected_path_col:
        out = out.withColumn("path_ok", F.col(expected_path_col) == tools)
    if grounded_col and helpful_col:
        g = F.coalesce(F.col(grounded_col), F.lit(0))
        h = F.coalesce(F.col(helpful_col), F.lit(0))
        out = out.withColumn("success", F.col("traj_ok") & (no_tool | ((g >= MIN_GROUNDEDNESS) & (h >= MIN_HELPFULNESS))))
    return out


def binary_metrics(df: DataFrame, pred_col: str, label_col: str, keys: list[str] | None = None,
                   digits: int = 3) -> DataFrame:
    """Confusion counts + precision / recall / F1 / accuracy, zero-safe, rounded."""
    p, l = F.coalesce(F.col(pred_col).cast("boolean"), F.lit(False)), F.coalesce(F.col(label_col).cast("boolean"), F.lit(False))
    c = df.groupBy(*(keys or [])).agg(F.count_if(p & l).alias("tp"), F.count_if(p & ~l).alias("fp"),
                                      F.count_if(~p & l).alias("fn"), F.count_if(~p & ~l).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    c = c.withColumn("_p", prec.cast("double")).withColumn("_r", rec.cast("double"))
    f1 = F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0))
    acc = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
                     F.lit(0.0))
    return c.select(*(keys or []), py_round("_p", digits).alias("precision"), py_round("_r", digits).alias("recall"),
                    py_round(f1, digits).alias("f1"), py_round(acc.cast("double"), digits).alias("accuracy"),
                    "tp", "fp", "fn", "tn")


def changed_flag(original, transformed):
    """Redaction-as-detection (L8): positive when the transformation changed the text."""
    return F.coalesce(original != transformed, F.lit(False))


def resolver_accuracy(df: DataFrame, status_col: str, expected_status_col: str, got_entity_col: str,
                      expected_entity_col: str, digits: int = 3) -> DataFrame:
    """Status accuracy over all cases; entity accuracy over cases expected RESOLVED that
    did resolve (denominator at least 1) (L9)."""
    exp_res = F.col(expected_status_col) == "RESOLVED"
    resolved = exp_res & F.col(got_entity_col).isNotNull()
    return df.agg(
        py_round(F.count_if(resolved & (F.col(got_entity_col) == F.col(expected_entity_col)))
                 / F.greatest(F.count_if(resolved), F.lit(1)), digits).alias("entity_accuracy"),
        py_round(F.avg((F.col(status_col) == F.col(expected_status_col)).cast("double")), digits).alias("status_accuracy"),
        F.count_if(resolved).alias("resolved"), F.count(F.lit(1)).alias("n_cases"))


def label_accuracy(df: DataFrame, got_topic: str, exp_topic: str, fallback_col: str, exp_allowed: str,
                   digits: int = 3) -> DataFrame:
    """Topic accuracy and block accuracy (blocked == not allowed)."""
    blocked_ok = F.coalesce(F.col(fallback_col), F.lit(False)) == ~F.col(exp_allowed)
    return df.agg(py_round(F.avg(blocked_ok.cast("double")), digits).alias("blocked_accuracy"),
                  py_round(F.avg(F.coalesce(F.col(got_topic) == F.col(exp_topic), F.lit(False)).cast("double")),
                           digits).alias("topic_accuracy"), F.count(F.lit(1)).alias("n_cases"))


def position_bias(w1, w2):
    """Swap-consistency class of two pairwise verdicts."""
    return (F.when((w1 == "A") & (w2 == "B"), "content-consistent")
            .when((w1 == "A") & (w2 == "A"), "position-biased-first")
            .when((w1 == "B") & (w2 == "B"), "position-biased-second")
            .otherwise("content-inconsistent"))


def metric_summary(*tables: DataFrame) -> DataFrame:
    """Collate metric tables (layer, metric, value) into one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def metrics_long(df: DataFrame, layer: str) -> DataFrame:
    """One-row metric table -> (layer, metric, value) rows."""
    cols = [c for c in df.columns]
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.select(F.lit(layer).alias("layer"), F.expr(f"stack({len(cols)}, {parts}) AS (metric, value)"))


def trajectory_outcome(calls: DataFrame, runs: DataFrame, run_key: str, name_col: str, exp_col: str = "exp",
                       grounded_col: str | None = None, helpful_col: str | None = None) -> DataFrame:
    """Trajectory check from aggregates (L6): per run, the tool count and whether each expected
    tool was called, then the expectation rule and the success rule.  No per-run list is built,
    so a run with a huge number of calls is still a partial aggregate."""
    aggs = [F.count(F.col(name_col)).alias("n_tools")]
    aggs += [F.bool_or(F.col(name_col) == F.lit(t)).alias(f"_has_{k}") for k, t in EXPECT_TOOL.items()]
    r = runs.join(calls.groupBy(run_key).agg(*aggs), run_key, "left")
    n = F.coalesce(F.col("n_tools"), F.lit(0))
    ok = F.lit(False)
    rule = None
    for k in EXPECT_TOOL:
        cond = F.col(exp_col) == k
        rule = F.when(cond, F.coalesce(F.col(f"_has_{k}"), F.lit(False))) if rule is None else \
            rule.when(cond, F.coalesce(F.col(f"_has_{k}"), F.lit(False)))
    ok = rule.when(F.col(exp_col).isin(NO_TOOL_EXPECTATIONS), n == 0).otherwise(False)
    out = r.withColumn("n_tools", n).withColumn("traj_ok", ok)
    if grounded_col and helpful_col:
        no_tool = F.col(exp_col).isin(NO_TOOL_EXPECTATIONS)
        g, h = F.coalesce(F.col(grounded_col), F.lit(0)), F.coalesce(F.col(helpful_col), F.lit(0))
        out = out.withColumn("success", F.col("traj_ok") & (no_tool | ((g >= MIN_GROUNDEDNESS) & (h >= MIN_HELPFULNESS))))
    return out.drop(*[f"_has_{k}" for k in EXPECT_TOOL])
