"""Catalogue entries for conversation tables, evaluation, data quality and
sources/sinks (survey 2.L, 2.M, 2.A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as conv
from ..operators import evaluate as ev
from ..operators import linear, quality, text
from ..session import shared_folder, written
from ..sources import io, registry
from .catalog import query
from .fixtures import TRAIN_END_YEAR
from ..functions.columns import py_round_sql as _pr
from .oracle import oracle
from .q_model import FIXED_TERMS
from .q_text import _KNN_CTES, RETRIEVAL_METRICS_SQL, _POLICY_SQL, _RESOLVE_CTES, _TOPIC_OF, policy, resolved

_ELIG = "(role = 'user' OR (role = 'assistant' AND coalesce(length(text) > 0, FALSE)))"


# ---------------------------------------------------------------- 2.L ------

@query("last_n_turns", "L1", oracle([], f"""SELECT conv_id, turn, role,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency
    FROM conversations WHERE {_ELIG} QUALIFY recency <= 4"""))
def q_last_n_turns(fx):
    return conv.last_n_turns(fx.t.conversations).select("conv_id", "turn", "role", "recency")


@query("window_split", "L2", oracle([], """SELECT conv_id, turn,
      CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 THEN 'recent' ELSE 'older' END AS bucket
    FROM conversations"""))
def q_window_split(fx):
    return conv.window_split(fx.t.conversations, keep=4).select("conv_id", "turn", "bucket")


@query("latest_tool_block", "L3", oracle([], """SELECT conv_id, turn FROM (
      SELECT conv_id, turn, role, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (
          PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
      FROM conversations) x
    WHERE role = 'user' QUALIFY island = min(island) OVER (PARTITION BY conv_id)"""))
def q_latest_tool_block(fx):
    c = fx.t.conversations
    return conv.latest_tool_block(c, F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn")


_RESULT_TYPES = ("view", "purchase", "signup")


@query("resolved_calls", "L4", oracle([], f"""SELECT CAST(CAST(c.ts AS DATE) AS VARCHAR) AS conv_id, c.event_id AS turn
    FROM events c WHERE c.event_type = 'click'
      AND EXISTS (SELECT 1 FROM events r WHERE r.event_id = c.event_id + 1 AND r.event_type IN {_RESULT_TYPES}
                  AND CAST(r.ts AS DATE) = CAST(c.ts AS DATE))
      AND EXISTS (SELECT 1 FROM events r WHERE r.event_id = c.event_id + 2 AND r.event_type IN {_RESULT_TYPES}
                  AND CAST(r.ts AS DATE) = CAST(c.ts AS DATE))"""))
def q_resolved_calls(fx):
    e = fx.t.events.withColumn("conv_id", F.to_date("ts").cast("string"))
    calls = e.filter(F.col("event_type") == "click").select(
        "conv_id", F.col("event_id").alias("turn"),
        F.array(F.col("event_id") + 1, F.col("event_id") + 2).alias("call_ids"))
    results = e.filter(F.col("event_type").isin(*_RESULT_TYPES)).select("conv_id", F.col("event_id").alias("call_id"))
    return conv.resolved_calls(calls, results).select("conv_id", "turn")


_ACTIONS = {"view": "GET_WEATHER_DATA", "click": "ANALYZE_CORRELATION", "purchase": "PREDICT_PRICE",
            "signup": "DESCRIBE_CAPABILITIES", "error": "UNKNOWN"}


def _slot_events(fx):
    e = fx.t.events
    amap = F.create_map(*[x for k, v in _ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    loc = F.when(F.col("value") > 50, F.concat(F.lit("loc"), F.floor(F.col("value") / 10).cast("string"))).otherwise(F.lit(""))
    wv = F.when(F.col("value") < 30, F.lit("RAIN"))
    slots = F.explode(F.array(F.struct(F.lit("location").alias("slot"), loc.alias("value")),
                              F.struct(F.lit("weather_variables").alias("slot"), wv.alias("value"))))
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"),
                    F.element_at(amap, F.col("event_type")).alias("action"), (F.col("value") > 5).alias("confident"),
                    slots.alias("s")).select("conv_id", "turn", "action", "confident", "s.slot", "s.value")


def _allowed_sql(slot):
    acts = [a for a, ss in text.ACTION_SLOTS.items() if slot in ss]
    ets = [et for et, a in _ACTIONS.items() if a in acts]
    return "(" + " OR ".join(f"event_type = '{et}'" for et in ets) + ")" if ets else "FALSE"


@query("slot_carry", "L5", oracle([], f"""SELECT conv_id, turn, slot,
      last_value(val IGNORE NULLS) OVER (PARTITION BY conv_id, slot, island ORDER BY turn
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
    FROM (SELECT *, sum(rst) OVER (PARTITION BY conv_id, slot ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT user_id AS conv_id, event_id AS turn, 'location' AS slot,
                   CASE WHEN value > 5 AND NOT {_allowed_sql('location')} THEN 1 ELSE 0 END AS rst,
                   CASE WHEN value > 5 AND {_allowed_sql('location')} AND value > 50
                        THEN 'loc' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END AS val FROM events
            UNION ALL
            SELECT user_id, event_id, 'weather_variables',
                   CASE WHEN value > 5 AND NOT {_allowed_sql('weather_variables')} THEN 1 ELSE 0 END,
                   CASE WHEN value > 5 AND {_allowed_sql('weather_variables')} AND value < 30 THEN 'RAIN' END FROM events))"""))
def q_slot_carry(fx):
    return conv.slot_carry(_slot_events(fx), text.ACTION_SLOTS)


_EXPS = ["weather", "correlation", "clarify", "reject", "general"]
_TOOL_OF = {"view": "get_monthly_weather_tool", "click": "analyze_correlation_tool"}


@query("trajectory_match", "L6 E11", oracle([], """SELECT r.user_id, r.exp, coalesce(c.n, 0) AS n_tools,
      CASE WHEN r.exp = 'weather' THEN coalesce(c.hw, FALSE) WHEN r.exp = 'correlation' THEN coalesce(c.hc, FALSE)
           WHEN r.exp IN ('clarify', 'reject', 'general') THEN coalesce(c.n, 0) = 0 ELSE FALSE END AS traj_ok,
      r.grounded, r.helpful,
      (CASE WHEN r.exp = 'weather' THEN coalesce(c.hw, FALSE) WHEN r.exp = 'correlation' THEN coalesce(c.hc, FALSE)
            WHEN r.exp IN ('clarify', 'reject', 'general') THEN coalesce(c.n, 0) = 0 ELSE FALSE END)
        AND (r.exp IN ('clarify', 'reject', 'general') OR (r.grounded >= 4 AND r.helpful >= 3)) AS success
    FROM (SELECT user_id, (['weather', 'correlation', 'clarify', 'reject', 'general'])[CAST(user_id % 5 AS INTEGER) + 1] AS exp,
                 CAST(floor(avg(value) / 10) AS BIGINT) AS grounded, CAST(floor(max(value) / 20) AS BIGINT) AS helpful
          FROM events GROUP BY user_id) r
    LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(event_type = 'view') AS hw, bool_or(event_type = 'click') AS hc
               FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id) c ON r.user_id = c.user_id"""))
def q_trajectory_match(fx):
    e = fx.t.events
    runs = e.groupBy("user_id").agg(F.floor(F.avg("value") / 10).cast("long").alias("grounded"),
                                    F.floor(F.max("value") / 20).cast("long").alias("helpful"))
    runs = runs.withColumn("exp", F.element_at(F.array(*[F.lit(x) for x in _EXPS]), (F.col("user_id") % 5 + 1).cast("int")))
    tmap = F.create_map(*[x for k, v in _TOOL_OF.items() for x in (F.lit(k), F.lit(v))])
    calls = e.filter(F.col("event_type").isin(*_TOOL_OF)).select("user_id", F.element_at(tmap, F.col("event_type")).alias("tool"))
    out = ev.trajectory_outcome(calls, runs, "user_id", "tool", "exp", "grounded", "helpful")
    return out.select("user_id", "exp", "n_tools", "traj_ok", "grounded", "helpful", "success")


def _bin_sql(pred, label, src):
    f1 = ("coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0)"
          " + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0)")
    return f"""SELECT {_pr('coalesce(tp / nullif(tp + fp, 0), 0.0)', 3)} AS precision,
      {_pr('coalesce(tp / nullif(tp + fn, 0), 0.0)', 3)} AS recall, {_pr(f1, 3)} AS f1,
      {_pr('coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0)', 3)} AS accuracy, tp, fp, fn, tn
    FROM (SELECT count(*) FILTER (WHERE {pred} AND {label}) AS tp, count(*) FILTER (WHERE {pred} AND NOT {label}) AS fp,
                 count(*) FILTER (WHERE NOT {pred} AND {label}) AS fn, count(*) FILTER (WHERE NOT {pred} AND NOT {label}) AS tn
          FROM {src})"""


@query("binary_metrics", "L7", oracle([], _bin_sql("d.n_chars > 1000", "l.quality = 1",
                                                 "labels l JOIN documents d ON l.doc_id = d.doc_id"),
                                      ["precision", "recall", "f1", "accuracy"]))
def q_binary_metrics(fx):
    d = fx.t.labels.join(fx.t.documents, "doc_id").select((F.col("n_chars") > 1000).alias("pred"),
                                                          (F.col("quality") == 1).alias("label"))
    return ev.binary_metrics(d, "pred", "label")


_EMAIL = "regexp_replace(d.text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED-EMAIL]', 'g')"


@query("pii_eval", "L8 K1", oracle([], _bin_sql(f"({_EMAIL} <> d.text)", "l.toxic = 1",
                                             "labels l JOIN documents d ON l.doc_id = d.doc_id"),
                                   ["precision", "recall", "f1", "accuracy"]))
def q_pii_eval(fx):
    d = fx.t.labels.join(fx.t.documents, "doc_id")
    d = d.select(ev.changed_flag(F.col("text"), text.redact_email("text")).alias("pred"), (F.col("toxic") == 1).alias("label"))
    return ev.binary_metrics(d, "pred", "label")


@query("trajectory_path", "L6", oracle([], """SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS path,
      list(role ORDER BY turn) = ['user', 'assistant', 'user', 'assistant'] AS path_ok FROM conversations GROUP BY conv_id"""))
def q_trajectory_path(fx):
    """Exact path equality: the ordered steps of every run against the expected path."""
    runs = ev.trajectory(fx.t.conversations, "conv_id", "turn", "role").withColumns({
        "exp": F.lit("general"), "want": F.array(*map(F.lit, ["user", "assistant", "user", "assistant"]))})
    out = ev.trajectory_match(runs, expected_path_col="want")
    return out.select("conv_id", F.array_join("tools", ">").alias("path"), "path_ok")


@query("resolve_eval", "L9", oracle([], f"""SELECT
      {_pr("count(*) FILTER (WHERE exp_status = 'RESOLVED' AND province IS NOT NULL AND province = exp_province) / greatest(count(*) FILTER (WHERE exp_status = 'RESOLVED' AND province IS NOT NULL), 1)", 3)} AS entity_accuracy,
      {_pr("avg(CASE WHEN status = exp_status THEN 1.0 ELSE 0.0 END)", 3)} AS status_accuracy,
      count(*) FILTER (WHERE exp_status = 'RESOLVED' AND province IS NOT NULL) AS resolved, count(*) AS n_cases
    FROM (SELECT r.*, CASE WHEN r.request_id < 1000 AND r.request_id % 10 = 4 THEN 'NOT_FOUND'
                           WHEN r.request_id >= 10000000 THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS exp_status,
                 CASE WHEN r.request_id < 1000 THEN rg.r_name END AS exp_province
          FROM resolved r LEFT JOIN nation n ON r.request_id < 1000 AND n.n_nationkey = r.request_id // 10
          LEFT JOIN region rg ON rg.r_regionkey = n.n_regionkey)""", ["entity_accuracy", "status_accuracy"],
    extra=_RESOLVE_CTES))
def q_resolve_eval(fx):
    r = resolved(fx)
    n = fx.t.nation.join(fx.t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("_nk"), F.col("r_name").alias("exp_province"))
    r = r.withColumn("_nk", F.when(F.col("request_id") < 1000, F.floor(F.col("request_id") / 10).cast("long")))
    r = r.join(n, "_nk", "left")
    exp = F.when((F.col("request_id") < 1000) & (F.col("request_id") % 10 == 4), "NOT_FOUND") \
        .when(F.col("request_id") >= 10000000, "NOT_FOUND").otherwise("RESOLVED")
    return ev.resolver_accuracy(r.withColumn("exp_status", exp), "status", "exp_status", "province", "exp_province")


@query("label_accuracy", "L11 K6", oracle([], f"""SELECT {_pr("avg(CASE WHEN fallback = NOT (event_type IN ('view', 'click')) THEN 1.0 ELSE 0.0 END)", 3)} AS blocked_accuracy,
      {_pr("avg(CASE WHEN topic = CASE event_type " + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOPIC_OF.items()) + " END THEN 1.0 ELSE 0.0 END)", 3)} AS topic_accuracy,
      count(*) AS n_cases FROM policy""", ["blocked_accuracy", "topic_accuracy"], extra=[_POLICY_SQL]))
def q_label_accuracy(fx):
    p = policy(fx)
    tmap = F.create_map(*[x for k, v in _TOPIC_OF.items() for x in (F.lit(k), F.lit(v))])
    p = p.withColumn("exp_topic", F.element_at(tmap, F.col("event_type"))) \
        .withColumn("exp_allowed", F.col("event_type").isin("view", "click"))
    return ev.label_accuracy(p, "topic", "exp_topic", "fallback", "exp_allowed")


@query("position_bias", "L12", oracle([], """SELECT CASE WHEN w1 = 'A' AND w2 = 'B' THEN 'content-consistent'
        WHEN w1 = 'A' AND w2 = 'A' THEN 'position-biased-first' WHEN w1 = 'B' AND w2 = 'B' THEN 'position-biased-second'
        ELSE 'content-inconsistent' END AS verdict_class, count(*) AS n
    FROM (SELECT CASE WHEN value > 50 THEN 'A' ELSE 'B' END AS w1,
                 CASE WHEN TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) > 50 THEN 'B'
                      WHEN event_type = 'error' THEN 'tie' ELSE 'A' END AS w2 FROM events) GROUP BY 1"""))
def q_position_bias(fx):
    e = fx.t.events
    w1 = F.when(F.col("value") > 50, "A").otherwise("B")
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).try_cast("int")
    w2 = F.when(k > 50, "B").when(F.col("event_type") == "error", "tie").otherwise("A")
    return e.select(ev.position_bias(w1, w2).alias("verdict_class")).groupBy("verdict_class").agg(
        F.count(F.lit(1)).alias("n"))


@query("transcript", "L13", oracle([], """SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END
      || coalesce(text, ''), chr(10) ORDER BY turn)) AS transcript_md5
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"""))
def q_transcript(fx):
    t = conv.transcript(fx.t.conversations)
    return t.select("conv_id", F.md5("transcript").alias("transcript_md5"))


# ---------------------------------------------------------------- 2.M ------

def _dq_checks(fx):
    w, p, pr = fx.weather(), fx.production(), fx.prices()
    cw = quality.check_rows(w, [
        ("weather_rows", F.count(F.lit(1)) > 0, F.count(F.lit(1))),
        ("weather_precip_nulls", F.count_if(F.col("precipitation_sum").isNull()) == 0,
         F.count_if(F.col("precipitation_sum").isNull())),
        ("weather_month_range", (F.min("month") >= 1) & (F.max("month") <= 12),
         F.concat_ws("-", F.min("month").cast("string"), F.max("month").cast("string"))),
        ("weather_entities", F.count_distinct("entity_id") > 0, F.count_distinct("entity_id"))])
    cp = quality.check_rows(p, [
        ("production_rows", F.count(F.lit(1)) > 0, F.count(F.lit(1))),
        ("production_yield_nulls", F.count_if(F.col("yield_rate").isNull()) == 0, F.count_if(F.col("yield_rate").isNull()))])
    cr = quality.check_rows(pr, [
        ("price_rows", F.count(F.lit(1)) > 0, F.count(F.lit(1))),
        ("price_positive", F.min("price") > 0, F.count_if(F.col("price") <= 0))])
    return quality.dq_report(cw, cp, cr)


@query("dq_report", "M1 E8", oracle(["weather", "production", "prices"], """
    SELECT * FROM checks UNION ALL
    SELECT 'passed/total', count(*) FILTER (WHERE ok) = count(*),
           CAST(count(*) FILTER (WHERE ok) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) FROM checks""",
    extra=["""checks AS (
    SELECT 'weather_rows' AS name, count(*) > 0 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM weather
    UNION ALL SELECT 'weather_precip_nulls', count(*) FILTER (WHERE precipitation_sum IS NULL) = 0,
                     CAST(count(*) FILTER (WHERE precipitation_sum IS NULL) AS VARCHAR) FROM weather
    UNION ALL SELECT 'weather_month_range', min(month) >= 1 AND max(month) <= 12,
                     CAST(min(month) AS VARCHAR) || '-' || CAST(max(month) AS VARCHAR) FROM weather
    UNION ALL SELECT 'weather_entities', count(DISTINCT entity_id) > 0, CAST(count(DISTINCT entity_id) AS VARCHAR) FROM weather
    UNION ALL SELECT 'production_rows', count(*) > 0, CAST(count(*) AS VARCHAR) FROM production
    UNION ALL SELECT 'production_yield_nulls', count(*) FILTER (WHERE yield_rate IS NULL) = 0,
                     CAST(count(*) FILTER (WHERE yield_rate IS NULL) AS VARCHAR) FROM production
    UNION ALL SELECT 'price_rows', count(*) > 0, CAST(count(*) AS VARCHAR) FROM prices
    UNION ALL SELECT 'price_positive', min(price) > 0, CAST(count(*) FILTER (WHERE price <= 0) AS VARCHAR) FROM prices)"""]))
def q_dq_report(fx):
    return _dq_checks(fx)


@query("dq_unique", "M2", oracle([], """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_dq_unique(fx):
    return quality.dq_unique(fx.t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_fk", "M2", oracle([], """SELECT count(*) AS orphans FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""))
def q_dq_fk(fx):
    return quality.dq_fk(fx.t.lineitem.select("l_orderkey"), fx.t.orders, "l_orderkey", "o_orderkey") \
        .agg(F.count(F.lit(1)).alias("orphans"))


@query("dq_domain", "M2", oracle([], """SELECT count(*) FILTER (WHERE month(o_orderdate) NOT BETWEEN 1 AND 12) AS bad_month,
      (SELECT count(*) FROM lineitem WHERE l_discount IS NULL OR l_discount NOT BETWEEN 0 AND 0.1) AS bad_discount
    FROM orders"""))
def q_dq_domain(fx):
    o = fx.t.orders.withColumn("m", F.month("o_orderdate"))
    a = quality.dq_domain(o, "m", 1, 12).agg(F.count(F.lit(1)).alias("bad_month"))
    b = quality.dq_domain(fx.t.lineitem, "l_discount", 0, 0.1).agg(F.count(F.lit(1)).alias("bad_discount"))
    return a.join(b, how="inner")


# ---------------------------------------------------------------- 2.A ------

@query("series_explode", "A5", oracle([], """SELECT user_id,
      CAST(epoch(CAST(ts AS DATE)) AS BIGINT) + row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1
        AS ts_epoch, value, event_id FROM events"""))
def q_series_explode(fx):
    e = fx.t.events
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("_s"))
    arr = day.select("user_id", F.unix_timestamp(F.col("day").cast("timestamp")).alias("start"),
                     F.transform("_s", lambda s: s["value"]).alias("value"),
                     F.transform("_s", lambda s: s["event_id"]).alias("event_id"))
    arr = arr.withColumn("end", F.col("start") + F.size("value")).withColumn("step", F.lit(1).cast("long"))
    out = io.series_explode(arr, ["user_id"], "start", "end", "step", ["value", "event_id"])
    return out.select("user_id", F.col("ts").cast("long").alias("ts_epoch"), "value", "event_id")


@query("upsert_ignore", "A6", oracle(["production"], """SELECT * FROM production WHERE year <= 1998
    UNION ALL SELECT entity_id, year, month, volume + 1, area, yield_rate FROM production
      WHERE year >= 1997 AND year > 1998""", ["volume", "area", "yield_rate"]))
def q_upsert_ignore(fx):
    p = fx.production()
    existing = p.filter(F.col("year") <= 1998)
    incoming = p.filter(F.col("year") >= 1997).withColumn("volume", F.col("volume") + 1)
    return io.insert_or_ignore(existing, incoming, ["entity_id", "year", "month"], ["volume", "area"])


@query("insert_sink", "A6", oracle(["production"], """SELECT entity_id, year, month, volume FROM production WHERE year <= 1998
    UNION ALL SELECT entity_id, year, month, volume + 1 FROM production WHERE year > 1998""", ["volume"]))
def q_insert_sink(fx):
    """Insert-or-ignore run against a folder: rows up to 1998 are there, rows from 1997 on come in twice."""
    p, path = fx.production().select("entity_id", "year", "month", "volume"), shared_folder(fx.spark)
    p.filter("year <= 1998").write.parquet(path)
    incoming = p.filter("year >= 1997").withColumn("volume", F.col("volume") + 1)
    io.append_new(incoming.unionByName(incoming.withColumn("volume", F.col("volume") + 1)), path, ["entity_id", "year", "month"], ["volume"])
    return fx.spark.read.schema(incoming.schema).parquet(path)


@query("replace_sink", "A7", oracle(["production"], """SELECT entity_id, year, month,
    CASE WHEN entity_id % 5 = 0 THEN volume + 1 ELSE volume END AS volume, entity_id % 5 = 0 AS rewritten
    FROM production WHERE entity_id % 5 <> 0 OR year > 1995""", ["volume"]))
def q_replace_sink(fx):
    """Replace some entities' rows in a folder; ``rewritten`` tells whether a row's file is another than before."""
    p, path = fx.production().select("entity_id", "year", "month", "volume"), shared_folder(fx.spark)
    io.replace_partitions(p, path, ["entity_id"])
    read = lambda: fx.spark.read.schema(p.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    before = written(read().select("file").distinct().withColumn("same", F.lit(True)))
    new = p.filter("entity_id % 5 = 0 and year > 1995").withColumn("volume", F.col("volume") + 1)
    io.replace_partitions(new, path, ["entity_id"])
    return read().join(before, "file", "left").select("entity_id", "year", "month", "volume", F.col("same").isNull().alias("rewritten"))


@query("csv_roundtrip", "A1 A8", oracle([], """SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars, FALSE AS corrupt FROM documents"""))
def q_csv_roundtrip(fx):
    """All documents exported to CSV and scanned again by their schema."""
    d, path = fx.t.documents.select("doc_id", "text", "lang", "source", "n_chars"), shared_folder(fx.spark)
    io.write_csv(d, path)
    back = io.read_csv(fx.spark, path, d.schema, keep_corrupt=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars", F.col(io.CORRUPT).isNotNull().alias("corrupt"))


@query("json_cases", "A10", oracle([], "SELECT conv_id, turn, role, md5(text) AS text_md5, FALSE AS corrupt FROM conversations"))
def q_json_cases(fx):
    """All conversations exported as JSON objects that hold arrays of turns, and scanned again by their schema."""
    c, path = fx.t.conversations, shared_folder(fx.spark)
    c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns")).write.json(path)
    back = io.read_cases(fx.spark, path, "turns", "turn:bigint,role:string,text:string", "conv_id long", multi_line=False, keep_corrupt=True)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.col(io.CORRUPT).isNotNull().alias("corrupt"))


_COEFS = "feature string, mean double, std double, coef double"
_VERSIONS = [("2026-01-01 00:00:00", TRAIN_END_YEAR - 1), ("2026-02-01 00:00:00", TRAIN_END_YEAR)]


@query("latest_model", "A9 H6")
def q_latest_model(fx):
    """Ridge price models of two stamps, saved and loaded through the registry."""
    from .q_model import _tm
    tm = written(_tm(fx, "ridge"))
    cols, where = linear.feature_sets(tm.columns, "ridge")["price"], shared_folder(fx.spark)
    for stamp, end_year in reversed(_VERSIONS):
        m = linear.ridge_cv(tm.filter(F.col("year") <= end_year), cols, "target_price")
        registry.save(m.coefficients(fx.spark).select("feature", "mean", "std", "coef"), where, "ridge_price", stamp)
    return registry.load_latest(fx.spark, where, _COEFS)


@query("latest_model_stated", "A9", oracle(["features"], "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS mean, stddev_pop(CAST({f} AS DOUBLE)) AS std, {c} AS coef, 'stated' AS model_type,
        '{_VERSIONS[-1][0]}' AS trained_at FROM features WHERE year <= {_VERSIONS[-1][1]}""" for f, _, _, c in FIXED_TERMS), ["mean", "std", "coef"]))
def q_latest_model_stated(fx):
    """Models of stated coefficients, scaled by the rows up to a year: the later stamp is saved first, and a still later
    one is written but never committed."""
    rows, where = written(fx.market_features()), shared_folder(fx.spark)
    names = [f for f, *_ in FIXED_TERMS]
    coef = F.element_at(F.create_map(*[F.lit(x) for f, _, _, c in FIXED_TERMS for x in (f, float(c))]), F.col("feature"))
    table = lambda year: linear.moments_long(rows.filter(F.col("year") <= year), names).withColumn("coef", coef)
    for stamp, year in reversed(_VERSIONS):
        registry.save(table(year), where, "stated", stamp)
    registry.write_version(table(_VERSIONS[0][1]), where, "stated")
    return registry.load_latest(fx.spark, where, _COEFS).withColumn("trained_at", F.date_format("trained_at", "yyyy-MM-dd HH:mm:ss"))


def _collated_sql():
    classifier = _bin_sql("d.n_chars > 1000", "l.quality = 1", "labels l JOIN documents d ON l.doc_id = d.doc_id")
    long = lambda layer, body: (f"SELECT '{layer}' AS layer, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) "  # noqa: E731
                                f"FROM ({body}) z) ON COLUMNS(*) INTO NAME metric VALUE value)")
    return f"{long('classifier', classifier)} UNION ALL {long('retrieval', RETRIEVAL_METRICS_SQL)}"


@query("metric_summary", "A11 L7 L10", oracle([], _collated_sql(), ["value"], extra=_KNN_CTES))
def q_metric_summary(fx):
    from .q_text import q_retrieval_metrics
    b = ev.metrics_long(q_binary_metrics(fx), "classifier")
    r = ev.metrics_long(q_retrieval_metrics(fx), "retrieval")
    return ev.metric_summary(b, r)
