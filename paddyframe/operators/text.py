"""Text operators: redaction, phrase flags, guard decision, JSON extraction,
topic policy, slot rules, heading chunker, query templates (survey 2.K).

Everything is a column expression over whole texts (regexp_replace, instr over a
literal phrase array, from_json), so it runs inside whole-stage codegen with
no Python in the hot path.  The fixed phrase lists are literal arrays: bounded by
construction, no join; phrase lists that come as tables are ``phrases.phrase_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import any_contains, col_

# --- fixed values: redaction patterns (applied in this order) and tags ------
EMAIL_REGEX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_REGEX = r"(?<!\d)(?:09\d{2}[\s-]?\d{3}[\s-]?\d{4}|\+639\d{2}[\s-]?\d{3}[\s-]?\d{4})(?!\d)"
NAME_REGEX = r"(?i)\b(?:my\s+name\s+is|i\s+am\s+named|i'm\s+named)"
UNICODE = "(?U)"   # digits, spaces and word bounds of any script, as the patterns were written for
EMAIL_TAG, PHONE_TAG, NAME_TAG = "[REDACTED-EMAIL]", "[REDACTED-PHONENUMBER]", "[REDACTED-NAME]"

# --- fixed values: prompt-injection phrases ----------------------------------
INJECTION_PATTERNS = [
    "ignore previous instructions",
    "ignore all previous instructions",
    "ignore your instructions",
    "disregard previous instructions",
    "disregard all previous instructions",
    "forget previous instructions",
    "forget all previous instructions",
    "override your instructions",
    "override previous instructions",
    "follow these new instructions",
    "new instructions",
    "system prompt",
    "system message",
    "developer message",
    "developer instructions",
    "reveal your prompt",
    "show your prompt",
    "show me your system prompt",
    "print your instructions",
    "reveal your instructions",
    "bypass your restrictions",
    "bypass your rules",
    "jailbreak",
    "developer mode",
    "unrestricted mode",
    "do not follow your instructions",
    "you are now dan",
    "system override",
]

# --- fixed values: out-of-scope phrases ---------------------------------------
OUT_OF_SCOPE_PATTERNS = [
    "should i plant",
    "should we plant",
    "when should i plant",
    "when should we plant",
    "what should i plant",
    "what crop should i plant",
    "which crop should i plant",
    "what to plant",
    "when to plant",
    "where should i plant",
    "should i irrigate",
    "should we irrigate",
    "when should i irrigate",
    "when to irrigate",
    "how much water should i use",
    "how often should i irrigate",
    "irrigation recommendation",
    "irrigation advice",
    "what fertilizer should i use",
    "which fertilizer should i use",
    "how much fertilizer should i use",
    "when should i fertilize",
    "when to fertilize",
    "fertilizer recommendation",
    "fertilizer advice",
    "what pesticide should i use",
    "which pesticide should i use",
    "what insecticide should i use",
    "which insecticide should i use",
    "how should i treat",
    "how do i treat",
    "how to treat",
    "pest control recommendation",
    "disease treatment",
    "pest treatment",
    "should i harvest",
    "should we harvest",
    "when should i harvest",
    "when to harvest",
    "harvesting recommendation",
    "harvesting advice",
    "how can i increase my yield",
    "how do i increase my yield",
    "how to increase my yield",
    "how can i improve my yield",
    "how do i improve my yield",
    "how to improve my yield",
    "how can i maximize my yield",
    "how do i maximize my yield",
    "how to maximize my yield",
    "what should i do to increase yield",
    "what should i do to improve yield",
    "what should i do to protect my crop",
    "how should i manage my crop",
    "crop management advice",
    "farming advice",
    "farming recommendation",
    "what should i do",
    "what should we do",
    "what do you recommend",
    "what would you recommend",
    "give me a recommendation",
    "give me advice",
    "recommend what i should",
    "tell me what to do",
    "weather forecast",
    "weather prediction",
    "weather predictions",
    "forecast the weather",
    "predict the weather",
    "predict weather",
    "what will the weather be like",
    "what will the weather look like",
    "what is the weather going to be like",
    "what is the weather going to look like",
    "what will the weather be",
    "what is the weather expected to be",
    "what weather can we expect",
    "what weather should we expect",
    "what weather is expected",
    "what are the expected weather conditions",
    "will it rain",
    "is it going to rain",
    "is there going to be rain",
    "will there be rain",
    "will it be sunny",
    "will it be hot",
    "will it be cold",
    "will there be a storm",
    "is there a storm coming",
    "is a typhoon coming",
    "will a typhoon hit",
    "weather tomorrow",
    "weather next week",
    "weather next month",
]

# --- fixed values: topic vocabulary and the topic / action / slot rules -------
TOPICS = ["WEATHER", "CROP", "RELATIONSHIP", "GENERAL", "FORECAST", "ADVICE", "OFF_TOPIC"]
RESTRICTED_TOPICS = ["ADVICE", "OFF_TOPIC", "UNKNOWN"]
TOPIC_ACTIONS = {
    "WEATHER": ["GET_WEATHER_DATA", "DESCRIBE_CAPABILITIES"],
    "CROP": ["GET_CROP_DATA", "PREDICT_YIELD", "PREDICT_PRICE", "EXPLAIN_PREDICTION", "DESCRIBE_CAPABILITIES"],
    "CROP_OUTCOMES": ["GET_CROP_DATA", "PREDICT_YIELD", "PREDICT_PRICE", "EXPLAIN_PREDICTION", "DESCRIBE_CAPABILITIES"],
    "RELATIONSHIP": ["ANALYZE_CORRELATION", "PREDICT_YIELD", "PREDICT_PRICE", "EXPLAIN_PREDICTION", "DESCRIBE_CAPABILITIES"],
    "GENERAL": ["DESCRIBE_CAPABILITIES"],
}
ACTION_SLOTS = {
    "GET_WEATHER_DATA": ["location", "time_period", "weather_variables"],
    "GET_CROP_DATA": ["location", "time_period", "crop_type", "outcome_metric"],
    "ANALYZE_CORRELATION": ["location", "time_period", "weather_variables", "crop_type", "outcome_metric"],
    "PREDICT_YIELD": ["location", "time_period", "crop_type"],
    "PREDICT_PRICE": ["location", "time_period", "crop_type"],
    "EXPLAIN_PREDICTION": ["location", "time_period", "crop_type"],
}
MIN_CONFIDENCE = 0.5
# --- fixed values: retrieval query templates -----------------------------------
QUERY_PREDICT = "predicting rice yield from weather variables"
QUERY_PRICE = "rice production and rice price supply shocks"
QUERY_DEFAULT = "weather impact on rice yield and production"
# ---------------------------------------------------------------------------


# ---- K1 --------------------------------------------------------------------

def _guarded(c: Column, needles: list[str], regex: str, tag: str, lower: bool = False) -> Column:
    """Run the regex only on texts containing a substring every match must contain
    (an exact prefilter: ``instr`` is a fast scan, the regex engine is not)."""
    probe = F.lower(c) if lower else c
    hit = F.lit(False)
    for n in needles:
        hit = hit | (F.instr(probe, n) > 0)
    return F.when(hit, F.regexp_replace(c, regex, tag)).otherwise(c)


def redact_email(c) -> Column:
    return _guarded(col_(c), ["@"], EMAIL_REGEX, EMAIL_TAG)


def redact_phone(c) -> Column:
    return _guarded(col_(c), ["09", "+639"], UNICODE + PHONE_REGEX, PHONE_TAG)


def redact_name(c) -> Column:
    return _guarded(col_(c), ["name"], UNICODE + NAME_REGEX, NAME_TAG, lower=True)


def remove_pii(c) -> Column:
    """E-mail, then phone, then self-introduction phrase (K1)."""
    return redact_name(redact_phone(redact_email(c)))


# ---- K2 / K3 ---------------------------------------------------------------

def is_prompt_injection(c) -> Column:
    return any_contains(c, INJECTION_PATTERNS)


def is_out_of_scope(c) -> Column:
    return any_contains(c, OUT_OF_SCOPE_PATTERNS)


# ---- K4 --------------------------------------------------------------------

def guard_decision(c, topic_col: str | None = None, fallback_col: str | None = None):
    """Ordered guard (K4): redact -> injection -> out-of-scope -> topic fallback.

    Returns (clean_text, decision, reason).
    """
    clean = remove_pii(c)
    reason = (F.when(is_prompt_injection(clean), "injection")
              .when(is_out_of_scope(clean), "out_of_scope"))
    if topic_col and fallback_col:
        reason = reason.when(F.col(fallback_col) & (F.col(topic_col) == "FORECAST"), "forecast") \
            .when(F.col(fallback_col) & (F.col(topic_col) == "ADVICE"), "advice") \
            .when(F.col(fallback_col), "off_topic")
    return (clean.alias("clean_text"), F.when(reason.isNull(), "allow").otherwise("block").alias("decision"),
            reason.alias("reason"))


# ---- K5 --------------------------------------------------------------------

def extract_json(c, schema: T.StructType | str, greedy: bool = True) -> Column:
    """First JSON object in noisy model text (K5): strip a code fence, take ``{...}``
    (greedy or lazy), parse with a schema; anything unparseable -> NULL."""
    text = F.coalesce(col_(c), F.lit(""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    body = F.when(fenced != "", F.trim(fenced)).otherwise(text)
    obj = F.regexp_extract(body, r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0)
    return F.when(obj != "", F.from_json(obj, schema, {"mode": "PERMISSIVE"}))


# ---- K6 --------------------------------------------------------------------

def topic_policy(parsed) -> tuple[Column, ...]:
    """Classification decision table (K6) over a parsed struct (topic, allowed, confidence).

    Returns (topic, allowed, confidence, fallback).
    """
    p = col_(parsed)
    topic0 = F.coalesce(p["topic"], F.lit("UNKNOWN"))
    known = F.array(*[F.lit(t) for t in TOPICS])
    topic = F.when(F.array_contains(known, topic0), topic0).otherwise("UNKNOWN")
    conf = F.coalesce(p["confidence"].cast("double"), F.lit(0.0))
    allowed0 = F.coalesce(p["allowed"].cast("boolean"), F.lit(False))
    failed = p.isNull()
    low = conf < MIN_CONFIDENCE
    restricted = topic.isin(RESTRICTED_TOPICS)
    fallback = failed | low | restricted | ~allowed0
    return (F.when(failed | low, "UNKNOWN").otherwise(topic).alias("topic"),
            (~fallback).alias("allowed"), F.when(failed, 0.0).otherwise(conf).alias("confidence"),
            fallback.alias("fallback"))


# ---- K7 --------------------------------------------------------------------

def _map_of_arrays(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def allowed_actions(topic) -> Column:
    return F.coalesce(F.element_at(_map_of_arrays(TOPIC_ACTIONS), col_(topic)), F.array(F.lit("UNKNOWN")))


def missing_slots(action, present_slots) -> tuple[Column, Column]:
    """Required slots of the action minus the non-empty slots present; readiness flag (K7)."""
    req = F.coalesce(F.element_at(_map_of_arrays(ACTION_SLOTS), col_(action)), F.array().cast("array<string>"))
    missing = F.filter(req, lambda s: ~F.array_contains(F.coalesce(col_(present_slots),
                                                                   F.array().cast("array<string>")), s))
    return missing.alias("missing_slots"), (F.size(missing) == 0).alias("is_ready")


# ---- K8 --------------------------------------------------------------------

def _strip(c) -> Column:
    """Whitespace strip like Python ``str.strip()`` (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunk_headings(docs: DataFrame, key: str, text_col: str, source_col: str | None = None,
                   default_section: str = "General") -> DataFrame:
    """Heading chunker (K8): split at lines starting with ``#``+space, preamble -> chunk_0
    (section ``General``), empty bodies skipped, ids numbered from 1 per document."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)(?=^#+ .*$)")
    x = docs.select(key, *([source_col] if source_col else []), F.posexplode(parts).alias("pos", "part"))
    head = F.regexp_extract("part", r"^(#+ [^\n]*)", 1)
    body = F.when(head != "", F.expr("substring(part, length(regexp_extract(part, '^(#+ [^\\n]*)', 1)) + 1)")) \
        .otherwise(F.col("part"))
    x = x.withColumn("heading", head).withColumn("text", _strip(body))
    x = x.filter(F.col("text") != "")
    is_pre = F.col("heading") == ""
    section = F.when(is_pre, F.lit(default_section)).otherwise(_strip(F.regexp_replace("heading", "^#+", "")))
    x = x.withColumn("section", section).withColumn("_pre", is_pre.cast("int"))
    w = Window.partitionBy(key, "_pre").orderBy("pos")
    x = x.withColumn("chunk_no", F.when(F.col("_pre") == 1, F.lit(0)).otherwise(F.row_number().over(w)))
    return x.select(key, *([source_col] if source_col else []), F.concat(F.lit("chunk_"), F.col("chunk_no")).alias("chunk_id"),
                    "chunk_no", "section", "text")


# ---- K11 -------------------------------------------------------------------

def retrieval_query(action, variables, outcome, user_query, topic) -> Column:
    """Retrieval query from the rule table."""
    vars_text = F.when(F.size(F.coalesce(col_(variables), F.array().cast("array<string>"))) > 0,
                       F.array_join(col_(variables), " and ")).otherwise(F.lit("weather"))
    out = F.lower(F.coalesce(col_(outcome), F.lit("rice yield")))
    return (F.when(col_(action) == "ANALYZE_CORRELATION",
                   F.concat(F.lit("relationship between "), vars_text, F.lit(" and "), out))
            .when(col_(action).isin("PREDICT_YIELD", "PREDICT_PRICE", "EXPLAIN_PREDICTION"), F.lit(QUERY_PREDICT))
            .when(F.lower(col_(user_query)).contains("price") | (col_(topic) == "MARKET"), F.lit(QUERY_PRICE))
            .otherwise(F.lit(QUERY_DEFAULT)))
