"""Catalogue entries for scans, cleaning, joins, reshape, rollups, windows, correlation
(survey 2.A-2.G), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import ci_equals, month_ordinal, safe_ratio
from ..operators import clean, corr, features as feat, joins, rollup
from ..sources.tables import scan_filter
from .catalog import query
from .fixtures import DAILY_VARS, MONTHLY_VARS, PANEL_START_YEAR, TRAIN_END_YEAR
from ..functions.columns import py_round_sql as _pr
from .oracle import oracle

W6 = DAILY_VARS
W8 = MONTHLY_VARS
START, END = "1995-01-01", "2001-07-31"
LAG = 4
OUTCOMES = ["YIELD", "PRODUCTION", "PRICE"]
OCOL = corr.OUTCOME_COLUMNS
MARKET = ["volume", "area", "yield_rate", "price"]
LAGS = list(feat.MARKET_LAGS)


def _ords(start=START, end=END):
    return (int(start[:4]) * 12 + int(start[5:7]) - 1, int(end[:4]) * 12 + int(end[5:7]) - 1)


def _aligned_sql(lag: int, start=START, end=END, lag_expr: str | None = None, extra_from: str = "") -> str:
    s, e = _ords(start, end)
    sy, ey = int(start[:4]), int(end[:4])
    lx = lag_expr or str(lag)
    return f"""SELECT w.*, o.volume, o.area, o.yield_rate, o.price, d.entity_name, d.group_name
  FROM (SELECT * FROM weather WHERE year * 12 + month - 1 BETWEEN {s} AND {e}) w {extra_from}
  JOIN (SELECT p.entity_id, p.year * 12 + p.month - 1 AS ym, p.volume, p.area, p.yield_rate, pr.price
        FROM production p JOIN prices pr ON p.entity_id = pr.entity_id AND p.year = pr.year AND p.month = pr.month
        WHERE p.year BETWEEN {sy} AND {ey} AND pr.year BETWEEN {sy} AND {ey}) o
    ON w.entity_id = o.entity_id AND w.year * 12 + w.month - 1 + {lx} = o.ym
  JOIN dim d ON w.entity_id = d.entity_id"""


# ============================ 2.A scans ====================================

@query("scan_filter", "A3", oracle(["production"], "SELECT * FROM production WHERE entity_id = 7 AND year BETWEEN 1996 AND 1999",
                                   ["volume", "area", "yield_rate"]))
def q_scan_filter(fx):
    return scan_filter(fx.production(clean.Months.years(1996, 1999)), "entity_id", 7, "year", 1996, 1999)


# ============================ 2.B predicates ===============================

@query("period_filter", "B2", oracle(["features"], "SELECT * FROM features WHERE year >= 1996 AND (year < 2001 OR (year = 2001 AND month <= 6))",
                                     MARKET + LAGS))
def q_period_filter(fx):
    return clean.period_filter(fx.market_features(end=(2001, 6)), 1996, 2001, 6)


@query("year_between", "B3", oracle(["production"], "SELECT * FROM production WHERE year BETWEEN 1996 AND 1999",
                                    ["volume", "area", "yield_rate"]))
def q_year_between(fx):
    return clean.year_between(fx.production(clean.Months.years(1996, 1999)), "1996-03-01", "1999-12-31")


@query("ci_equals", "B4", oracle([], "SELECT * FROM nation WHERE lower(trim(n_name)) = lower(trim('  nation_1 '))"))
def q_ci_equals(fx):
    return fx.t.nation.filter(ci_equals("n_name", "  nation_1 "))


def _wide_prod(fx):
    """V2 pivoted to a statistical wide table: one row per series, one string column
    per 'YYYY Month' label, '..' for missing cells (the calendar bounds the columns)."""
    p = fx.production()
    first, last = p.agg(F.min("year"), F.max("year")).first()   # the calendar of the data
    labels = [f"{y} {m}" for y in range(first, last + 1) for m in clean._MONTHS] if first else []
    p = p.join(fx.dim(), "entity_id").withColumn(
        "label", F.concat_ws(" ", F.col("year").cast("string"),
                             F.element_at(F.array(*[F.lit(m) for m in clean._MONTHS]), F.col("month"))))
    wide = (p.groupBy(F.concat(F.lit(".."), F.col("entity_name")).alias("series"))
            .pivot("label", labels).agg(F.first(F.format_string("%.1f", F.col("volume")))))
    return wide.fillna("..", subset=labels), labels


@query("wide_to_long", "A2 B5 D3", oracle(["production", "dim"],
       """SELECT d.entity_name AS series, concat(CAST(p.year AS VARCHAR), ' ', strftime(make_date(p.year, p.month, 1), '%B')) AS period,
                 CAST(printf('%.1f', p.volume) AS DOUBLE) AS value
          FROM production p JOIN dim d ON p.entity_id = d.entity_id""", ["value"]))
def q_wide_to_long(fx):
    wide, labels = _wide_prod(fx)
    return clean.drop_cell_missing(clean.wide_csv_to_long(wide, "series", labels), "value")


@query("clean_missing", "B5", oracle(["production", "dim"],
       """SELECT g.series, g.period, CASE WHEN g.v IS NULL THEN 1 ELSE 0 END AS is_missing FROM (
            SELECT d.entity_name AS series, y.yr * 100 + m.mo AS period, p.volume AS v
            FROM dim d, (SELECT unnest(range(min(year), max(year) + 1)) AS yr FROM production) y, (SELECT unnest(range(1, 13)) AS mo) m
            LEFT JOIN production p ON p.entity_id = d.entity_id AND p.year = y.yr AND p.month = m.mo
            WHERE d.entity_id IN (SELECT entity_id FROM production)) g"""))
def q_clean_missing(fx):
    wide, labels = _wide_prod(fx)
    long = clean.wide_csv_to_long(wide, "series", labels, "label")
    d = clean.parse_period_label("label")
    return long.select("series", (F.year(d) * 100 + F.month(d)).alias("period"),
                       F.col("value").isNull().cast("int").alias("is_missing"))


_GRID_SQL = """SELECT d.entity_id, y.yr * 100 + m.mo AS period, pr.price
  FROM dim d, (SELECT unnest(range(min(year), max(year) + 1)) AS yr FROM prices) y, (SELECT unnest(range(1, 13)) AS mo) m
  LEFT JOIN prices pr ON pr.entity_id = d.entity_id AND pr.year = y.yr AND pr.month = m.mo"""


def _grid(fx):
    """(entity, period) grid over the calendar with the price cell (NULL where missing)."""
    prices = fx.prices()
    first, last = prices.agg(F.min("year"), F.max("year")).first()      # the calendar of the data
    periods = F.explode(F.sequence(F.lit((first or 0) * 12), F.lit((last or 0) * 12 + 11)))
    g = fx.dim().select("entity_id", periods.alias("_o"))
    g = g.select("entity_id", F.floor(F.col("_o") / 12).cast("int").alias("year"),
                 (F.pmod("_o", F.lit(12)) + 1).cast("int").alias("month"))
    return (g.join(prices, ["entity_id", "year", "month"], "left")
            .select("entity_id", (F.col("year") * 100 + F.col("month")).alias("period"), "price"))


@query("drop_any_missing", "B6", oracle(["dim", "prices"],
       f"SELECT * FROM ({_GRID_SQL}) g WHERE period NOT IN (SELECT period FROM ({_GRID_SQL}) h WHERE price IS NULL)",
       ["price"]))
def q_drop_any_missing(fx):
    return clean.drop_any_missing(_grid(fx), "period", "price")


@query("drop_cell_missing", "B6", oracle(["dim", "prices"], f"SELECT * FROM ({_GRID_SQL}) g WHERE price IS NOT NULL", ["price"]))
def q_drop_cell_missing(fx):
    return clean.drop_cell_missing(_grid(fx), "price")


@query("coerce_numeric", "B7", oracle([],
       """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ([^}]*)', 1) AS DOUBLE) AS k,
                 TRY_CAST(props AS DOUBLE) AS whole FROM events""", ["k", "whole"]))
def q_coerce_numeric(fx):
    e = fx.t.events
    return e.select("event_id", F.regexp_extract("props", r'"k": ([^}]*)', 1).try_cast("double").alias("k"),
                    F.col("props").try_cast("double").alias("whole"))


@query("safe_ratio", "B15", oracle(["production"],
       "SELECT entity_id, year, month, volume / NULLIF(area - 1, 0) AS ratio FROM production", ["ratio"]))
def q_safe_ratio(fx):
    p = fx.production()
    return p.select("entity_id", "year", "month", safe_ratio("volume", F.col("area") - 1).alias("ratio"))


@query("fill_zero", "B16", oracle(["features"],
       "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in LAGS) + ") FROM features",
       MARKET + LAGS))
def q_fill_zero(fx):
    return clean.fill_zero(fx.market_features(), LAGS)


_ALLOWED = ["view", "click", "purchase"]


def _requests_arr():
    return F.when(F.col("value") > 95, F.array(F.lit("ALL"), F.col("event_type"))) \
        .otherwise(F.array(F.col("event_type"), F.upper("event_type"), F.lit("click")))


@query("validate_vars", "B11", oracle([],
       """SELECT event_id,
            CASE WHEN value > 95 THEN 'view,click,purchase'
                 WHEN event_type IN ('view', 'click', 'purchase') THEN event_type || ',click'
                 ELSE 'click' END AS validated,
            CASE WHEN value > 95 THEN ''
                 WHEN event_type IN ('view', 'click', 'purchase') THEN upper(event_type)
                 ELSE event_type || ',' || upper(event_type) END AS discarded
          FROM events"""))
def q_validate_vars(fx):
    e = fx.t.events.withColumn("req", _requests_arr())
    v, d = clean.validate_vars("req", _ALLOWED)
    return e.select("event_id", F.array_join(v, ",").alias("validated"), F.array_join(d, ",").alias("discarded"))


_ENUM = {"VIEW": "views", "CLICK": "clicks", "PURCHASE": "purchases"}


@query("enum_map", "B12", oracle([],
       """SELECT event_id, CASE WHEN upper(event_type) IN ('VIEW', 'CLICK', 'PURCHASE') THEN lower(event_type) || 's'
                                ELSE 'views,clicks,purchases' END AS columns FROM events"""))
def q_enum_map(fx):
    e = fx.t.events
    return e.select("event_id", F.array_join(clean.enum_map(F.array(F.upper("event_type")), _ENUM), ",").alias("columns"))


@query("keyword_flag", "B13", oracle([],
       "SELECT doc_id, CAST(" + " OR ".join(f"contains(lower(text), '{k}')" for k in clean.EXPLANATION_KEYWORDS)
       + " AS INTEGER) AS needs_explanation FROM documents"))
def q_keyword_flag(fx):
    return fx.t.documents.select("doc_id", clean.keyword_flag("text").cast("int").alias("needs_explanation"))


@query("parse_period_label", "B14", oracle(["production"],
       """SELECT entity_id, year, month,
            CAST(last_day(make_date(year, ((month - 1) // 3 + 1) * 3, 1)) AS VARCHAR) AS quarter_end,
            CAST(last_day(make_date(year, month, 1)) AS VARCHAR) AS month_end FROM production"""))
def q_parse_period_label(fx):
    p = fx.production()
    q_label = F.format_string("%d Quarter %d", "year", F.floor((F.col("month") - 1) / 3).cast("int") + 1)
    m_label = F.concat_ws(" ", F.col("year").cast("string"),
                          F.element_at(F.array(*[F.lit(m) for m in clean._MONTHS]), F.col("month")))
    return p.select("entity_id", "year", "month",
                    clean.parse_period_label(q_label).cast("string").alias("quarter_end"),
                    clean.parse_period_label(m_label).cast("string").alias("month_end"))


# ============================ 2.C joins ====================================

@query("market_summary", "C1", oracle(["summary"], "SELECT * FROM summary", MARKET))
def q_market_summary(fx):
    return fx.market_summary()


@query("full_dataset", "A4 C2 F6 B1", oracle(["combined"], "SELECT * FROM combined",
                                     W6 + ["target_yield", "target_price", "target_production", "month_sin", "month_cos"] + LAGS))
def q_full_dataset(fx):
    return fx.combined()


@query("entities_with_data", "C3", oracle(["dim", "production"],
       "SELECT * FROM dim WHERE entity_id IN (SELECT entity_id FROM production)"))
def q_entities_with_data(fx):
    return joins.entities_with_data(fx.dim(), fx.production())


@query("prod_price_inner", "C4", oracle(["production", "prices"],
       "SELECT p.*, pr.price FROM production p JOIN prices pr USING (entity_id, year, month)", MARKET))
def q_prod_price_inner(fx):
    return joins.inner_merge(fx.production(), fx.prices(), ["entity_id", "year", "month"])


@query("lag_join", "C5 G1", oracle(["weather", "production", "prices", "dim"], _aligned_sql(LAG), W6 + MARKET))
def q_lag_join(fx):
    return corr.aligned_frame(*fx.lag_inputs(START, END), LAG, START, END, fx.dim())


@query("lag_join_0", "C5 G1", oracle(["weather", "production", "prices", "dim"], _aligned_sql(0), W6 + MARKET))
def q_lag_join_0(fx):
    return corr.aligned_frame(*fx.lag_inputs(START, END), 0, START, END, fx.dim())


@query("key_lookup", "C6", oracle([],
       """SELECT s_suppkey, s_name, 'NATION_' || CAST(s_nationkey + 20 AS VARCHAR) AS place, n_nationkey
          FROM supplier JOIN nation ON n_name = 'NATION_' || CAST(s_nationkey + 20 AS VARCHAR)"""))
def q_key_lookup(fx):
    s = fx.t.supplier.select("s_suppkey", "s_name",
                             F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 20).cast("string")).alias("place"))
    return joins.key_lookup(s, fx.t.nation, "place", "n_name", "n_nationkey")


@query("key_lookup_ci", "C7", oracle([],
       """SELECT c.c_custkey, c.sname, c.nname, s.s_suppkey FROM
            (SELECT c_custkey, lower('Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS sname,
                    upper(n_name) || ' ' AS nname
             FROM customer JOIN nation ON c_nationkey = n_nationkey) c
          JOIN (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
            ON lower(trim(c.sname)) = lower(trim(s.s_name)) AND lower(trim(c.nname)) = lower(trim(s.n_name))"""))
def q_key_lookup_ci(fx):
    c = fx.t.customer.join(fx.t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.lower(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("sname"),
        F.concat(F.upper("n_name"), F.lit(" ")).alias("nname"))
    dim = fx.t.supplier.join(fx.t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return joins.key_lookup_ci(c, dim, ["sname", "nname"], ["s_name", "n_name"], "s_suppkey")


@query("seasonal_baseline", "C10 E7", oracle(["features"],
       f"""SELECT f.entity_id, f.year, f.month, f.yield_rate, s.seasonal FROM features f
           LEFT JOIN (SELECT month, avg(yield_rate) AS seasonal FROM features WHERE year <= {TRAIN_END_YEAR} GROUP BY month) s
             ON f.month = s.month WHERE f.year > {TRAIN_END_YEAR}""", ["yield_rate", "seasonal"]))
def q_seasonal_baseline(fx):
    f = fx.market_features()
    stat = rollup.seasonal_mean(f.filter(F.col("year") <= TRAIN_END_YEAR), "yield_rate", out="seasonal")
    test = f.filter(F.col("year") > TRAIN_END_YEAR).select("entity_id", "year", "month", "yield_rate")
    return joins.map_group_stat(test, stat, "month")


# ============================ 2.D reshape ==================================

@query("union_all", "D1", oracle(["prices"],
       "SELECT * FROM prices WHERE year < 1998 UNION ALL SELECT * FROM prices WHERE year >= 1998", ["price"]))
def q_union_all(fx):
    p = fx.prices()
    return clean.union_all(p.filter("year < 1998"), p.filter("year >= 1998"))


@query("dedupe_keep_last", "D2", oracle([],
       """SELECT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS ym, o_orderkey, o_totalprice FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) * 100 + month(o_orderdate)
                                     ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""", ["o_totalprice"]))
def q_dedupe_keep_last(fx):
    o = fx.t.orders.withColumn("ym", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long"))
    return clean.dedupe_keep_last(o, ["o_custkey", "ym"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "ym", "o_orderkey", "o_totalprice")


@query("one_hot", "D5", oracle(["dim"],
       "SELECT entity_id, group_name, " + ", ".join(
           f"CAST(group_name = '{r}' AS DOUBLE) AS \"prov_{r}\"" for r in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
       + " FROM dim", [f'"prov_{r}"' for r in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]]))
def q_one_hot(fx):
    # categories come from the (bounded) region dimension, sorted like get_dummies
    cats = sorted(r[0] for r in fx.t.region.select("r_name").distinct().collect())
    return clean.one_hot(fx.dim().select("entity_id", "group_name"), "group_name", cats, "prov")


@query("top_n", "D7", oracle([],
       """SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank
          FROM supplier QUALIFY rank <= 3""", ["s_acctbal"]))
def q_top_n(fx):
    s = fx.t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal")
    return clean.top_n_per_group(s, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3)


@query("extend_periods", "D10", oracle(["weather", "dim"],
       """SELECT l.entity_id, CAST(o // 12 AS INTEGER) AS year, CAST(o % 12 + 1 AS INTEGER) AS month
          FROM (SELECT entity_id, max(year * 12 + month - 1) AS last FROM weather GROUP BY 1) l,
               LATERAL (SELECT unnest(range(l.last + 1, 2002 * 12 + 5 + 1)) AS o) s"""))
def q_extend_periods(fx):
    targets = fx.dim().select("entity_id", F.lit(2002).alias("year"), F.lit(6).alias("month"))
    return clean.extend_periods(fx.weather(), targets)


# ============================ 2.E rollups ==================================

@query("monthly_rollup", "E1 E2", oracle(["weather"], "SELECT * FROM weather", W6))
def q_monthly_rollup(fx):
    return fx.weather()


_THR = {"extreme_rain_days": ("precipitation_sum", 54.0), "extreme_heat_days": ("temperature_2m_max", 34.0),
        "gusty_days": ("wind_gusts_10m_max", 45.0)}


@query("extreme_days", "E2 B9", oracle(["daily"],
       """SELECT entity_id, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
            CAST(sum(CASE WHEN precipitation_sum >= 54 THEN 1 ELSE 0 END) AS INTEGER) AS extreme_rain_days,
            CAST(sum(CASE WHEN temperature_2m_max >= 34 THEN 1 ELSE 0 END) AS INTEGER) AS extreme_heat_days,
            CAST(sum(CASE WHEN wind_gusts_10m_max >= 45 THEN 1 ELSE 0 END) AS INTEGER) AS gusty_days
          FROM daily GROUP BY 1, 2, 3"""))
def q_extreme_days(fx):
    return rollup.extreme_days(fx.daily(), ["entity_id"], "day", _THR)


_ROLL_VARS = ["precipitation_sum", "temperature_2m_max"]


def _rollup_sql(gran: str, fn: str) -> str:
    f = {"mean": "avg", "max": "max", "min": "min"}[fn]
    if gran == "day":
        b, step = "day", "INTERVAL 1 DAY"
        spine = f"unnest(generate_series(lo, hi, {step}))"
    elif gran == "month":
        b = "last_day(day)"
        spine = "unnest(list_transform(generate_series(0, datediff('month', lo, hi)), lambda i: last_day(lo + to_months(CAST(i AS INTEGER)))))"
    else:
        b = "make_date(year(day), 12, 31)"
        spine = "unnest(list_transform(generate_series(0, year(hi) - year(lo)), lambda i: make_date(CAST(year(lo) + i AS INTEGER), 12, 31)))"
    aggs = ", ".join(f"{f}({v}) AS {v}" for v in _ROLL_VARS)
    return oracle(["daily"], f"""SELECT s.entity_id, CAST(s.period AS VARCHAR) AS period, {', '.join('a.' + v for v in _ROLL_VARS)}
      FROM (SELECT entity_id, CAST({spine} AS DATE) AS period FROM
             (SELECT entity_id, min(period) AS lo, max(period) AS hi FROM
               (SELECT entity_id, CAST({b} AS DATE) AS period FROM daily) GROUP BY 1)) s
      LEFT JOIN (SELECT entity_id, CAST({b} AS DATE) AS period, {aggs} FROM daily GROUP BY 1, 2) a
        ON s.entity_id = a.entity_id AND s.period = a.period""", _ROLL_VARS)


def _make_rollup(gran, fn):
    @query(f"rollup_{gran}_{fn}", "E3", _rollup_sql(gran, fn))
    def _q(fx):
        r = rollup.granular_rollup(fx.daily(), ["entity_id"], "day", _ROLL_VARS, gran, fn)
        return r.withColumn("period", F.col("period").cast("string"))
    return _q


for _g in ("day", "month", "year"):
    for _f in ("mean", "max", "min"):
        _make_rollup(_g, _f)


def _extreme_sql(which):
    order = "DESC" if which == "highest" else "ASC"
    return oracle(["weather"], f"""SELECT * FROM weather WHERE precipitation_sum IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY precipitation_sum {order}, year, month) = 1""", W6)


@query("extreme_highest", "E4", _extreme_sql("highest"))
def q_extreme_highest(fx):
    w = fx.weather().withColumn("_ym", month_ordinal())
    return rollup.extreme_period(w, ["entity_id"], "_ym", "precipitation_sum", "highest").drop("_ym")


@query("extreme_lowest", "E4", _extreme_sql("lowest"))
def q_extreme_lowest(fx):
    w = fx.weather().withColumn("_ym", month_ordinal())
    return rollup.extreme_period(w, ["entity_id"], "_ym", "precipitation_sum", "lowest").drop("_ym")


def _summary_sql():
    parts = []
    for v in W6:
        if "precipitation" in v or "rain" in v or "duration" in v:
            parts.append(f"SELECT entity_id, '{v}' AS variable, 'total' AS stat, {_pr(f'sum({v})', 2)} AS value FROM daily GROUP BY 1")
        if "max" in v:
            parts.append(f"SELECT entity_id, '{v}', 'highest', {_pr(f'max({v})', 2)} FROM daily GROUP BY 1")
        if "min" in v:
            parts.append(f"SELECT entity_id, '{v}', 'lowest', {_pr(f'min({v})', 2)} FROM daily GROUP BY 1")
        if "mean" in v or ("temperature" in v and "max" not in v and "min" not in v):
            parts.append(f"SELECT entity_id, '{v}', 'average', {_pr(f'avg({v})', 2)} FROM daily GROUP BY 1")
    return oracle(["daily"], "\nUNION ALL\n".join(parts), ["value"])


@query("summary_stats", "E5", _summary_sql())
def q_summary_stats(fx):
    return rollup.summary_stats(fx.daily(), ["entity_id"], W6)


@query("climatology", "E6", oracle(["weather"],
       "SELECT entity_id, month, " + ", ".join(f"coalesce(avg({v}), 0.0) AS {v}" for v in W6) + " FROM weather GROUP BY 1, 2", W6))
def q_climatology(fx):
    return rollup.climatology(fx.weather(), ["entity_id"], W6)


@query("dq_counts", "E8", oracle(["summary"],
       """SELECT count(*) AS row_count, count(DISTINCT (entity_id, year, month)) AS distinct_keys,
                 count(DISTINCT entity_id) AS distinct_entities,
                 count(*) FILTER (WHERE price IS NULL) AS null_price,
                 count(*) FILTER (WHERE yield_rate IS NULL) AS null_yield_rate FROM summary"""))
def q_dq_counts(fx):
    return rollup.dq_counts(fx.market_summary(), ["entity_id", "year", "month"], ["price", "yield_rate"], "entity_id")


@query("latency_stats", "E9", oracle([],
       """SELECT event_type, count(*) AS n, avg(value) AS mean,
            (list_sort(list(value)))[count(*) // 2 + 1] AS median,
            CASE WHEN count(*) >= 20 THEN (list_sort(list(value)))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1]
                 ELSE max(value) END AS p95
          FROM events WHERE value IS NOT NULL GROUP BY event_type""", ["mean", "median", "p95"]))
def q_latency_stats(fx):
    return rollup.latency_stats(fx.t.events, ["event_type"], "value")


@query("mean_positive", "E10", oracle([],
       "SELECT event_type, coalesce(avg(CASE WHEN value - 50 > 0 THEN value - 50 END), 0.0) AS mean_positive FROM events GROUP BY 1",
       ["mean_positive"]))
def q_mean_positive(fx):
    return rollup.mean_positive(fx.t.events.withColumn("v", F.col("value") - 50), ["event_type"], "v")


@query("success_rate", "E11", oracle([],
       "SELECT event_type, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) * 100 AS success_rate FROM events GROUP BY 1",
       ["success_rate"]))
def q_success_rate(fx):
    return rollup.success_rate(fx.t.events.withColumn("ok", F.col("value") > 50), ["event_type"], "ok")


_METRICS = ["YIELD", "PRODUCTION", "PRICE"]


@query("outcome_lookup", "E12", oracle(["dim", "production", "prices"],
       """SELECT r.request_id, r.entity_id, r.metric,
            CASE r.metric WHEN 'YIELD' THEN sum(p.volume) / NULLIF(sum(p.area), 0)
                          WHEN 'PRODUCTION' THEN sum(p.volume) ELSE avg(pr.price) END AS value
          FROM (SELECT entity_id * 10 + m.i AS request_id, entity_id, m.metric FROM dim,
                (SELECT 1 AS i, 'YIELD' AS metric UNION ALL SELECT 2, 'PRODUCTION' UNION ALL SELECT 3, 'PRICE') m) r
          LEFT JOIN production p ON r.metric <> 'PRICE' AND p.entity_id = r.entity_id
               AND make_date(p.year, p.month, 1) BETWEEN DATE '1997-04-01' AND DATE '1998-03-31'
          LEFT JOIN prices pr ON r.metric = 'PRICE' AND pr.entity_id = r.entity_id
               AND make_date(pr.year, pr.month, 1) BETWEEN DATE '1997-04-01' AND DATE '1998-03-31'
          GROUP BY 1, 2, 3""", ["value"]))
def q_outcome_lookup(fx):
    m = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(x).alias("metric")) for i, x in enumerate(_METRICS)]))
    req = (fx.dim().select("entity_id", m.alias("m"))
           .select((F.col("entity_id") * 10 + F.col("m.i")).cast("long").alias("request_id"), "entity_id",
                   F.col("m.metric").alias("metric"), F.lit("1997-04-15").alias("start_date"),
                   F.lit("1998-03-31").alias("end_date")))
    return rollup.outcome_lookup(req, fx.production(), fx.prices())


# ============================ 2.F windows ==================================

def _win_sql(select_extra: str, base: str = "weather") -> str:
    return f"SELECT *, {select_extra} FROM {base} WINDOW w AS (PARTITION BY entity_id ORDER BY year, month)"


@query("lag_features", "F1", oracle(["features"], "SELECT * FROM features", MARKET + LAGS))
def q_lag_features(fx):
    return fx.market_features()


_LAG_COLS = [f"{v}_lag{k}" for v in W8 for k in range(1, 5)]


@query("antecedent_lags", "F2", oracle(["weather"], _win_sql(", ".join(
    f"LAG({v}, {k}) OVER w AS {v}_lag{k}" for v in W8 for k in range(1, 5))),
    W6 + [c for c in _LAG_COLS if not c.startswith("extreme")]))
def q_antecedent_lags(fx):
    return feat.antecedent_lags(fx.weather(), W8)


def _is_sum(v, extra=("et0",)):
    return "sum" in v or "days" in v or any(t in v for t in extra)


@query("growing_season", "F3", oracle(["weather"], _win_sql(", ".join(
    f"CASE WHEN count({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN CAST("
    f"{'sum' if _is_sum(v) else 'avg'}({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS DOUBLE) END AS {v}_gs" for v in W8)),
    W6 + [f"{v}_gs" for v in W8]))
def q_growing_season(fx):
    return feat.growing_season(fx.weather(), W8)


def _trail_sql():
    cols = []
    for v in W8:
        cols.append(f"{v} AS {v}_1m")
        for n in (2, 3):
            fn = "sum" if _is_sum(v, ()) else "avg"
            cols.append(f"CASE WHEN count({v}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN CAST("
                        f"{fn}({v}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) END AS {v}_{n}m")
    return _win_sql(", ".join(cols))


@query("trailing_windows", "F4", oracle(["weather"], _trail_sql(),
                                        W6 + [f"{v}_1m" for v in W6] + [f"{v}_{n}m" for v in W8 for n in (2, 3)]))
def q_trailing_windows(fx):
    return feat.trailing_windows(fx.weather(), W8)


@query("season_interaction", "F5 B10", oracle(["weather"], "SELECT *, CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS is_wet, "
       "precipitation_sum_gs * CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS precipitation_sum_gs_wet, "
       "soil_moisture_0_to_100cm_mean_gs * CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS soil_moisture_0_to_100cm_mean_gs_wet FROM ("
       + _win_sql(", ".join(
           f"CASE WHEN count({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN "
           f"{'sum' if _is_sum(v) else 'avg'}({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS {v}_gs"
           for v in ["precipitation_sum", "soil_moisture_0_to_100cm_mean"])) + ")",
       W6 + ["precipitation_sum_gs", "soil_moisture_0_to_100cm_mean_gs", "precipitation_sum_gs_wet",
             "soil_moisture_0_to_100cm_mean_gs_wet"]))
def q_season_interaction(fx):
    g = feat.growing_season(fx.weather(), ["precipitation_sum", "soil_moisture_0_to_100cm_mean"])
    return feat.season_interaction(g)


@query("cyclical_month", "F6", oracle(["production"],
       "SELECT entity_id, year, month, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos FROM production",
       ["month_sin", "month_cos"]))
def q_cyclical_month(fx):
    return feat.with_cyclical_month(fx.production().select("entity_id", "year", "month"))


@query("ffill_bfill", "F7", oracle(["summary"], _win_sql(
    "coalesce(last_value(price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(price IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price_filled", "summary"),
    MARKET + ["price_filled"]))
def q_ffill_bfill(fx):
    s = fx.market_summary().withColumn("price_filled", F.col("price"))
    return feat.ffill_bfill(s, ["price_filled"])


_TARGETS = [(1999, 6), (2001, 11), (2003, 1)]


@query("target_or_last", "F8", oracle(["summary"],
       """SELECT s.entity_id, s.year, s.month, s.volume, t.ty AS target_year, t.tm AS target_month,
                 NOT (s.year = t.ty AND s.month = t.tm) AS is_fallback
          FROM summary s JOIN (SELECT * FROM (VALUES (1999, 6), (2001, 11), (2003, 1)) v(ty, tm)) t ON TRUE
          QUALIFY row_number() OVER (PARTITION BY s.entity_id, t.ty, t.tm
              ORDER BY CAST(s.year = t.ty AND s.month = t.tm AS INTEGER) DESC, s.year DESC, s.month DESC) = 1""",
       ["volume"]))
def q_target_or_last(fx):
    t = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in _TARGETS]))
    targets = fx.dim().select("entity_id", t.alias("t")).select("entity_id", "t.year", "t.month")
    s = fx.market_summary().select("entity_id", "year", "month", "volume")
    return feat.target_or_last(s, targets)


def _complete_quarters(fx):
    p = fx.production()
    qtr = p.groupBy("entity_id", "year", F.floor((F.col("month") - 1) / 3).cast("int").alias("_q0")).agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"))
    # complete quarters only (each of the 3 months present), quarters numbered 1..4
    return qtr.filter("_n = 3").select("entity_id", "year", (F.col("_q0") + 1).alias("quarter"), "volume")


@query("disaggregate", "F9")
def q_disaggregate(fx):
    return feat.disaggregate(_complete_quarters(fx), ["entity_id"], "volume")


@query("disaggregate_check", "F9", oracle(["production"], """SELECT entity_id, year, quarter, volume, 0 AS sum_off, 0 AS stationarity_off FROM (
       SELECT entity_id, year, (month - 1) // 3 + 1 AS quarter, sum(volume) AS volume, count(*) AS n
       FROM production GROUP BY ALL) WHERE n = 3""", ["volume"]))
def q_disaggregate_check(fx):
    """Every quarter, and whether its months miss its total or the optimality condition by over 1e-9 of the largest total."""
    q = _complete_quarters(fx)
    told = feat.disaggregation_errors(feat.disaggregate(q, ["entity_id"], "volume"), q, ["entity_id"], "volume")
    off = lambda c: (F.col(c) > F.max("volume").over(Window.partitionBy("entity_id")) * 1e-9).cast("int")
    return told.select("entity_id", "year", "quarter", "volume", off("sum_error").alias("sum_off"),
                       off("stationarity_error").alias("stationarity_off"))


@query("month_ordinal", "F10", oracle(["production"],
       """SELECT entity_id, year, month, year * 12 + month - 1 AS ym,
                 CAST((year * 12 + month) // 12 AS INTEGER) AS next_year, CAST((year * 12 + month) % 12 + 1 AS INTEGER) AS next_month
          FROM production"""))
def q_month_ordinal(fx):
    ny, nm = feat.next_month()
    return fx.production().select("entity_id", "year", "month", month_ordinal().alias("ym"),
                                  ny.alias("next_year"), nm.alias("next_month"))


# ============================ 2.G correlation ==============================

def _corr_matrix_sql(group: bool, lag: int = LAG) -> str:
    key = "entity_name, " if group else ""
    gb = " GROUP BY entity_name" if group else ""
    parts = [f"SELECT {key}'{v}' AS weather_variable, " +
             ", ".join(f"corr({v}, {OCOL[o]}) AS {o}" for o in OUTCOMES) + f" FROM aligned{gb}" for v in W6]
    return oracle(["weather", "production", "prices", "dim"], "\nUNION ALL\n".join(parts), OUTCOMES,
                  extra=[f"aligned AS ({_aligned_sql(lag)})"])


@query("corr_pooled", "G2 D4", _corr_matrix_sql(False))
def q_corr_pooled(fx):
    al = corr.aligned_frame(*fx.lag_inputs(START, END), LAG, START, END)
    return corr.corr_pooled(al, W6, OUTCOMES)


@query("corr_by_entity", "G3 D4", _corr_matrix_sql(True))
def q_corr_by_entity(fx):
    al = corr.aligned_frame(*fx.lag_inputs(START, END), LAG, START, END, fx.dim())
    return corr.corr_by_entity(al, W6, OUTCOMES)


def _corr_long_body(keys: list[str], source: str) -> str:
    k = ", ".join(keys)
    return "\nUNION ALL\n".join(f"""SELECT {k}, '{v}' AS weather_variable, '{o}' AS outcome,
                 count(*) FILTER (WHERE {v} IS NOT NULL AND {OCOL[o]} IS NOT NULL) AS n,
                 CASE WHEN count(*) FILTER (WHERE {v} IS NOT NULL AND {OCOL[o]} IS NOT NULL) >= 2
                      THEN corr({v}, {OCOL[o]}) END AS r
               FROM {source} GROUP BY {k}""" for v in W6 for o in OUTCOMES)


def _corr_long_sql(keys: list[str], source: str, extra: list[str]) -> str:
    return oracle(["weather", "production", "prices", "dim"], _corr_long_body(keys, source), ["r"], extra=extra)


_LAG_SCAN_CTE = ("aligned AS (" + _aligned_sql(0, "1900-01-01", "2999-12-31", lag_expr="lg.lag",
                                               extra_from=", (SELECT unnest(range(0, 7)) AS lag) lg")
                 .replace("SELECT w.*", "SELECT w.*, lg.lag", 1) + ")")


@query("corr_detailed", "G4", _corr_long_sql(["entity_name", "lag"], "aligned",
                                             [f"aligned AS (SELECT *, {LAG} AS lag FROM ({_aligned_sql(LAG)}))"]))
def q_corr_detailed(fx):
    obs, coeffs = corr.corr_detailed(*fx.lag_inputs(START, END), W6, OUTCOMES, START, END, fx.dim(), LAG)
    return coeffs


@query("corr_observations", "G4", oracle(["weather", "production", "prices", "dim"], f"SELECT *, {LAG} AS lag FROM ({_aligned_sql(LAG)})", W6 + MARKET))
def q_corr_observations(fx):
    """The observations behind corr_detailed's coefficients."""
    obs, _ = corr.corr_detailed(*fx.lag_inputs(START, END), W6, OUTCOMES, START, END, fx.dim(), LAG)
    return obs.withColumn("lag", F.lit(LAG))


@query("corr_lag_scan", "G5", _corr_long_sql(["lag", "entity_name"], "aligned", [_LAG_SCAN_CTE]))
def q_corr_lag_scan(fx):
    return corr.corr_lag_scan(fx.weather(), fx.production(), fx.prices(), W6, OUTCOMES, range(0, 7),
                              entities=fx.dim())


@query("corr_strongest_lag", "G5 E4", oracle(
    ["weather", "production", "prices", "dim"],
    """SELECT * FROM scan WHERE r IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY entity_name, weather_variable, outcome ORDER BY abs(r) DESC, lag) = 1""",
    ["r"], extra=[_LAG_SCAN_CTE, "scan AS (" + _corr_long_body(["lag", "entity_name"], "aligned") + ")"]))
def q_corr_strongest_lag(fx):
    scan = corr.corr_lag_scan(fx.weather(), fx.production(), fx.prices(), W6, OUTCOMES, range(0, 7), entities=fx.dim())
    return corr.strongest_lag(scan, ["entity_name"])


@query("parse_period", "G6", oracle([],
       """SELECT o_orderkey,
            CASE WHEN regexp_matches(trim(CAST(year(o_orderdate) AS VARCHAR)), '^\\d{4}$')
                 THEN trim(CAST(year(o_orderdate) AS VARCHAR)) || '-01-01' ELSE '1995-01-01' END AS start_date,
            '2001-07-31' AS end_date,
            CASE WHEN regexp_matches(trim(o_orderpriority), '^\\d{4}$') THEN trim(o_orderpriority) || '-01-01'
                 ELSE '1995-01-01' END AS start_date_2
          FROM orders"""))
def q_parse_period(fx):
    o = fx.t.orders.select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), "o_orderpriority")
    s1, e1 = corr.parse_period("y", "1995-01-01", "2001-07-31")
    s2, _ = corr.parse_period("o_orderpriority", "1995-01-01", "2001-07-31")
    return o.select("o_orderkey", s1, e1, s2.alias("start_date_2"))
