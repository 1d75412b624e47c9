"""Independent DuckDB SQL for the fixture views (the correctness oracle).

Each CTE restates a fixture view of ``fixtures.py`` in plain SQL over the raw
tables; the per-query SQL in ``catalog.py`` is composed from them.
"""

from __future__ import annotations

CTE = {
    "dim": """dim AS (
  SELECT n_nationkey AS entity_id, n_name AS entity_name, r_name AS group_name
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "ship": """ship AS (
  SELECT l.*, s.s_nationkey AS entity_id FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)""",
    "daily": """daily AS (
  SELECT entity_id, CAST(l_shipdate AS DATE) AS day,
         sum(l_quantity) AS precipitation_sum, avg(l_extendedprice) AS temperature_2m_mean,
         max(l_extendedprice) AS temperature_2m_max, min(l_extendedprice) AS temperature_2m_min,
         max(l_quantity) AS wind_gusts_10m_max, avg(l_discount) AS soil_moisture_0_to_100cm_mean
  FROM ship GROUP BY 1, 2)""",
    "weather": """weather AS (
  SELECT entity_id, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
         sum(precipitation_sum) AS precipitation_sum, avg(temperature_2m_mean) AS temperature_2m_mean,
         avg(temperature_2m_max) AS temperature_2m_max, avg(temperature_2m_min) AS temperature_2m_min,
         max(wind_gusts_10m_max) AS wind_gusts_10m_max,
         avg(soil_moisture_0_to_100cm_mean) AS soil_moisture_0_to_100cm_mean,
         CAST(sum(CASE WHEN precipitation_sum >= 54 THEN 1 ELSE 0 END) AS INTEGER) AS extreme_rain_days,
         CAST(sum(CASE WHEN temperature_2m_max >= 34 THEN 1 ELSE 0 END) AS INTEGER) AS extreme_heat_days
  FROM daily GROUP BY 1, 2, 3)""",
    "production": """production AS (
  SELECT entity_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         sum(l_quantity) AS volume, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS area,
         sum(l_quantity) / NULLIF(CAST(count(DISTINCT l_orderkey) AS DOUBLE), 0) AS yield_rate
  FROM ship GROUP BY 1, 2, 3)""",
    "prices": """prices AS (
  SELECT c_nationkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
    "summary": """summary AS (
  SELECT p.entity_id, d.entity_name, d.group_name, p.year, p.month, p.volume, p.area, p.yield_rate, pr.price
  FROM production p JOIN dim d ON p.entity_id = d.entity_id
  LEFT JOIN prices pr ON p.entity_id = pr.entity_id AND p.year = pr.year AND p.month = pr.month)""",
    "features": """features AS (
  SELECT *, LAG(price, 1) OVER w AS price_lag1, LAG(price, 12) OVER w AS price_lag12,
         LAG(yield_rate, 1) OVER w AS yield_lag1, LAG(yield_rate, 12) OVER w AS hist_yield,
         LAG(volume, 1) OVER w AS production_lag1, LAG(price, 12) OVER w AS hist_price
  FROM summary WINDOW w AS (PARTITION BY entity_id ORDER BY year, month))""",
    "combined": """combined AS (
  SELECT w.*, d.entity_name, d.group_name,
         m.yield_rate AS target_yield, m.price AS target_price, m.volume AS target_production,
         m.price_lag1, m.price_lag12, m.yield_lag1, m.hist_yield, m.production_lag1, m.hist_price,
         sin(2 * pi() * w.month / 12) AS month_sin, cos(2 * pi() * w.month / 12) AS month_cos
  FROM weather w JOIN dim d ON w.entity_id = d.entity_id
  LEFT JOIN features m ON d.entity_name = m.entity_name AND w.year = m.year AND w.month = m.month
  WHERE w.year >= 1994)""",
}

W8 = ["precipitation_sum", "temperature_2m_mean", "temperature_2m_max", "temperature_2m_min",
      "wind_gusts_10m_max", "soil_moisture_0_to_100cm_mean", "extreme_rain_days", "extreme_heat_days"]


def _gs(v):
    fn = "sum" if ("sum" in v or "days" in v or "et0" in v) else "avg"
    return (f"CASE WHEN count({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN "
            f"CAST({fn}({v}) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS DOUBLE) END AS {v}_gs")


CTE["panel0"] = ("panel0 AS (SELECT *, " + ", ".join(f"LAG({v}, {k}) OVER w AS {v}_lag{k}" for v in W8 for k in range(1, 5))
                 + ", " + ", ".join(_gs(v) for v in W8)
                 + " FROM combined WINDOW w AS (PARTITION BY entity_id ORDER BY year, month))")
CTE["panel"] = """panel AS (SELECT *, CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS is_wet,
  precipitation_sum_gs * CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS precipitation_sum_gs_wet,
  soil_moisture_0_to_100cm_mean_gs * CAST(month IN (6, 7, 8, 9, 10, 11) AS INTEGER) AS soil_moisture_0_to_100cm_mean_gs_wet
  FROM panel0)"""

DEPS = {
    "panel0": ["combined"], "panel": ["panel0"],
    "dim": [], "ship": [], "daily": ["ship"], "weather": ["daily"], "production": ["ship"],
    "prices": [], "summary": ["production", "dim", "prices"], "features": ["summary"],
    "combined": ["weather", "dim", "features"],
}


def with_ctes(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named CTEs and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def r4(cols: list[str], digits: int = 4) -> str:
    """``* REPLACE`` list normalising doubles exactly like ``catalog.finish``."""
    if not cols:
        return "*"
    scale = 10 ** digits
    rep = ", ".join(f"(CASE WHEN isnan({c}) THEN NULL ELSE "
                    f"CAST(floor(round(CAST({c} AS DOUBLE), 8) * {scale}.0 + 0.5) AS DOUBLE) / {scale}.0 END) AS {c}"
                    for c in cols)
    return f"* REPLACE ({rep})"


def oracle(ctes: list[str], body: str, dbl: list[str] | None = None, extra: list[str] | None = None) -> str:
    """Full oracle statement: CTEs, then ``body`` with its doubles rounded."""
    return f"{with_ctes(*ctes, extra=extra)}SELECT {r4(dbl or [])} FROM (\n{body}\n) q"
