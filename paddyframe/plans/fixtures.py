"""Fixture views V1d-V7: bind the panel operators to the benchmark tables.

entity = nation (``entity_id`` = nation key, ``entity_name`` = nation name,
``group_name`` = region name); period = (year, month) of the ship / order date.

V1d daily "weather"   lineitem x supplier per (nation, ship day)
V1  monthly weather   E1 + E2 over V1d
V2  production fact   lineitem x supplier per (nation, year, month)
V3  price fact        orders x customer per (nation, year, month)
V4  market features   C1 then F1 over V2, V3, nation, region
V5  training panel    V1 x V4 (C2) + F2..F6
V7  place hierarchy   region > nation > supplier

Facts take the months that a query needs, and put them on the date of the scanned table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..operators import features as feat
from ..operators import joins, rollup
from ..operators.clean import Months
from ..sources.tables import Tables

DAILY_VARS = ["precipitation_sum", "temperature_2m_mean", "temperature_2m_max",
              "temperature_2m_min", "wind_gusts_10m_max", "soil_moisture_0_to_100cm_mean"]
MONTHLY_VARS = DAILY_VARS + ["extreme_rain_days", "extreme_heat_days"]
TRAIN_END_YEAR = 1999      # fixture temporal split: train <= 1999, test >= 2000
PANEL_START_YEAR = 1996
ALL = Months()


class Fixtures:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.t = Tables(spark, base)

    # ---- dimensions -----------------------------------------------------
    def dim(self) -> DataFrame:
        """Entity dimension: nation joined to its region (25 rows in TPC-H)."""
        n, r = self.t.nation, self.t.region
        return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
            F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name"),
            F.col("r_name").alias("group_name"))

    # ---- facts ----------------------------------------------------------
    def _ship(self, months: Months = ALL) -> DataFrame:
        li, s = months.rows(self.t.lineitem, "l_shipdate"), self.t.supplier
        return li.join(s, li.l_suppkey == s.s_suppkey, "inner").withColumnRenamed("s_nationkey", "entity_id")

    def daily(self, months: Months = ALL) -> DataFrame:
        """V1d: one row per (entity, day)."""
        return (self._ship(months).groupBy("entity_id", F.to_date("l_shipdate").alias("day"))
                .agg(F.sum("l_quantity").alias("precipitation_sum"),
                     F.avg("l_extendedprice").alias("temperature_2m_mean"),
                     F.max("l_extendedprice").alias("temperature_2m_max"),
                     F.min("l_extendedprice").alias("temperature_2m_min"),
                     F.max("l_quantity").alias("wind_gusts_10m_max"),
                     F.avg("l_discount").alias("soil_moisture_0_to_100cm_mean")))

    def weather(self, months: Months = ALL) -> DataFrame:
        """V1: monthly rollup of V1d (E1 + E2)."""
        return rollup.monthly_rollup(self.daily(months), ["entity_id"], "day", DAILY_VARS)

    def production(self, months: Months = ALL) -> DataFrame:
        """V2: volume, area, yield per (entity, year, month)."""
        d = self._ship(months)
        agg = (d.groupBy("entity_id", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
               .agg(F.sum("l_quantity").alias("volume"),
                    F.count_distinct("l_orderkey").cast("double").alias("area")))
        return agg.withColumn("yield_rate", safe_ratio("volume", "area"))

    def prices(self, months: Months = ALL) -> DataFrame:
        """V3: average order price per (entity, year, month)."""
        o, c = months.rows(self.t.orders, "o_orderdate"), self.t.customer
        d = o.join(c, o.o_custkey == c.c_custkey, "inner")
        return (d.groupBy(F.col("c_nationkey").alias("entity_id"), F.year("o_orderdate").alias("year"),
                          F.month("o_orderdate").alias("month"))
                .agg(F.avg("o_totalprice").alias("price")))

    # ---- views ----------------------------------------------------------
    def market_summary(self, months: Months = ALL) -> DataFrame:
        return joins.market_summary(self.production(months), self.dim(), self.prices(months))

    def market_features(self, end: tuple[int, int] | None = None) -> DataFrame:
        """V4: C1 + row-based lags per entity ordered by (year, month).  Lags look back over any number of months, so
        only an end bounds the scans."""
        return feat.lag_features(self.market_summary(Months(end=end)), feat.MARKET_LAGS)

    def lag_inputs(self, start_date: str, end_date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Weather of the months, production and prices of the whole years of a lag-aligned frame."""
        years = Months.years(int(start_date[:4]), int(end_date[:4]))
        return self.weather(Months.dates(start_date, end_date)), self.production(years), self.prices(years)

    def combined(self, start_year: int = PANEL_START_YEAR - 1) -> DataFrame:
        """Training query: weather INNER dim LEFT V4 by entity name, period filter, cyclical month."""
        w = self.weather(Months.years(start_year))
        v4 = self.market_features().select(
            "entity_name", "year", "month",
            F.col("yield_rate").alias("target_yield"), F.col("price").alias("target_price"),
            F.col("volume").alias("target_production"), *feat.MARKET_LAGS.keys())
        df = joins.full_dataset(w, self.dim(), v4, by="entity_name")
        return feat.with_cyclical_month(df)

    def panel(self) -> DataFrame:
        """V5: combined + antecedent lags, growing season, season interaction."""
        df = self.combined()
        df = feat.antecedent_lags(df, MONTHLY_VARS)
        df = feat.growing_season(df, MONTHLY_VARS)
        return feat.season_interaction(df)

    def ridge_panel(self) -> DataFrame:
        """Combined + trailing 1 / 2 / 3 month windows: the design of the Ridge models."""
        return feat.trailing_windows(self.combined(), MONTHLY_VARS)

    def places(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """V7: three-level hierarchy (region > nation > supplier) as (l1, l2, l3)."""
        l1 = self.t.region.select(F.col("r_regionkey").cast("long").alias("l1_id"), F.col("r_name").alias("l1_name"))
        l2 = self.t.nation.select(F.col("n_nationkey").cast("long").alias("l2_id"), F.col("n_name").alias("l2_name"),
                                  F.col("n_regionkey").cast("long").alias("l1_id"))
        l3 = self.t.supplier.select(F.col("s_suppkey").alias("l3_id"), F.col("s_name").alias("l3_name"),
                                    F.col("s_nationkey").cast("long").alias("l2_id"))
        return l1, l2, l3
