"""Projections, filters, predicates (2.B) and reshape / dedupe / sort (2.D)."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_contains, clean_missing, col_, month_ordinal

# --- fixed values: words that route a question to literature retrieval ------
EXPLANATION_KEYWORDS = ["why", "explain", "how does", "interpretation", "interpret", "reason", "impact"]
# ---------------------------------------------------------------------------


# ---- 2.B -----------------------------------------------------------------

@dataclass(frozen=True)
class Months:
    """Whole months from the first of ``start`` (year, month) to the end of ``end``; None leaves a side open.

    ``year`` and ``month`` of a fact are computed from a date, so a bound on them reaches no scan.  ``rows`` puts the same
    bound on the date itself, as a range of literals that the scan uses to skip files and row groups.  It keeps
    exactly the rows of those months, so what is grouped by month is whole; rows without a date belong to no month
    and go where a side is bounded, as they do when years are compared.
    """
    start: tuple[int, int] | None = None
    end: tuple[int, int] | None = None

    @classmethod
    def years(cls, first: int | None = None, last: int | None = None) -> Months:
        return cls((first, 1) if first is not None else None, (last, 12) if last is not None else None)

    @classmethod
    def dates(cls, start: str, end: str) -> Months:
        """From the month of one ISO date to that of another."""
        return cls(*((int(d[:4]), int(d[5:7])) for d in (start, end)))

    def rows(self, df: DataFrame, date_col: str) -> DataFrame:
        if self.start is not None:
            df = df.filter(F.col(date_col) >= F.lit(datetime.date(*self.start, 1)))
        if self.end is not None:
            year, month = self.end
            df = df.filter(F.col(date_col) < F.lit(datetime.date(year + month // 12, month % 12 + 1, 1)))
        return df


def period_filter(df: DataFrame, start_year: int | None = None, end_year: int | None = None,
                  end_month: int | None = None, year_col: str = "year", month_col: str = "month") -> DataFrame:
    """``year >= start AND (year < Y OR (year = Y AND month <= M))`` (B2)."""
    cond = F.lit(True)
    if start_year is not None:
        cond = cond & (F.col(year_col) >= start_year)
    if end_year is not None:
        if end_month is None:
            cond = cond & (F.col(year_col) <= end_year)
        else:
            cond = cond & ((F.col(year_col) < end_year)
                           | ((F.col(year_col) == end_year) & (F.col(month_col) <= end_month)))
    return df.filter(cond)


def year_between(df: DataFrame, start_date: str, end_date: str, year_col: str = "year") -> DataFrame:
    """Years taken from the first 4 characters of two date strings, ``year BETWEEN``."""
    return df.filter(F.col(year_col).between(int(start_date[:4]), int(end_date[:4])))


def drop_any_missing(long_df: DataFrame, period_col: str, value_col: str) -> DataFrame:
    """Drop a whole period when any series is missing in it (B6, production rule)."""
    bad = (long_df.groupBy(period_col).agg(F.bool_or(F.col(value_col).isNull()).alias("_bad"))
           .filter("_bad").select(period_col))
    return long_df.join(bad, on=period_col, how="left_anti")


def drop_cell_missing(long_df: DataFrame, value_col: str) -> DataFrame:
    """Drop only the missing cells (B6, price rule)."""
    return long_df.dropna(subset=[value_col])


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with no NULL in any (or the given) column."""
    return df.dropna(how="any", subset=cols)


def validate_vars(requested, allowed: list[str], all_token: str = "ALL"):
    """Variable allow-list (B11): returns (validated, discarded) array columns.

    ``ALL`` expands to ``allowed``; invalid names are discarded (order and
    duplicates kept); an empty result falls back to ``allowed``.
    """
    req = F.coalesce(col_(requested), F.array().cast("array<string>"))
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    kept = F.filter(req, lambda x: F.array_contains(allowed_arr, x))
    dropped = F.when(F.array_contains(req, all_token), F.array().cast("array<string>")) \
        .otherwise(F.filter(req, lambda x: ~F.array_contains(allowed_arr, x)))
    validated = F.when(F.array_contains(req, all_token), allowed_arr) \
        .when(F.size(kept) == 0, allowed_arr).otherwise(kept)
    return validated.alias("validated"), dropped.alias("discarded")


def enum_map(codes, mapping: dict, default_all: bool = True):
    """Enum codes -> column names through a literal map (B12); unknown dropped, empty -> all."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.filter(F.transform(F.coalesce(col_(codes), F.array().cast("array<string>")),
                                  lambda c: F.element_at(m, c)), lambda x: x.isNotNull())
    every = F.array(*[F.lit(v) for v in mapping.values()])
    return F.when(F.size(mapped) == 0, every).otherwise(mapped) if default_all else mapped


def keyword_flag(c, keywords=EXPLANATION_KEYWORDS):
    """Any keyword is a substring of the lower-cased text."""
    return any_contains(c, keywords)


_MONTHS = "January February March April May June July August September October November December".split()


def parse_period_label(c):
    """``2012 Quarter 1`` -> quarter end; ``2012 January`` -> month end (B14). Returns a date."""
    c = F.trim(col_(c))
    q = F.regexp_extract(c, r"^(\d{4}) Quarter ([1-4])$", 2)
    y = F.regexp_extract(c, r"^(\d{4})", 1)
    mname = F.regexp_extract(c, r"^\d{4} ([A-Za-z]+)$", 1)
    mmap = F.create_map(*[x for i, m in enumerate(_MONTHS) for x in (F.lit(m.lower()), F.lit(i + 1))])
    month = F.when(q != "", q.cast("int") * 3).otherwise(F.element_at(mmap, F.lower(mname)))
    return F.when(y != "", F.last_day(F.make_date(y.cast("int"), month, F.lit(1))))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remaining NULL features -> 0.0."""
    return df.fillna(0.0, subset=cols)


# ---- 2.D -----------------------------------------------------------------

def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_keep_last(df: DataFrame, keys: list[str], precedence_cols) -> DataFrame:
    """Keep one row per key, the one with the highest precedence.

    ``row_number() = 1`` is planned with a partial group limit before the
    shuffle, so a hot key ships one candidate per task.
    """
    if isinstance(precedence_cols, str):
        precedence_cols = [precedence_cols]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in precedence_cols])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def wide_to_long(df: DataFrame, ids: list[str], value_cols: list[str], var_name: str = "series",
                 value_name: str = "value", drop_nulls: bool = True) -> DataFrame:
    """Wide -> long (D3); NULL cells dropped like a pandas ``stack``."""
    out = df.unpivot(ids, value_cols, var_name, value_name)
    return out.filter(F.col(value_name).isNotNull()) if drop_nulls else out


def wide_csv_to_long(raw: DataFrame, label_col: str, period_cols: list[str], var_name: str = "period",
                     value_name: str = "value") -> DataFrame:
    """Statistical wide table -> long cleaned cells (A2 + B5 + D3 + B7).

    Series labels lose their leading/trailing dots; ``..`` cells become NULL
    (dropping them is the caller's rule, B6); values are parsed leniently.
    """
    named = raw.withColumn(label_col, F.expr(f"btrim(`{label_col}`, '.')"))
    long = named.unpivot([label_col], period_cols, var_name, "_raw")
    return long.withColumn(value_name, clean_missing("_raw").try_cast("double")).drop("_raw")


def one_hot(df: DataFrame, col: str, categories: list[str], prefix: str = "prov") -> DataFrame:
    """0/1 double column per category, named ``{prefix}_{value}``."""
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("double") for v in categories})


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top-n rows per group (D7, D8), ``row_number <= n`` (partial group limit before the shuffle)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def extend_periods(panel: DataFrame, targets: DataFrame, entity_col: str = "entity_id") -> DataFrame:
    """Append the months after an entity's last row up to each target period.

    Returns (entity, year, month) rows of the missing calendar months; the
    spine is bounded by the requested horizon.
    """
    last = panel.groupBy(entity_col).agg(F.max(month_ordinal("year", "month")).alias("_last"))
    tgt = (targets.select(entity_col, month_ordinal("year", "month").alias("_tgt"))
           .groupBy(entity_col).agg(F.max("_tgt").alias("_tgt")))
    j = last.join(tgt, on=entity_col, how="inner").filter(F.col("_tgt") > F.col("_last"))
    o = F.explode(F.sequence(F.col("_last") + 1, F.col("_tgt")))
    return (j.select(entity_col, o.alias("_o"))
            .select(entity_col, F.floor(F.col("_o") / 12).cast("int").alias("year"),
                    (F.pmod(F.col("_o"), F.lit(12)) + 1).cast("int").alias("month")))
