"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(col_(num), col_(den))


def ci_equals(c, value: str) -> Column:
    """Case-insensitive equality on trimmed strings."""
    return F.lower(F.trim(col_(c))) == F.lower(F.trim(F.lit(value)))


def clean_missing(c, marker_regex: str = r"^\.+$") -> Column:
    """Cells that only hold a missing marker (``..``) become NULL."""
    c = col_(c)
    return F.when(F.trim(c).rlike(marker_regex), F.lit(None).cast("string")).otherwise(c)


def coerce_numeric(c) -> Column:
    """String to double, unparseable -> NULL (B7; plain cast raises under ANSI)."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def threshold_flag(c, threshold: float) -> Column:
    """0/1 flag ``c >= threshold`` (B9); NULL input gives 0 like a pandas comparison."""
    return F.coalesce((col_(c) >= F.lit(threshold)).cast("int"), F.lit(0))


def member_flag(c, values) -> Column:
    """0/1 set-membership flag."""
    return col_(c).isin(list(values)).cast("int")


def month_ordinal(year="year", month="month", offset: int = 0) -> Column:
    """``year*12 + month-1 (+offset)``."""
    return col_(year) * 12 + col_(month) - 1 + F.lit(offset)


def ordinal_year(ordinal) -> Column:
    return F.floor(col_(ordinal) / 12).cast("int")


def ordinal_month(ordinal) -> Column:
    return (F.pmod(col_(ordinal), F.lit(12)) + 1).cast("int")


def period_label(year="year", month="month") -> Column:
    """``YYYY-MM`` label."""
    return F.format_string("%d-%02d", col_(year), col_(month))


def cyclical_month(month="month", period: int = 12) -> tuple[Column, Column]:
    """sin/cos encoding of the calendar month."""
    angle = F.lit(2.0) * F.pi() * col_(month).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def any_contains(c, phrases, lower: bool = True) -> Column:
    """True when any phrase is a substring of ``c``.

    An OR-chain of ``contains`` keeps the check inside whole-stage codegen
    (higher-order lambdas are interpreted), and the lower-cased text is a common
    subexpression evaluated once per row.  Phrases sharing a first word are
    tested only when that word occurs (an exact prefilter: the word is a prefix
    of each phrase in its group), which turns ~100 scans into ~20 for a text
    that contains none of them.  The list is literal, so no join is needed.
    """
    text = F.lower(col_(c)) if lower else col_(c)
    groups: dict[str, list[str]] = {}
    for p in phrases:
        q = p.lower() if lower else p
        groups.setdefault(q.split(" ")[0] if " " in q else q, []).append(q)
    cond = F.lit(False)
    for head, ps in groups.items():
        inner = F.lit(False)
        for p in ps:
            inner = inner | text.contains(p)
        cond = cond | (inner if len(ps) == 1 else (text.contains(head) & inner))
    return F.coalesce(cond, F.lit(False))


_SPLIT = 134217729.0   # 2**27 + 1, Veltkamp splitting constant


def py_round(c, digits: int) -> Column:
    """Round like Python's ``round(x, d)``: correctly rounded on the exact binary value,
    exact ties to even (T9).  ``x * 10^d`` is computed with its exact rounding error
    (Veltkamp split; 10^d has few bits, so the partial products are exact), which
    decides the cases where the floating product lands exactly on a half."""
    s = float(10 ** digits)
    x = col_(c).cast("double")
    p = x * F.lit(s)
    t = x * F.lit(_SPLIT)
    xh = t - (t - x)
    xl = x - xh
    err = (xh * F.lit(s) - p) + xl * F.lit(s)
    r = F.rint(p)
    tie = F.abs(p - r) == F.lit(0.5)
    fl = F.floor(p).cast("double")
    r = F.when(tie & (err > 0), fl + F.lit(1.0)).when(tie & (err < 0), fl).otherwise(r)
    return F.when(F.isnan(x) | F.isnull(x), x).otherwise(r / F.lit(s))


def py_round_sql(expr: str, digits: int) -> str:
    """The same computation as ``py_round`` in DuckDB SQL (for the oracles)."""
    s = f"{float(10 ** digits)!r}"
    x = f"CAST(({expr}) AS DOUBLE)"
    p = f"({x} * {s})"
    t = f"({x} * {_SPLIT!r})"
    xh = f"({t} - ({t} - {x}))"
    err = f"(({xh} * {s} - {p}) + ({x} - {xh}) * {s})"
    return (f"(CASE WHEN abs({p} - round_even({p}, 0)) = 0.5 AND {err} > 0 THEN floor({p}) + 1.0 "
            f"WHEN abs({p} - round_even({p}, 0)) = 0.5 AND {err} < 0 THEN floor({p}) "
            f"ELSE round_even({p}, 0) END / {s})")
