"""Query catalogue: one Spark query + (where expressible) one DuckDB oracle per operator.

Every query reads the benchmark tables (or data Spark derives from them) in
full; nothing is sampled or capped except where a limit is the operator
(top-k, top-n per group).  Doubles are rounded to 4 places on both sides and
-0.0 is normalised so the order-insensitive value hash is stable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import Fixtures


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op: str  # survey operator id(s)


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """Normalise every double/float column for an engine-independent value hash.

    ``floor(round(x, 8) * 10^d + 0.5) / 10^d``: the inner round removes
    summation-order noise, the outer step uses only IEEE operations, so Spark and
    the SQL oracle produce the identical double even for exact half-way values.
    NaN -> NULL.
    """
    scale = float(10 ** digits)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            norm = F.floor(F.round(c, 8) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
            out.append(F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(norm).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def query(name: str, op: str, sql: str | None = None, round_output: bool = True):
    def deco(fn):
        def run(spark: SparkSession, base: str) -> DataFrame:
            df = fn(Fixtures(spark, base))
            return finish(df) if round_output else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, op)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}


def _load():
    # importing the modules registers their queries
    from . import q_core, q_model, q_text, q_eval  # noqa: F401
