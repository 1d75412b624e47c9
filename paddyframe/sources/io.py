"""Sources and sinks (survey 2.A): CSV scans, series arrays, insert-or-ignore,
partition overwrite, CSV export, JSON case files.  The model registry is ``registry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "_corrupt"    # column that holds a row which does not fit the schema, whole
NO_CELL = "\u0000"      # what stands for an unquoted empty cell while it is read; so "" in quotes stays an empty text


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """Headered UTF-8 CSV (A1); quoted cells may hold quotes (doubled) and line breaks.

    An explicit schema avoids an inference pass; with ``keep_corrupt`` rows that do not fit it are kept as text
    in the column ``_corrupt``, which is null for all others.  Files are the unit of parallelism.
    """
    r = spark.read.options(header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"', nullValue=NO_CELL, inferSchema=False)
    if schema is None:
        return r.csv(path)
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        r = r.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return r.schema(schema).csv(path)


def read_wide_csv(spark: SparkSession, path: str, label_index: int = 0,
                  label_cols: int = 1) -> tuple[DataFrame, str, list[str]]:
    """Statistical wide CSV (A2): all columns as strings; returns (df, label column, period columns).

    The first ``label_cols`` columns describe a series; ``label_index`` says which of them names it
    (production tables: the second of two, price tables: the first of two) and the others are
    dropped.  The unpivot / missing-marker cleaning is ``operators.clean.wide_csv_to_long``.
    """
    df = spark.read.option("header", True).csv(path)
    label, periods = df.columns[label_index], df.columns[label_cols:]
    return df.select(label, *periods), label, periods


def series_explode(df: DataFrame, keys: list[str], start_col: str, end_col: str, step_col: str,
                   value_cols: list[str], tz: str | None = None) -> DataFrame:
    """Array-of-variables series -> rows (A5).

    ``start``/``end`` epoch seconds (end exclusive), ``step`` seconds, one array per
    variable; timestamps optionally shifted from UTC to ``tz``.
    """
    ts = F.sequence(F.col(start_col), F.col(end_col) - F.lit(1), F.col(step_col))
    z = F.arrays_zip(ts.alias("ts"), *[F.col(v).alias(v) for v in value_cols])
    out = df.select(*keys, F.explode(z).alias("_z")).select(*keys, "_z.*")
    t = F.timestamp_seconds(F.col("ts"))
    if tz:
        t = F.from_utc_timestamp(t, tz)
    return out.withColumn("ts", t)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str],
                     order_cols: list[str], mode: str = "ignore") -> DataFrame:
    """Insert-or-ignore on a unique key (A6): first incoming row per key wins
    (by ``order_cols`` ascending), rows whose key already exists are skipped.
    ``mode='replace'`` lets incoming rows replace existing ones (T10 option)."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    incoming = incoming.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    if mode == "replace":
        return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def replace_partitions(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (A7): dynamic partition overwrite,
    one atomic job per write instead of a delete + append per entity."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*partition_cols).format(fmt).save(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header and no index column (A8): what ``read_csv`` reads back cell by cell, blanks at the
    ends, quotes, line breaks, empty cells and nulls included."""
    df.write.mode("overwrite").options(header=True, encoding="UTF-8", quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                       ignoreTrailingWhiteSpace=False, emptyValue='""').csv(path)


def append_new(incoming: DataFrame, path: str, keys: list[str], order_cols: list[str]) -> None:
    """Insert-or-ignore into a Parquet folder (A6): only rows whose key it lacks are written, in one append.
    One writer at a time: two at once may both insert a key."""
    existing = incoming.sparkSession.read.schema(incoming.schema).parquet(path)
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    first.join(existing.select(*keys), keys, "left_anti").select(incoming.columns).write.mode("append").parquet(path)


def latest_model(registry: DataFrame, model_type_col: str = "model_type", stamp_col: str = "trained_at") -> DataFrame:
    """Rows of the most recent model per model type (A9): max stamp per type, then a semi join."""
    latest = registry.groupBy(model_type_col).agg(F.max(stamp_col).alias(stamp_col))
    return registry.join(latest, [model_type_col, stamp_col], "left_semi")


def read_cases(spark: SparkSession, path: str, array_field: str, schema: str, keys: str = "", multi_line: bool = True,
               keep_corrupt: bool = False) -> DataFrame:
    """Labelled-case JSON (A10): objects holding an array of cases -> one row per case.

    ``keys`` names further fields of the object, which every case carries; without ``multi_line`` a line is an object.  With
    ``keep_corrupt`` text that does not parse is one row with the text in ``_corrupt``.
    """
    fields = [f"{keys}, " if keys else "", f"{array_field} array<struct<{schema}>>", f", {CORRUPT} string" if keep_corrupt else ""]
    r = spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT)
    raw = r.schema("".join(fields)).json(path)
    outer = [k.split()[0] for k in keys.split(",")] if keys else []
    cases = F.explode_outer(array_field) if keep_corrupt else F.explode(array_field)
    extra = [CORRUPT] if keep_corrupt else []
    out = raw.select(*outer, *extra, cases.alias("c"))
    if keep_corrupt:
        out = out.filter(F.col("c").isNotNull() | F.col(CORRUPT).isNotNull())
    return out.select(*outer, "c.*", *extra)
