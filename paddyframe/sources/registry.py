"""Model registry in a shared folder (survey 2.A, A9): versions are folders, a commit row makes one count.

    <registry>/versions/<model type>/<version>/   the coefficient table, written once
    <registry>/commits/                           a row per complete version (model_type, version, trained_at)

A writer makes a version under a name of its own, and appends its commit row last; so a writer that dies leaves a
folder that no reader looks at, and two writers of the same model never share a folder.  A reader reads the
commits, picks the latest stamp per model type (of equal stamps the greatest version name) and opens those folders only.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMITS = "model_type string, version string, trained_at timestamp"


def write_version(coefs: DataFrame, registry: str, model_type: str) -> str:
    """Write a coefficient table as a version that does not count yet; returns the version's name."""
    version = new_version()
    coefs.write.mode("error").parquet(folder(registry, model_type, version))
    return version


def new_version() -> str:
    """A name that no other writer has."""
    return uuid.uuid4().hex


def commit(spark: SparkSession, registry: str, model_type: str, version: str, trained_at: str) -> None:
    """From now on the version counts."""
    row = [(model_type, version, datetime.datetime.fromisoformat(trained_at))]
    spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{registry}/commits")


def save(coefs: DataFrame, registry: str, model_type: str, trained_at: str) -> str:
    """Write and commit a version."""
    version = write_version(coefs, registry, model_type)
    commit(coefs.sparkSession, registry, model_type, version, trained_at)
    return version


def commits(spark: SparkSession, registry: str) -> DataFrame:
    """All committed versions; none where nothing has been committed."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{registry}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COMMITS)


def load_latest(spark: SparkSession, registry: str, schema: str) -> DataFrame:
    """The latest committed version of every model type: ``schema``'s columns, model_type and trained_at."""
    newest = commits(spark, registry).groupBy("model_type").agg(F.max(F.struct("trained_at", "version")).alias("v"))
    out = spark.createDataFrame([], f"{schema}, model_type string, trained_at timestamp")
    for r in newest.select("model_type", "v.*").collect():      # a row per model type
        table = spark.read.schema(schema).parquet(folder(registry, r["model_type"], r["version"]))
        out = out.unionByName(table.withColumns({"model_type": F.lit(r["model_type"]), "trained_at": F.lit(r["trained_at"])}))
    return out


def folder(registry: str, model_type: str, version: str) -> str:
    return f"{registry}/versions/{model_type}/{version}"
