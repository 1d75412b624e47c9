"""paddyframe: Spark-native operators for entity x month panel analytics.

Sub-packages
------------
sources    readers and sinks (parquet/CSV/JSON scans, insert-or-ignore, model registry)
functions  column-level helpers built only from ``pyspark.sql.functions``
operators  DataFrame -> DataFrame operators (cleaning, joins, rollups, windows,
           correlation, linear models, scoring, entity resolution, text, retrieval,
           conversation tables, evaluation, data quality)
plans      fixture views that bind the operators to the benchmark tables, and the
           query catalogue used by ``__spark_entry__``
streaming  Structured Streaming variants of the rollup operators
"""

__version__ = "0.1.0"
