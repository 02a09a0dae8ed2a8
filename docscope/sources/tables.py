"""Driver-provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``total``: the rows of a Parquet table, summed from the row counts in its file
    footers. No column is read: the aggregate is pushed into the scan, which only the
    reader of the second data source version does, so the table is opened with that."""
    name = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(name)
    spark.conf.set(name, ",".join(x for x in before.split(",") if x.strip() != "parquet"))
    try:
        total = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("total"))
    finally:
        spark.conf.set(name, before)
    # files without row groups have no count to sum: the total of none is nought
    none = spark.range(1).select(F.lit(0).cast("long").alias("total"))
    return total.unionByName(none).agg(F.sum("total").alias("total"))
