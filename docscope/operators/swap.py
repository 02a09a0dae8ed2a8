"""Atomic replacement of a published dataset through the catalog.

A dataset has a name, a view in the catalog. Its new content is written to a folder of its own;
only then the view is replaced, which is one catalog change. A reader that opened
the old version finishes on the old files; a write that fails leaves the view as it was.
Folders of old versions stay for such readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docscope.session import work_dir


def publish(df: DataFrame, name: str) -> str:
    """Make ``df`` the content of ``name``; returns the folder it was written to."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/published/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    return path


def opened(spark: SparkSession, name: str) -> DataFrame:
    """The version of ``name`` that is current now; later replacements don't change it."""
    return spark.table(name)
