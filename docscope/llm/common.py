"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder the session names in
``spark.checkpoint.dir`` (see ``docscope.session.work_dir``), never to a
machine-local folder on a cluster, and are read again by every consumer, so a
lost executor costs the recomputation of a task, not of the whole lineage.
"""

from __future__ import annotations

import math
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.session import work_dir

#: Rows in one Arrow batch handed to Python: whole texts are wide.
ARROW_ROWS = "256"


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages of this subpackage rely on; its
    functions are shipped by value, so executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, the other columns of ``sample``, text): one row per doc_id of ``sample`` (one row
    each, of bounded number, so broadcast) that is in ``docs``. Of several rows of a doc_id the
    smallest text counts, found by partial aggregation, so repeats leave no more rows."""
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy(*sample.columns).agg(F.min("text").alias("text"))


def blocks_for(rows: int, per_block: int) -> int:
    """Number of blocks of about ``per_block`` rows; grows with the data."""
    return max(1, math.ceil(rows / per_block))


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra input columns, whatever their names, can
    then not clash with columns an operator adds."""
    return df.select(*names)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no input column has it (names ignore case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name
