"""Event feed: newline-delimited JSON sink and batch source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.operators.publish import EVENT_FIELDS, EVENT_SCHEMA

# Feed files: ``*.ndjson`` from outside, and the JSON writer's part files; the
# monitor picks them by this glob.
FEED_GLOB = "*.{ndjson,json}"


def write_feed(events: DataFrame, path: str) -> None:
    """Fields in fixed order, nulls written, UTF-8 without escaping, one object
    per line; the directory is replaced as a whole (commit protocol)."""
    (events.select(*EVENT_FIELDS).write.mode("overwrite")
     .option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path))


def read_feed(spark: SparkSession, path: str, glob: str = FEED_GLOB) -> DataFrame:
    """Batch read with the fixed schema; any of ``\\n``, ``\\r\\n``, ``\\r``
    ends a record; every file under ``path`` matching ``glob``."""
    return (spark.read.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
            .option("encoding", "UTF-8").json(path)
            .withColumn("source", F.col("_metadata.file_path")))


def write_decoy(spark: SparkSession, directory: str) -> None:
    """A non-feed file next to the feed files (a text manifest), which the
    feed monitor must ignore."""
    from docscope.session import local_df
    local_df(spark, [("manifest",)], "value string").write.mode("append").text(directory)
