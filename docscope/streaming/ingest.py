"""Structured Streaming ingest of the event feed and incremental publishing.

* ``ingest_stream`` - monitor a feed directory (``readStream.json``), add event
  time and source, append to a Parquet table partitioned by day with a checkpoint; run with
  ``availableNow`` to drain what is there, or with a processing-time trigger.
* ``upsert_stream`` - append every run's rows to one table and read the newest run
  per key: the work of a micro-batch is its own rows, whatever is stored.
* ``latest_stream`` - the same on the stream itself: keyed state, one row per topic.
* ``latest_per_key`` - re-delivered events: the latest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope.functions.times import event_or_ingest_time
from docscope.operators.publish import EVENT_SCHEMA
from docscope.sources.feed import FEED_GLOB


# Files per micro-batch: bounds the size of one batch however many files
# arrive (availableNow drains them in several batches).
MAX_FILES_PER_TRIGGER = 1000


def feed_stream(spark: SparkSession, path: str, glob: str = FEED_GLOB,
                max_files: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files)
            .option("encoding", "UTF-8").json(path)
            .withColumn("source", F.col("_metadata.file_path"))
            .withColumn("_time", event_or_ingest_time("last_modified", F.col("_metadata.file_modification_time"))))


def ingest_stream(spark: SparkSession, feed_dir: str, table_dir: str, checkpoint: str,
                  available_now: bool = True, glob: str = FEED_GLOB):
    """Start the ingest query; returns the ``StreamingQuery``."""
    rows = feed_stream(spark, feed_dir, glob).withColumn("day", F.to_date("_time"))
    w = (rows.writeStream.format("parquet").partitionBy("day")
         .option("path", table_dir).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="4 seconds")
    return w.start()


def latest_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Newest row per key by ``order`` (descending). One window partition per
    key: a key re-delivered many times is one partition's rows, which the
    window sorts and streams (spillable), never collects."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def merge_topics(stored: DataFrame, new: DataFrame, key: str = "id", run_col: str = "run") -> DataFrame:
    """Union stored and new topic rows, keep the latest run per key."""
    return latest_per_key(stored.unionByName(new, allowMissingColumns=True), [key], [run_col])


def run_rows(spark: SparkSession, feed_glob: str, run_of_path: str = r"/run(\d+)/") -> DataFrame:
    """The feed with the number of the run that wrote each file, from its path."""
    return feed_stream(spark, feed_glob).withColumn(
        "run", F.regexp_extract("source", run_of_path, 1).cast("int")).drop("_time")


def upsert_stream(spark: SparkSession, feed_glob: str, table_dir: str, checkpoint: str, key: str = "file") -> DataFrame:
    """Drain feed files into an append-only Parquet table, partitioned by run, and
    return its newest row per key. Nothing written is written again; the file sink's log
    makes each file's rows appear once, also after a restart."""
    rows = run_rows(spark, feed_glob)
    q = (rows.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint)
         .partitionBy("run").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_upserted(spark, table_dir, rows.schema, key)


def read_upserted(spark: SparkSession, table_dir: str, schema, key: str = "file") -> DataFrame:
    """The newest run's row per key; of one run, the last file's."""
    return latest_per_key(spark.read.schema(schema).parquet(table_dir), [key], ["run", "source"])


def latest_stream(spark: SparkSession, feed_glob: str, table_dir: str, checkpoint: str, columns: list[str],
                  key: str = "file") -> DataFrame:
    """Keyed state on the stream: per key the newest run's ``columns`` (no bodies), one
    state row per topic however often it is delivered. Every micro-batch writes the keys it
    has seen, with their newest values, to its own epoch partition (the same one when it is
    run again); returns the newest epoch's row per key."""
    newest = run_rows(spark, feed_glob).groupBy(key).agg(F.max(F.struct("run", *columns)).alias("newest"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(key, "newest.*").write.mode("overwrite").parquet(f"{table_dir}/epoch={epoch}")

    q = (newest.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = newest.select(key, "newest.*").schema.add("epoch", "long")
    return latest_per_key(spark.read.schema(schema).parquet(table_dir), [key], ["epoch"]).drop("epoch")
