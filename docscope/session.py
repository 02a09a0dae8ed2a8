"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every docscope job expects. Sizes are for local runs; a cluster
# deployment overrides shuffle partitions and memory through its own config.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}

# Join strategy: no broadcast on the optimizer's size *estimate* (a filtered or
# derived side can be misjudged, and the page side carries whole HTML bodies);
# AQE broadcasts a side only after its shuffle has run and its real size is
# known to be under this bound. Explicit broadcasts are kept for inputs whose
# size is bounded by construction (catalog, allow lists, day lists).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # counts of whole Parquet tables come from the file footers (sources.tables.stored_rows)
    "spark.sql.parquet.aggregatePushdown": "true",
    # page rows are wide (whole HTML): keep Arrow batches to the parser small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Constraint inference over the large URL expressions (derived URLs,
    # resolution stages) makes planning a join take tens of seconds; it only
    # adds inferred not-null/equality filters, so it is switched off.
    "spark.sql.constraintPropagation.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "docscope") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("DOCSCOPE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Pin the session settings results and plans depend on (time zone for
    event time, join strategy, Arrow batch size)."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    work_dir(spark)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and checkpoints.

    On a cluster this is the folder named by ``spark.checkpoint.dir``, which all
    executors share; without it the job fails here, before it writes parts to
    machine-local disks. Only a local session (tests) gets a private folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="docscope-ckpt-", dir="/tmp")
        sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def local_df(spark: SparkSession, rows, ddl: str):
    """A small literal table built JVM-side (``inline`` of a literal array),
    so no Python worker is needed to scan it and the optimizer can fold it
    into a local relation. ``ddl`` is ``"name type, ..."``."""
    from pyspark.sql import functions as F

    fields = [f.strip().split(None, 1) for f in ddl.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(fields, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
