"""Index retention as table operators: by age and by total size.

Over a table partitioned by day (``write_by_day``) both name the days they keep as a
partition filter, so frozen days are not listed, opened or read; ``drop_days`` frees their
storage. Undated rows lie in the null day and stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the event index: maximum age in seconds and size in MB.
MAX_AGE_SECONDS = 315_360_000
MAX_SIZE_MB = 10_240


def keep_by_age(df: DataFrame, ts: str, now_col, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Rows not older than ``max_age_seconds`` before ``now_col``; undated rows stay
    (date them by their ingest time first to let them age)."""
    cutoff = now_col - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return df.where((F.col(ts) >= cutoff) | F.col(ts).isNull())


def day_sizes(df: DataFrame, ts: str, size_col) -> DataFrame:
    """(day, bytes): bytes per day, aggregated before anything is ordered."""
    return (df.groupBy(F.to_date(F.col(ts)).alias("day"))
            .agg(F.sum(size_col).cast("long").alias("bytes")))


def size_cutoff(days: DataFrame, max_bytes: int) -> DataFrame:
    """Newest days whose running total stays within ``max_bytes`` are kept,
    older days are frozen; undated rows (null day) count as the newest. The running
    sum runs over one row per day."""
    w = Window.orderBy(F.col("day").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("cum_bytes", F.sum("bytes").over(w)).withColumn(
        "kept", F.col("cum_bytes") <= F.lit(max_bytes))


def keep_by_size(df: DataFrame, ts: str, size_col, max_mb: int = MAX_SIZE_MB) -> DataFrame:
    cut = size_cutoff(day_sizes(df, ts, size_col), max_mb * 1024 * 1024).where("kept").select("day")
    return df.join(cut, F.to_date(F.col(ts)).eqNullSafe(cut["day"]), "left_semi")


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """``df`` partitioned by ``day``; a day with very many rows becomes many files."""
    (df.withColumn("day", F.to_date(F.col(ts))).hint("rebalance", F.col("day"))
     .write.mode("overwrite").partitionBy("day").parquet(path))


def from_day(df: DataFrame, day) -> DataFrame:
    return df.where((F.col("day") >= day) | F.col("day").isNull())


def keep_days_by_age(df: DataFrame, ts: str, now_col, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """``keep_by_age`` on a table partitioned by day: the cutoff's day and later ones are read."""
    oldest = F.to_date(now_col - F.make_dt_interval(secs=F.lit(max_age_seconds)))
    return keep_by_age(from_day(df, oldest), ts, now_col, max_age_seconds)


def oldest_kept_day(days: DataFrame, max_bytes) -> DataFrame:
    """One row: the oldest of the days that ``size_cutoff`` keeps, which are the newest without a gap;
    a day after all others if none is kept."""
    last = F.max(F.when(F.col("day").isNotNull(), F.date_add("day", 1)))
    return size_cutoff(days, max_bytes).agg(F.coalesce(F.min(F.when(F.col("kept"), F.col("day"))), last).alias("day"))


def keep_days_by_size(df: DataFrame, ts: str, size_col, max_bytes) -> DataFrame:
    """``keep_by_size`` on a table partitioned by day. Undated rows, the newest, go if they don't fit alone."""
    days = day_sizes(df, ts, size_col)
    undated = size_cutoff(days, max_bytes).where("day is null and not kept").agg(F.count(F.lit(1))).scalar() == 0
    oldest = oldest_kept_day(days, max_bytes).scalar()
    return df.where((F.col("day") >= oldest) | (F.col("day").isNull() & undated))


def drop_days(spark: SparkSession, name: str, before) -> list:
    """Drop the partitions of catalog table ``name`` (partitioned by ``day``) that are older than ``before``,
    with their files; returns the dropped days. Days are few: one a day of retention."""
    partitions = spark.sql(f"SHOW PARTITIONS {name}").select(
        F.regexp_extract("partition", r"day=(\d{4}-\d{2}-\d{2})$", 1).alias("day")).where("day <> ''")
    old = [r["day"] for r in partitions.where(F.col("day").cast("date") < F.lit(before)).orderBy("day").collect()]
    if old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION (day = DATE'{d}')" for d in old))
    return old
