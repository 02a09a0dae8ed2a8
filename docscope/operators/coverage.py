"""Online-vs-local coverage report and run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(catalog: DataFrame, planned: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per catalog product: planned (online) count, stored (local)
    count, ``missing = max(0, online - local)``. Counts, not keys, are
    compared, so surplus local topics mask missing ones; stored products
    outside the catalog are not reported. Both counts are aggregated before
    the (catalog-sized) joins."""
    online = planned.groupBy("pid").agg(F.count(F.lit(1)).alias("online_count"))
    local = (stored.groupBy(F.col("product").alias("pid"))
             .agg(F.count(F.lit(1)).alias("local_count")))
    c = catalog.select("pid", "title", "ord")
    return (c.join(online, "pid", "left").join(local, "pid", "left")
            .select(F.col("pid").alias("id"), "title",
                    F.coalesce("online_count", F.lit(0)).cast("long").alias("online_count"),
                    F.coalesce("local_count", F.lit(0)).cast("long").alias("local_count"), "ord")
            .withColumn("missing_count", F.greatest(F.lit(0).cast("long"),
                                                    F.col("online_count") - F.col("local_count"))))


def coverage_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_or(F.col("missing_count") > 0).alias("updates_available"),
                      F.count(F.lit(1)).alias("products"),
                      F.sum("missing_count").cast("long").alias("missing_total"))


def coverage_keys(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Key-based variant: planned topic ids absent from the stored set, per
    product (anti join, so stale extra local topics do not mask gaps)."""
    missing = planned.select("pid", "id").join(stored.select("id"), "id", "left_anti")
    return missing.groupBy("pid").agg(F.count(F.lit(1)).alias("missing_keys"))


def progress_pct(done, total):
    return F.when(total > 0, F.round(F.lit(100.0) * done / total).cast("long")).otherwise(F.lit(0).cast("long"))


def report_document(report: DataFrame, checked_at) -> DataFrame:
    """The published report as one nested row: ``checked_at``,
    ``updates_available`` and the per-product rows in catalog order. The
    product list is catalog-sized (one row per configured product)."""
    prod = F.struct("ord", "id", "title", "online_count", "local_count", "missing_count")
    return report.agg(
        F.bool_or(F.col("missing_count") > 0).alias("updates_available"),
        F.transform(F.sort_array(F.collect_list(prod)),
                    lambda p: p.dropFields("ord")).alias("products")).select(
        checked_at.alias("checked_at"), "updates_available", "products")


def write_report(doc: DataFrame, path: str) -> None:
    """Replace the report file set as a whole (write then commit)."""
    doc.coalesce(1).write.mode("overwrite").json(path)
