"""Position of each row inside a group, without one task per group.

``row_number() over (partition by g order by k)`` puts every row of a group in
one task; a group holding a third of the data then becomes a third of the job
on one core. ``group_rank`` computes the same numbers in three bounded steps:

1. range-partition on (group, order keys): the sampled bounds split a large
   group over many partitions, and rows are sorted inside each partition;
2. rank locally per (group, partition) - each piece is at most one partition;
3. add, per (group, partition), the number of rows of the group in earlier
   partitions: a running sum over the small (group, partition) count table.

The partition id is fixed by writing the partitioned rows once (reliable
checkpoint), so steps 2 and 3 see the same assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank",
               partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in its group by ``order``
    (ascending, ties broken by the order keys themselves; make them unique)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = (df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
              .withColumn("_part", F.spark_partition_id())).checkpoint(eager=True)
    local = parted.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    counts = parted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (local.join(offsets, [*group, "_part"])
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_part", "_local", "_off"))


def first_in_group(df: DataFrame, group: list[str], order: list[str], name: str = "is_first") -> DataFrame:
    """Flag the first row of each group by ``order``: the minimum is found by
    partial aggregation and joined back on the full (unique) key, so a large
    group is never one task."""
    key = [*group, *order]
    firsts = (df.groupBy(*group).agg(F.min(F.struct(*order)).alias("_m"))
              .select(*group, *[F.col(f"_m.{c}").alias(c) for c in order])
              .withColumn(name, F.lit(True)))
    return df.join(firsts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
