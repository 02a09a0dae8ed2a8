"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Every distinct text is one indivisible group (all its copies share a shard).
A partial partition is a vector of ``n_shards`` byte sums. Differencing takes
the two partial partitions with the largest spread (largest minus smallest
sum) and adds them in opposite order - largest onto smallest - until one is
left. The differencing runs in blocks: groups are hashed into blocks of
about ``block_rows``, each block is differenced in its own task down to one
partial partition, and the blocks' partial partitions (``n_shards`` numbers
each) are differenced again, ``fan_in`` at a time, level by level, until one
block is left. No task ever sees more than ``block_rows`` groups or ``fan_in``
partial partitions, whatever the input size.

Edge cases: a null text has 0 bytes (size 1) and all null texts are one group;
the empty text is another group of size-1 rows. Repeated rows (equal doc_id)
are rows of their own and get slots of their own. An empty table gives an
empty result. A group as large as the average shard of what is left gets a shard of its
own (at most ``n_shards - 1`` groups, found by a top-k), and the others are
differenced over the remaining shards. Extra input columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.llm.common import blocks_for, clean_columns, prepare, stash

N_SHARDS = 16
#: Groups differenced in one task, and partial partitions merged in one task.
BLOCK_ROWS = 50_000
FAN_IN = 2_000
#: Rows numbered in one task when slots are given out.
SLOT_ROWS = 50_000


def difference(partials: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp over partial partitions (lists of k sums each).

    Returns ``(labels, sums)``: ``labels[i][j]`` is the final bin of bin ``j`` of
    partial ``i``; ``sums`` are the final sums by bin. Ties go to the earlier
    partial, so the result depends on the order of the input alone."""
    if not partials:
        return [], []
    k = len(partials[0])
    sums: list[list[int]] = []
    made: list[tuple[int, int, list[int]]] = []  # (left, right, order) of combined nodes
    first_order: list[list[int]] = []
    heap: list[tuple[int, int]] = []
    for i, p in enumerate(partials):
        order = sorted(range(k), key=lambda j: (-p[j], j))
        first_order.append(order)
        s = [p[j] for j in order]
        sums.append(s)
        heap.append((s[-1] - s[0], i))
    heapq.heapify(heap)
    n = len(partials)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        t = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=t.__getitem__, reverse=True)
        s = [t[j] for j in order]
        sums[a] = sums[b] = []  # no longer needed
        made.append((a, b, order))
        sums.append(s)
        heapq.heappush(heap, (s[-1] - s[0], n + len(made) - 1))
    label: list[list[int] | None] = [None] * (n + len(made))
    label[-1] = list(range(k))
    for m in range(len(made) - 1, -1, -1):
        a, b, order = made[m]
        mine = label[n + m]
        left, right = [0] * k, [0] * k
        for pos, j in enumerate(order):
            left[j] = mine[pos]
            right[k - 1 - j] = mine[pos]
        label[a], label[b], label[n + m] = left, right, None
    out = []
    for i in range(n):
        by_bin = [0] * k
        for pos, j in enumerate(first_order[i]):
            by_bin[j] = label[i][pos]
        out.append(by_bin)
    return out, sums[-1]


def _groups_task(n_shards: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("gid", "ascending")])
        sizes = table.column("bytes").to_pylist()
        zeros = [0] * (n_shards - 1)
        labels, _ = difference([[s, *zeros] for s in sizes])
        return pa.table({
            "gid": table.column("gid"), "block": table.column("block"),
            "bytes": table.column("bytes"),
            "bin": pa.array([x[0] for x in labels], pa.int32())})
    return task


def _blocks_task(n_shards: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")])
        labels, sums = difference([list(x) for x in table.column("sums").to_pylist()])
        n = table.num_rows
        return pa.table({
            "block": table.column("block"), "parent": table.column("parent"),
            "labels": pa.array(labels, pa.list_(pa.int32())),
            "sums": pa.array([sums if i == 0 else None for i in range(n)], pa.list_(pa.int64()))})
    return task


def partition_groups(groups: DataFrame, n_shards: int = N_SHARDS, block_rows: int = BLOCK_ROWS,
                     fan_in: int = FAN_IN) -> DataFrame:
    """``groups``: (gid, bytes), one row per group. Returns (gid, shard)."""
    groups = stash(clean_columns(groups, "gid", "bytes"), "kk-groups")
    whole = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    left, alone = whole["bytes"] or 0, []
    for g in groups.orderBy(F.desc("bytes"), "gid").limit(n_shards - 1).collect():
        if g["bytes"] * (n_shards - len(alone)) < left:
            break
        alone.append(bytes(g["gid"]))
        left -= g["bytes"]
    is_alone = F.col("gid").isin([F.lit(g) for g in alone]) if alone else F.lit(False)
    rest = _difference_blocks(groups.filter(~is_alone), whole["n"] - len(alone), n_shards - len(alone),
                              block_rows, fan_in)
    rest = rest.select("gid", (F.col("shard") + len(alone)).alias("shard"))
    if not alone:
        return rest
    place = F.array_position(F.array(*[F.lit(g) for g in alone]), F.col("gid")) - 1
    return groups.filter(is_alone).select("gid", place.cast("int").alias("shard")).unionByName(rest)


def _difference_blocks(groups: DataFrame, n_groups: int, n_shards: int, block_rows: int, fan_in: int) -> DataFrame:
    n_blocks = blocks_for(n_groups, block_rows)
    blocked = groups.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(n_blocks)).cast("long"))
    binned = stash(blocked.groupBy("block").applyInArrow(
        _groups_task(n_shards), "gid binary, block long, bytes long, bin int"), "kk-bins")
    bins = F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == s, F.col("bytes"))), F.lit(0).cast("long"))
                     for s in range(n_shards)])
    level = binned.groupBy("block").agg(bins.alias("sums"))
    # (block -> labels) of each level, composed bottom-up into one label array
    labels = None
    while True:
        parents = blocks_for(n_blocks, fan_in)
        merged = stash(level.withColumn("parent", F.floor(F.col("block") / F.lit(fan_in)).cast("long"))
                       .groupBy("parent").applyInArrow(
                           _blocks_task(n_shards),
                           "block long, parent long, labels array<int>, sums array<bigint>"), "kk-merge")
        if labels is None:
            labels = merged.select("block", "parent", "labels")
        else:
            up = merged.select(F.col("block").alias("parent"), F.col("parent").alias("_p"),
                               F.col("labels").alias("_l"))
            labels = labels.join(up, "parent").select(
                "block", F.col("_p").alias("parent"),
                F.transform("labels", lambda x: F.element_at("_l", x + 1)).alias("labels"))
        if parents == 1:
            break
        level = merged.filter("sums is not null").select(F.col("parent").alias("block"), "sums")
        n_blocks = parents
    return (binned.join(labels.select("block", "labels"), "block")
            .select("gid", F.element_at("labels", F.col("bin") + 1).alias("shard")))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, block_rows: int = BLOCK_ROWS,
                    fan_in: int = FAN_IN, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``
    (columns doc_id, text). ``slot`` numbers the rows of a shard from 0."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text")
    facts = stash(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("gid")), "kk-facts")
    groups = facts.groupBy("gid").agg(F.sum("size").alias("bytes"))
    placed = facts.join(partition_groups(groups, n_shards, block_rows, fan_in), "gid")
    chunks = blocks_for(facts.count(), slot_rows * n_shards)
    key = F.pmod(F.xxhash64("doc_id", "gid"), F.lit(chunks)).cast("int")
    placed = stash(placed.select("doc_id", "size", "text_crc32", "shard", key.alias("chunk")), "kk-placed")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("pos", F.row_number().over(order) - 1)
            .join(offsets, ["shard", "chunk"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("offset") + F.col("pos")).cast("long").alias("slot")))
