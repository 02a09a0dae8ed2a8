"""Approximate nearest neighbours by a forest of random-projection trees.

Rows are dealt by hash into shards of about ``shard_rows`` and queries into blocks of about
``block_rows``; one task holds one shard and one query block. It builds a forest
over its shard (every row is in every tree: a node splits its rows at the median of
a random projection, so leaves are bounded even for equal vectors) and searches
it through one priority queue shared by all trees: the open node with the best
margin is opened next, whichever tree it is in, until the leaves read hold
enough candidates. The candidates are ranked exactly, in double precision on the
original vectors, and the shards' best are merged by a window over each query.

How many candidates are enough is found by an audit in every task: on some of its queries
the result is compared with the shard searched exhaustively, and the share is widened
until the recall reaches ``target`` (0.97 of neighbours; the whole shard at the
latest). Nothing is fitted on a sample.

Nearness is the Euclidean distance; ties go to the smaller vec_id.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, as query or candidate; vectors of different length are
never compared; rows with the query's own vec_id are not its candidates; rows that repeat another vec_id are
candidates of their own; a query's vec_id that occurs twice is searched once, with its
smallest vector. With fewer than ``k`` candidates all are returned. An empty table
gives an empty result. Extra input columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.llm.common import blocks_for, clean_columns, prepare, stash

TREES = 12
LEAF = 48
SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
TARGET = 0.97
AUDITED = 48
FIRST_SHARE = 0.15
#: Partitions that the (shard, block) tasks are dealt into at most; each then does several in turn.
MAX_TASKS = 50_000


def usable(column: str) -> F.Column:
    """True for vectors that take part."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


class Forest:
    """Trees over the rows of ``x``. Node ``i``: direction, threshold, children; leaves hold rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        rng = np.random.default_rng(seed)
        directions, self.threshold, self.children, self.leaves, self.roots = [], [], [], {}, []
        for _ in range(trees):
            self.roots.append(len(self.children))
            self.children.append(None)
            directions.append(None)
            self.threshold.append(0.0)
            todo = [(self.roots[-1], np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if len(rows) <= leaf:
                    self.leaves[node] = rows
                    continue
                r = rng.normal(size=x.shape[1])
                r /= np.linalg.norm(r)
                p = x[rows] @ r
                half = len(rows) // 2
                order = np.argpartition(p, half)
                directions[node], self.threshold[node] = r, float(p[order[half]])
                kids = []
                for part in (rows[order[:half]], rows[order[half:]]):
                    kids.append(len(self.children))
                    self.children.append(None)
                    directions.append(None)
                    self.threshold.append(0.0)
                    todo.append((kids[-1], part))
                self.children[node] = tuple(kids)
        zero = np.zeros(x.shape[1])
        self.directions = np.array([zero if d is None else d for d in directions])
        self.threshold = np.array(self.threshold)

    def candidates(self, margins: list[float], enough: int, seen: np.ndarray) -> np.ndarray:
        """Rows of the best leaves until ``enough`` distinct rows are found.
        ``margins``: of the query by node; ``seen``: scratch, all False."""
        heap = [(-np.inf, root) for root in self.roots]
        found, count = [], 0
        children, leaves = self.children, self.leaves
        while heap and count < enough:
            worst, node = heapq.heappop(heap)
            while (kids := children[node]) is not None:  # down the near side, far side to the queue
                m = margins[node]
                near, far = (kids[0], kids[1]) if m < 0 else (kids[1], kids[0])
                heapq.heappush(heap, (max(worst, abs(m)), far))
                node = near
            rows = leaves[node]
            new = rows[~seen[rows]]
            seen[new] = True
            found.append(new)
            count += len(new)
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        seen[out] = False
        return out


def _nearest(x, ids, rows, q, own, k):
    """The ``k`` nearest of ``rows`` to ``q``: (ids, distances), ties to the smaller id."""
    rows = rows[ids[rows] != own]
    d = x[rows] - q
    dist = np.sqrt((d * d).sum(axis=1))
    if len(rows) > 4 * k:
        edge = np.partition(dist, k - 1)[k - 1]
        keep = dist <= edge
        rows, dist = rows[keep], dist[keep]
    order = np.lexsort((ids[rows], dist))[:k]
    return ids[rows][order], dist[order]


def _task(k: int, trees: int, leaf: int, target: float):
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        ids_all = table.column("vec_id").to_numpy()
        x_all = table.column("embedding").combine_chunks().flatten().to_numpy().astype(
            np.float64).reshape(len(ids_all), -1)
        order = np.lexsort((*x_all.T[::-1], ids_all))  # the same forest whatever the order of arrival
        is_query, ids_all, x_all = is_query[order], ids_all[order], x_all[order]
        x, ids, q, q_ids = x_all[~is_query], ids_all[~is_query], x_all[is_query], ids_all[is_query]
        out_q, out_v, out_s = [], [], []
        if len(x) and len(q):
            forest = Forest(x, trees, leaf)
            everything, seen = np.arange(len(x)), np.zeros(len(x), bool)

            def search(which, share):
                enough = max(4 * k, int(np.ceil(share * len(x))))
                for lo in range(0, len(which), 256):
                    part = which[lo:lo + 256]
                    margins = q[part] @ forest.directions.T - forest.threshold
                    for i, m in zip(part, margins):
                        rows = forest.candidates(m.tolist(), enough, seen)
                        yield i, _nearest(x, ids, rows, q[i], q_ids[i], k)

            audit = np.arange(0, len(q), max(1, len(q) // AUDITED))
            exact = {i: _nearest(x, ids, everything, q[i], q_ids[i], k) for i in audit}
            share = FIRST_SHARE
            while share < 1:
                hit = sum((got[1] <= exact[i][1][-1]).sum() if len(exact[i][1]) else 0
                          for i, got in search(audit, share))
                if hit >= target * sum(len(e[1]) for e in exact.values()):
                    break
                share *= 1.3
            for i, (v, s) in search(np.arange(len(q)), min(share, 1.0)):
                out_q.append(np.full(len(v), q_ids[i]))
                out_v.append(v)
                out_s.append(s)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0, t), pa.from_numpy_dtype(t))
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64),
                         "score": cat(out_s, np.float64)})
    return run


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, trees: int = TREES, leaf: int = LEAF,
           shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``vectors``
    (vec_id, embedding) for which ``is_query`` holds."""
    prepare(vectors.sparkSession)
    rows = stash(clean_columns(vectors, "vec_id", "embedding").filter("vec_id is not null").filter(
        usable("embedding")).withColumn("dim", F.size("embedding")), "ann-rows")
    queries = rows.filter(is_query).groupBy("dim", "vec_id").agg(F.min("embedding").alias("embedding"))
    shards, blocks = blocks_for(rows.count(), shard_rows), blocks_for(queries.count(), block_rows)

    def place(n):
        return F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cols = ["dim", "shard", "block", "is_query", "vec_id", "embedding"]
    data = rows.withColumn("shard", place(shards)).withColumn("is_query", F.lit(False)).withColumn(
        "block", each(blocks)).select(cols)
    asked = queries.withColumn("block", place(blocks)).withColumn("is_query", F.lit(True)).withColumn(
        "shard", each(shards)).select(cols)
    # few rows for the work they cost: as many partitions as (shard, block) tasks
    dealt = data.unionByName(asked).repartition(min(shards * blocks, MAX_TASKS), "dim", "shard", "block")
    found = dealt.groupBy("dim", "shard", "block").applyInArrow(
        _task(k, trees, leaf, target), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
