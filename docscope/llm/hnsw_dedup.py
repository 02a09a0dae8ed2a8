"""Embedding near-duplicates by HNSW graphs per shard.

Only vectors of one label are compared. Equal vectors of a label are one node
(copies count, but are not searched). The nodes of a label are dealt into shards
of about ``shard_rows``; one task builds the hierarchical navigable small-world
graph of a shard and searches it for a block of at most about ``block_rows`` of the label's
nodes, so every node queries every shard. A search goes down the layers, runs a
beam on the lowest, and then floods from the hits along graph links as long as it
meets hits, so a group of thousands of near copies is found whole. Hits are
verified: cosine in double precision on the original vectors.

Beam: an audit in every task compares ``AUDITED`` queries with the whole shard, and as many of
those that the graph itself puts beside a near copy. A search for a node of the shard begins at that
node; where queries come from other shards, as many probes are audited too: shard vectors turned until
their cosine is just above the threshold, so there are links to find also where the data has none. A first
beam is doubled until it finds a link of every audited node that has one, and from there a full beam
until it finds all of them; queries that the first finds links of are searched again with the full one.
Where even a beam of the whole shard does not find them (pruned links can leave nodes that no beam reaches), every query of the task
is compared with the whole shard.

A task returns, per node, the number of linked rows it found, and a spanning
forest of its links (at most one link a node), never all pairs. Components
are joined over shards by ``components``.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, rows without a label or vec_id, link with nothing and are their own
component; vectors of different length are never compared. Repeated rows are copies. An empty table gives an
empty result. Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.ann_forest import usable
from docscope.llm.common import clean_columns, prepare, stash
from docscope.llm.components import components

THRESHOLD = 0.98
M, M0, BUILD_BEAM, BEAM = 10, 20, 32, 24
#: A shard's links among its own nodes are a bit matrix: 32 MB.
SHARD_ROWS = 16_384
BLOCK_ROWS = 32_768
#: Queries, queries with links, and planted probes that a task audits, of each so many.
AUDITED = 64
#: Nodes among which the audit looks for those with links.
AUDIT_LOOK = 2_048
#: Nodes that enter a graph together, queries that search it together or are compared with a whole shard.
GROUP = 256
#: Pairs of vectors multiplied at once.
PAIRS = 32_768
#: Partitions that the (shard, block) tasks are dealt into at most; each then does several in turn.
MAX_TASKS = 50_000
#: Single precision finds, double precision decides.
SLACK = 1e-4


class Graph:
    """HNSW graph over the rows of ``x`` (unit vectors, single precision), built and searched by many at once.

    Nodes enter from the highest level down, so each layer holds the first of them; every group of
    new nodes (never more than are in) searches the graph so far and is compared within itself.
    """

    def __init__(self, x: np.ndarray, seed: int = 3):
        n = len(x)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(M)).astype(int), 8)
        self.order = np.argsort(-levels, kind="stable")  # place in the graph -> row of x
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.x = x[self.order]
        top = int(levels.max()) if n else 0
        self.links = [np.full(((levels >= layer).sum(), M if layer else M0), -1, np.int64)
                      for layer in range(top + 1)]
        at = 1
        while at < n:
            size = min(GROUP, at, n - at)
            self._insert(at, size)
            at += size

    def neighbours(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ``x`` linked from each of ``rows`` on the lowest layer, -1 where there are fewer."""
        near = self.links[0][self.place[rows]]
        return np.where(near >= 0, self.order[near], -1)

    def _sims(self, nodes: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Similarity of each node with the query at the same place of ``of``."""
        out = np.empty(len(nodes), np.float32)
        for at in range(0, len(nodes), PAIRS):
            part = slice(at, at + PAIRS)
            out[part] = np.einsum("nd,nd->n", self.x[nodes[part]], q[of[part]])
        return out

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes each query meets on ``layer`` from its row of ``start``: (nodes,
        similarities), best first, -1 where there are fewer. A beam follows its best unfollowed
        nodes, several at once if wide, until it has followed all that it holds."""
        links, b = self.links[layer], len(q)
        width = min(width, len(links))
        seen = np.zeros((b, len(links) + 1), bool)
        seen[:, -1] = True  # stands for no node
        ids, sims = np.full((b, width), -1, np.int64), np.full((b, width), -np.inf, np.float32)
        todo = np.zeros((b, width), bool)
        act, near = np.arange(b), start
        step = max(1, width // 16)
        while True:
            near = np.sort(near, axis=1)
            new = ~seen[act[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[act[:, None], near] = True
            r, c = np.nonzero(new)
            found = np.full(near.shape, -np.inf, np.float32)
            found[r, c] = self._sims(near[r, c], q, act[r])
            every = np.concatenate([sims[act], found], axis=1)
            best = np.argsort(-every, axis=1, kind="stable")[:, :width]
            sims[act] = np.take_along_axis(every, best, axis=1)
            ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(new, near, -1)], axis=1), best, axis=1)
            todo[act] = np.take_along_axis(np.concatenate([todo[act], new], axis=1), best, axis=1)
            act = np.flatnonzero(todo.any(axis=1))
            if not len(act):
                return ids, sims
            first = np.argsort(~todo[act], axis=1, kind="stable")[:, :step]
            follow = np.where(np.take_along_axis(todo[act], first, axis=1),
                              np.take_along_axis(ids[act], first, axis=1), -1)
            todo[act[:, None], first] = False
            near = np.where(follow[:, :, None] >= 0, links[follow], -1).reshape(len(act), -1)

    def _choose(self, cand: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """Diverse neighbours out of each row of candidates (best first, -1: none): nearer to the
        row's node than to any chosen one, then the nearest left."""
        v = self.x[cand]
        between = v @ v.transpose(0, 2, 1)
        most = np.full(cand.shape, -np.inf, np.float32)
        taken, count = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int64)
        for k in range(cand.shape[1]):
            good = (cand[:, k] >= 0) & (count < limit) & (sims[:, k] > most[:, k])
            taken[:, k] = good
            count += good
            most = np.where(good[:, None], np.maximum(most, between[:, k]), most)
        first = np.argsort(np.where(taken, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :limit]
        return np.take_along_axis(cand, first, axis=1)

    def _link(self, layer: int, new: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        """Link new nodes with the best of their candidates, and those back with them."""
        links = self.links[layer]
        mine = self._choose(cand, sims, M)
        links[new, :mine.shape[1]] = mine
        r, c = np.nonzero(mine >= 0)
        target, source = mine[r, c], new[r]
        sims = self._sims(target, self.x, source)
        order = np.lexsort((-sims, target))
        target, source, sims = target[order], source[order], sims[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, many)
        room = links.shape[1]
        kept = nth < room  # of more newcomers than a node has room for, the nearest
        row = np.repeat(np.arange(len(nodes)), many)
        for at in range(0, len(nodes), GROUP):
            some = slice(at, at + GROUP)
            old = links[nodes[some]]
            come = np.full(old.shape, -1, np.int64)
            here = kept & (row >= at) & (row < at + GROUP)
            come[row[here] - at, nth[here]] = source[here]
            come[(come[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([old, come], axis=1)
            near = np.where(both >= 0, np.einsum("tkd,td->tk", self.x[both], self.x[nodes[some]]), -np.inf)
            best = np.argsort(-near, axis=1, kind="stable")
            links[nodes[some]] = self._choose(np.take_along_axis(both, best, axis=1),
                                              np.take_along_axis(near, best, axis=1), room)

    def _insert(self, at: int, size: int) -> None:
        new = np.arange(at, at + size)
        q = self.x[new]
        start = np.zeros((size, 1), np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            k = min(max(len(self.links[layer]) - at, 0), size)  # the first k belong to this layer
            best = np.full((size, BUILD_BEAM), -1, np.int64)
            if k:
                ids, sims = self.beam(q[:k], start[:k], BUILD_BEAM, layer)
                best[:k, :ids.shape[1]] = ids
                each = q[:k] @ q[:k].T
                np.fill_diagonal(each, -np.inf)
                ids = np.concatenate([ids, np.where(np.isfinite(each), new[:k], -1)], axis=1)
                sims = np.concatenate([sims, each], axis=1)
                first = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                self._link(layer, new[:k], np.take_along_axis(ids, first, axis=1),
                           np.take_along_axis(sims, first, axis=1))
            if k < size:
                best[k:, :1] = self.beam(q[k:], start[k:], 1, layer)[0]
            start = best

    def hits(self, q: np.ndarray, width: int, floor: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row of ``x``) of the similarities of at least ``floor`` that each query's beam or the
        flood meets; a query whose ``start`` is not -1 begins at that row too."""
        at = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            at = self.beam(q, at, 1, layer)[0]
        own = np.where(start >= 0, self.place[start], -1)
        ids, sims = self.beam(q, np.column_stack([at, own]), width, 0)
        r, c = np.nonzero(sims >= floor)
        n = len(self.x)
        front = r * n + ids[r, c]
        seen = np.zeros(len(q) * n, bool)
        seen[front] = True
        out = [front]
        while len(front):
            near = self.links[0][front % n]
            near = np.where(near >= 0, near + (front // n * n)[:, None], front[:, None]).ravel()
            near = np.unique(near[~seen[near]])
            seen[near] = True
            front = near[self._sims(near % n, q, near // n) >= floor]
            out.append(front)
        every = np.sort(np.concatenate(out))
        return every // n, self.order[every % n]


def _task(threshold: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        nodes_all = table.column("node").to_numpy()
        is_query = table.column("is_query").to_numpy()
        copies_all = table.column("copies").to_numpy()
        x_all = table.column("embedding").combine_chunks().flatten().to_numpy().astype(
            np.float64).reshape(len(nodes_all), -1)
        order = np.lexsort((is_query, nodes_all))
        nodes_all, is_query, copies_all, x_all = (a[order] for a in (nodes_all, is_query, copies_all, x_all))
        x, nodes, copies = x_all[~is_query], nodes_all[~is_query], copies_all[~is_query]
        q, q_nodes = x_all[is_query], nodes_all[is_query]
        empty = pa.table({"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()),
                          "peer": pa.array([], pa.int64())})
        if not len(x) or not len(q):
            return empty

        def unit(a):  # scaled first: squares of very large or small numbers leave the doubles
            a = a / np.abs(a).max(axis=1)[:, None]
            return a / np.linalg.norm(a, axis=1)[:, None]

        ux, uq = unit(x), unit(q)
        own = np.searchsorted(nodes, q_nodes)
        own[(own >= len(nodes)) | (nodes[np.minimum(own, len(nodes) - 1)] != q_nodes)] = -1

        def whole(some):
            """(query, its linked nodes) by comparison with every node of the shard."""
            for at in range(0, len(some), GROUP):
                part = some[at:at + GROUP]
                for i, sims in zip(part.tolist(), uq[part] @ ux.T):
                    near = np.flatnonzero(sims >= threshold)
                    yield i, near[near != own[i]]

        graph = Graph(ux.astype(np.float32))

        def links(v, start, width):
            """Of each of ``v``, the linked nodes that its beam finds."""
            for at in range(0, len(v), GROUP):
                some, begin = v[at:at + GROUP], start[at:at + GROUP]
                of, near = graph.hits(some.astype(np.float32), width, threshold - SLACK, begin)
                good = np.zeros(len(of), bool)
                for a in range(0, len(of), PAIRS):
                    part = slice(a, a + PAIRS)
                    good[part] = np.einsum("nd,nd->n", ux[near[part]], some[of[part]]) >= threshold
                good &= near != begin[of]
                of, near = of[good], near[good]
                yield from np.split(near, np.searchsorted(of, np.arange(1, len(some))))

        def beams_wide_enough():
            """(first, full) width: doubled until the audit's queries with links find one, and all; none if no beam
            finds them."""
            rng = np.random.default_rng(5)
            order = rng.permutation(len(q))
            inside = order[own[order] >= 0]
            # among the shard's own nodes, those that the graph itself puts beside a near copy come too
            look = inside[:AUDIT_LOOK]
            beside = graph.neighbours(own[look])
            close = ((ux[np.maximum(beside, 0)] * uq[look][:, None, :]).sum(axis=2) >= threshold) & (beside >= 0)
            some = np.unique(np.concatenate([order[:AUDITED], look[close.any(axis=1)][:AUDITED]]))
            v, start = uq[some], own[some]
            n = np.array([len(near) for _, near in whole(some)], np.int64)
            if len(inside) < len(q):  # queries that have no node here to start from
                planted = ux[rng.permutation(len(x))[:AUDITED]]
                aside = rng.normal(size=planted.shape)
                aside -= (aside * planted).sum(axis=1)[:, None] * planted
                aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
                near = threshold + (1 - threshold) / 10
                probes = near * planted + np.sqrt(1 - near * near) * aside
                v, start = np.concatenate([v, probes]), np.append(start, np.full(len(probes), -1))
                n = np.append(n, ((probes @ ux.T) >= threshold).sum(axis=1))
            v, start, n = v[n > 0], start[n > 0], n[n > 0]

            def widened(width, least):
                while len(n) and any(len(near) < m for near, m in zip(links(v, start, width), least)):
                    if width >= len(x):
                        return None
                    width *= 2
                return width

            first = widened(beam, np.ones(len(n), np.int64))
            return first and (first, widened(first, n))

        def searched(first, full):
            """Every query by the first beam, those that it finds links of by the full one."""
            found = {}
            for i, near in enumerate(links(uq, own, first)):
                if len(near):
                    found[i] = near
            some = np.array(list(found), np.int64)
            return zip(some.tolist(), found.values() if full == first else links(uq[some], own[some], full))

        widths = beams_wide_enough()
        answers = searched(*widths) if widths and widths[1] else whole(np.arange(len(q)))

        label = np.arange(len(x))  # components among the shard's nodes
        count = np.zeros(len(q), np.int64)
        peer = np.full(len(q), -1)
        # links among the shard's own nodes, found from either end, a bit each
        mutual = np.zeros((len(x), (len(x) + 7) // 8), np.uint8) if (own >= 0).any() else None
        for i, near in answers:
            if not len(near):
                continue
            if own[i] >= 0:
                np.bitwise_or.at(mutual[own[i]], near >> 3, (128 >> (near & 7)).astype(np.uint8))
                mutual[near, own[i] >> 3] |= np.uint8(128 >> (own[i] & 7))
                near = np.append(near, own[i])
            else:
                count[i] = copies[near].sum()
            roots = np.unique(label[near])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
            peer[i] = roots[0]
        inside = own >= 0
        if inside.any():
            count[inside] = [copies[np.unpackbits(mutual[r], count=len(x)).astype(bool)].sum() if mutual[r].any() else 0
                             for r in own[inside]]
        joined = np.flatnonzero(label != np.arange(len(x)))
        linked = np.flatnonzero(peer >= 0)
        # counts by query; links of queries and of shard nodes to their component's first node
        return pa.table({
            "node": pa.array(np.concatenate([q_nodes[linked], nodes[joined]])),
            "n_links": pa.array(np.concatenate([count[linked], np.zeros(len(joined), np.int64)])),
            "peer": pa.array(np.concatenate([nodes[label[peer[linked]]], nodes[label[joined]]]))})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS,
                    block_rows: int = BLOCK_ROWS, beam: int = BEAM) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    vectors = clean_columns(vectors, "vec_id", "embedding", "label")
    able = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = stash(vectors.select("vec_id", "label", F.when(able, F.col("embedding")).alias("embedding"),
                                F.when(able, F.md5(F.col("embedding").cast("string"))).alias("key")), "hnsw-rows")
    nodes = stash(rows.filter("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
        F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
        .withColumn("node", F.monotonically_increasing_id()), "hnsw-nodes")
    sizes = nodes.groupBy("label", "dim").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / shard_rows), F.lit(1)).cast("int").alias("shards"),
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(1)).cast("int").alias("blocks"))
    sized = nodes.join(sizes, ["label", "dim"])
    h = F.xxhash64("key")
    cols = ["label", "dim", "shard", "block", "is_query", "node", "copies", "embedding"]

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    graphs = sized.withColumn("shard", F.pmod(h, F.col("shards")).cast("int")).withColumn(
        "is_query", F.lit(False)).withColumn("block", each("blocks")).select(cols)
    queries = sized.withColumn("block", F.pmod(h, F.col("blocks")).cast("int")).withColumn(
        "is_query", F.lit(True)).withColumn("shard", each("shards")).select(cols)
    # dealt by ranges of the whole key, at most one task a partition: rows are few for the
    # work they cost, and a hash would put several tasks into one partition
    tasks = sizes.agg(F.sum(F.col("shards").cast("long") * F.col("blocks"))).first()[0] or 1
    dealt = graphs.unionByName(queries).repartitionByRange(
        min(2 * tasks, MAX_TASKS), "label", "dim", "shard", "block")
    found = stash(dealt.groupBy("label", "dim", "shard", "block").applyInArrow(
        _task(threshold, beam), "node long, n_links long, peer long"), "hnsw-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = (nodes.select("node", "label", "key", "first_id", "copies").join(counts, "node", "left")
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(least, "root").select(
        "label", "key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), "component_id")
    return (rows.select("vec_id", "label", "key").join(by_key, ["label", "key"], "left")
            .select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
