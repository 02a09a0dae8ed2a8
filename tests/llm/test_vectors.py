"""Neighbour search and embedding near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docscope.llm import ann_forest as A
from docscope.llm import hnsw_dedup as D

BAD = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [1.0] * 7]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, node int")


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:90] = x[50]  # equal vectors: ties by vec_id
    rows = [(i, [float(v) for v in x[i]], 0, 1, 1) for i in range(600)]
    rows += [(10_000 + 100 * k, b, 0, 1, 1) for k, b in enumerate(BAD)] + [(None, rows[0][1], 0, 1, 1)]
    rows += [(20_000, [1.0, 2.0], 0, 1, 1)]  # of another length: no candidates
    got = A.search(table(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=200, block_rows=3, target=1.0).collect()
    ids = np.arange(600)
    hit = 0
    for q in range(0, 600, 100):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        assert np.allclose([m[2] for m in mine], d[[m[1] for m in mine]], rtol=0, atol=1e-12)
        hit += len(set(ids[np.lexsort((ids, d))][:10]) & {m[1] for m in mine})
    assert hit >= 0.9 * 60
    assert {r.query_id for r in got} == set(range(0, 600, 100))


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = A.search(df, F.col("vec_id") % 20 == 0).toPandas()
    all_ = df.toPandas().sort_values("vec_id")
    x, ids = np.array(all_.embedding.tolist(), float), all_.vec_id.values
    hit = total = 0
    for q, part in got.groupby("query_id"):
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]]) & set(part.vec_id))
        total += 10
    assert total == 1000 and hit / total >= 0.9


def test_forest_holds_every_row_in_every_tree():
    x = np.random.default_rng(1).normal(size=(500, 6))
    x[:300] = 1.0
    f = A.Forest(x, trees=5, leaf=16)
    leaves = np.concatenate(list(f.leaves.values()))
    assert (np.bincount(leaves, minlength=500) == 5).all()
    assert max(map(len, f.leaves.values())) <= 16


def test_few_candidates_and_empty(spark):
    df = table(spark, [(0, [1.0, 0.0], 0, 0, 0), (1, [0.0, 1.0], 0, 0, 0)])
    got = A.search(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1)]
    assert A.search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_rows": 45, "beam": 4}])
def test_near_duplicates(spark, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows, n = [], 0
    for k, b in enumerate(base):
        for _ in range(1 + (k % 4) * 3 + 60 * (k == 7)):
            v = b / np.linalg.norm(b) + rng.normal(size=16) * (0.03 if k % 3 else 0.08) / 4
            rows.append((n, [float(np.float32(c)) for c in v * (10.0 ** (k % 5 - 2))], k % 3 if k % 7 else None, 1, 1))
            n += 1
    rows += [(n + i, rows[i * 5][1], rows[i * 5][2], 1, 1) for i in range(20)]  # exact copies
    n += 20
    rows += [(n + k, b, 1, 1, 1) for k, b in enumerate(BAD)] + [(n + 10, [1.0, 1.0], 1, 1, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in D.near_duplicates(table(spark, rows), **options).collect()}
    ok = {}
    for i, e, l, _, _ in rows:
        if l is not None and e and None not in e and np.isfinite(e).all() and any(e):
            ok[i] = (l, np.array(e, float))
    links = {i: set() for i, *_ in rows}
    for i in ok:
        for j in ok:
            if i < j and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]):
                a, b = ok[i][1], ok[j][1]
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    want = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(links[i]), min(seen), min(seen) == i)
    assert got == want


class Pruned(D.Graph):
    """A graph whose pruning has left a third of the nodes without in-links."""

    def __init__(self, x, seed=3):
        super().__init__(x, seed)
        self.links[0][self.links[0] % 3 == 0] = -1


@pytest.mark.parametrize("linked", [4, 600])
def test_task_finds_links_that_no_beam_reaches(monkeypatch, linked):
    # queries of other shards against a shard of 900: near copies of the first ``linked`` nodes, the rest alone
    monkeypatch.setattr(D, "Graph", Pruned)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    q = rng.normal(size=(900, 24)).astype(np.float32)
    q[:linked] = x[:linked] + rng.normal(size=(linked, 24)).astype(np.float32) * 0.02
    rows = pa.table({
        "node": np.arange(1800), "is_query": np.arange(1800) >= 900, "copies": np.full(1800, 2),
        "embedding": pa.array([v.tolist() for v in np.concatenate([x, q])], pa.list_(pa.float32()))})
    got = D._task(0.98, 24)(rows).to_pylist()
    assert sorted((r["node"], r["n_links"], r["peer"]) for r in got) == [(900 + i, 2, i) for i in range(linked)]


@pytest.mark.parametrize("linked", [0, 30])
def test_answers_come_from_the_graph(monkeypatch, linked):
    """Clean data too is searched, not compared whole: the audit is of a fixed size."""
    searched = []
    hits = D.Graph.hits

    def watched(self, q, *rest):
        searched.extend(q)
        return hits(self, q, *rest)

    monkeypatch.setattr(D.Graph, "hits", watched)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[1500 - linked:] = x[:linked] + rng.normal(size=(linked, 24)).astype(np.float32) * 0.02
    both = np.concatenate([x, x])
    rows = pa.table({"node": np.tile(np.arange(1500), 2), "is_query": np.arange(3000) >= 1500,
                     "copies": np.full(3000, 1), "embedding": pa.array(both.tolist(), pa.list_(pa.float32()))})
    got = {r["node"]: r["n_links"] for r in D._task(0.98, 24)(rows).to_pylist() if r["n_links"]}
    assert got == {i: 1 for i in [*range(linked), *range(1500 - linked, 1500)]}
    assert len(searched) >= 1500


def test_no_rows(spark):
    df = table(spark, [(1, None, 1, 1, 1), (2, [1.0], None, 1, 1)])
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in D.near_duplicates(df).collect()) == [
        (1, 0, 1, True), (2, 0, 2, True)]
    assert D.near_duplicates(df.limit(0)).count() == 0
