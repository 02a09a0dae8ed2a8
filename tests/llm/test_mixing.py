"""Source mixing: targets by iteration, quotas, copies, determinism."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docscope.llm import mixing as M


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            out.update({s: w[s] * level for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


CASES = [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 40, "d": 0}, {None: 7},
         {f"s{i}": 10 ** (i % 4) for i in range(12)}, {"a": 0}, {"é": 5, "z": 50, "Z": 500}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target or 0.0 for r in M.targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_hypergeometric_has_its_mean_and_variance(spark):
    total, marked, draws, n = 200, 60, 50, 4000
    df = spark.range(n).select(F.expr("(id + 0.5D) / {}".format(n)).alias("u"))
    got = [r[0] for r in df.select(F.expr(M.hypergeometric(f"{total}L", f"{marked}L", f"{draws}L", "u"))).collect()]
    mean = sum(got) / n
    var = sum((g - mean) ** 2 for g in got) / n
    p = marked / total
    assert abs(mean - draws * p) < 0.01
    assert abs(var - draws * p * (1 - p) * (total - draws) / (total - 1)) < 0.05
    edges = spark.range(1).select(*[F.expr(M.hypergeometric(f"{a}L", f"{b}L", f"{c}L", "0.5D"))
                                    for a, b, c in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5), (5, 3, 4))]).first()
    assert tuple(edges)[:4] == (0, 3, 0, 2) and edges[4] in (2, 3)


def test_quotas_are_exact(spark):
    blocks = {0: 100, 1: 37, 2: 0, 3: 999, 4: 1}
    df = spark.createDataFrame(list(blocks.items()), "rank int, blocks long")
    for n in (16, 5, 1):
        ends = {r["rank"]: list(r["ends"]) for r in M.split_quotas(df, n, 3).collect()}
        assert {k: v[-1] for k, v in ends.items()} == blocks
        assert all(v == sorted(v) and len(v) == n for v in ends.values())
        share = [sum(v[s] - (v[s - 1] if s else 0) for v in ends.values()) for s in range(n)]
        assert max(share) - min(share) <= 4  # every split rounds once


def M_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def docs(spark, n=900):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abcde"[i % 5] if i % 3 else "hot", "x") for i in range(n)]
    rows += [(n, None, "a", "x"), (n + 1, "", "f", "x"), (n + 2, "two words", None, "x"), (3, "again\tand\x0bagain", "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard string"), rows


def test_plan(spark):
    df, rows = docs(spark)
    plan = M.plan_mix(df, range_rows=50).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((i, M_words(t)) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += M_words(t)
    want, taken = targets(sizes), Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 16 for s in r.shards)
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = M.plan_mix(df.repartition(5), range_rows=50).collect()
    key = lambda r: (r.doc_id, r.size, r.copies, tuple(r.shards))
    assert Counter(map(key, plan)) == Counter(map(key, again))


def test_mixed_documents_keep_columns_and_shards_are_even(spark):
    df, _ = docs(spark)
    out = M.mixed_documents(df)
    assert set(df.columns) <= set(out.columns) and "mix_shard_" in out.columns
    taken, shard = Counter(), defaultdict(int)
    for r in out.collect():
        n = M_words(r.text)
        taken[r.source] += n
        shard[r.mix_shard_] += n
    sizes = Counter()
    for _, t, s, _ in docs(spark)[1]:
        sizes[s] += M_words(t)
    assert all(abs(taken[s] - want) <= 40 for s, want in targets(sizes).items())
    assert len(shard) == 16 and max(shard.values()) < 1.6 * min(shard.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.plan_mix(df).count() == 0
    assert M.mixed_documents(df).count() == 0


def test_native(spark):
    df, _ = docs(spark, 30)
    for out in (M.plan_mix(df), M.mixed_documents(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_same_rows_in_other_splits_give_the_same_mix(spark):
    rows = [(i % 40 if i % 7 else None, "w " * (i % 23), "abc"[i % 3] if i % 11 else None, f"x{i % 5}")
            for i in range(300)]
    rows += rows[:30]
    runs = []
    for n, order in ((1, 1), (7, -1)):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string, source string, mix_shard string")
        docs = docs.repartition(n)
        runs.append(sorted(map(str, M.mixed_documents(docs, n_shards=4, range_rows=50).collect())))
        out = M.shuffled_documents(docs, n_shards=4, range_rows=50)
        assert out.columns == docs.columns
        runs.append([str(r) for r in out.collect()])
    assert runs[0] == runs[2] and sorted(runs[1]) == sorted(runs[3])
    assert runs[1] == runs[3]  # shard after shard, shuffled inside
    assert len(runs[0]) == len(runs[1]) > 0
