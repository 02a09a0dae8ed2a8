"""Differencing shards: balance, indivisible groups, gapless slots."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from docscope.llm import sharding as S


def final_sums(partials, labels, k):
    out = [0] * k
    for p, l in zip(partials, labels):
        assert sorted(l) == list(range(k))
        for j in range(k):
            out[l[j]] += p[j]
    return out


@pytest.mark.parametrize("k", [2, 3, 16])
def test_difference_balances(k):
    rng = random.Random(k)
    partials = [[rng.randint(1, 1000)] + [0] * (k - 1) for _ in range(500)]
    labels, sums = S.difference(partials)
    assert sorted(final_sums(partials, labels, k)) == sorted(sums)
    assert max(sums) - min(sums) <= 3


def test_difference_known_case():
    # the textbook example of the method: 8, 7, 6, 5, 4 in two halves differ by 2
    _, sums = S.difference([[x, 0] for x in (8, 7, 6, 5, 4)])
    assert sorted(sums) == [14, 16]
    assert S.difference([]) == ([], [])
    assert S.difference([[3, 9, 1]])[1] == [9, 3, 1]


@pytest.mark.parametrize("options", [{}, {"block_rows": 20, "fan_in": 3, "slot_rows": 2}])
def test_shards(spark, options):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300)))) for i in range(400)]
    rows += [(1000 + i, "copy of one text " * 5) for i in range(120)]
    rows += [(5000, None), (5001, None), (5002, ""), (5003, "")] + [(None, "no id"), (7, "again")] + [rows[3]]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")
    out = S.shard_documents(df, **options).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by_text = defaultdict(set)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
        if r.size > 1:
            by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = 120 * (len("copy of one text ") * 5 + 1)
    others = [b for s, b in sizes.items() if s not in by_text[zlib.crc32(("copy of one text " * 5).encode())]]
    assert max(sizes.values()) == copies or max(sizes.values()) - min(sizes.values()) < 400
    assert max(others) - min(others) < 400


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
