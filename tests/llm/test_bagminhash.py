"""BagMinHash near-duplicates against brute force on whole multisets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docscope.llm import bagminhash as B
from docscope.llm.components import components


def multiset(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows):
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}


def test_registers_agree_as_often_as_weighted_jaccard():
    texts = ["a b c d e " * 40, "a b c d e " * 25, " ".join(f"w{i}" for i in range(200)),
             " ".join(f"w{i}" if i < 120 else f"v{i}" for i in range(200)), "one", "x " * 500, "x " * 400]
    doc, h, count = B.shingles(texts, B.WordHashes())
    reg = B.signatures(doc, h, count, len(texts), 4096)
    for i, j in ((0, 1), (2, 3), (5, 6), (0, 2)):
        want = similarity(multiset(texts[i]), multiset(texts[j]))
        assert abs((reg[i] == reg[j]).mean() - want) < 0.035


def test_signature_does_not_depend_on_the_batch():
    texts = [t for _, t in make_rows(3)]

    def sign(part):
        doc, h, count = B.shingles(part, B.WordHashes())
        return B.signatures(doc, h, count, len(part))

    whole = sign(texts)
    for lo in range(0, len(texts), 7):
        assert (sign(texts[lo:lo + 7]) == whole[lo:lo + 7]).all()


def make_rows(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    base = [" ".join(rng.choices(vocab, k=rng.randint(20, 160))) for _ in range(40)]
    for text in base:
        add(text)
    for text in base[:20]:  # near copies, some chained
        words = text.split()
        for _ in range(4):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocab)
            add(" ".join(words))
    for _ in range(15):
        add(base[3])  # exact copies
    passage = " ".join(rng.choices(vocab, k=60))
    for _ in range(25):  # a passage that many documents share
        add(passage + " " + " ".join(rng.choices(vocab, k=rng.randint(3, 40))))
    for text in (None, "", "  \n", "one two", "one two", "ONE  two", "a b c d", "z " * 3000, "z " * 2900, "z " * 2000):
        add(text)
    return rows


def test_classes_equal_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = {r.doc_id: r.class_id for r in B.duplicate_classes(df).collect()}
    assert got == classes(rows)


def test_keep_one_keeps_columns_and_one_row_per_class(spark):
    rows = make_rows(2)
    rows = rows + [rows[0], (None, rows[1][1]), (None, None), (7_000, None)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows],
                               "doc_id long, text string, bmh_key string, class_id string")
    out = B.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    want = [i for i, c in classes([r for r in rows if r[0] is not None]).items() if i == c]
    assert got == sorted([(False, i) for i in want] + [(True, 0)])


def test_rows_without_doc_id_equal_brute_force(spark):
    rng = random.Random(5)
    unnamed = 1_000_000  # stands for no doc_id, above all others
    rows = [(i, t) for i, t in make_rows(4) if (t or "").split()]
    rows = [(unnamed + i if rng.random() < 0.5 or i < 8 else i, t) for i, t in rows]
    # a class of near copies that no row with a doc_id belongs to, with copies
    words = [f"u{i}" for i in range(100)]
    for k in range(6):
        rows += [(unnamed + 900 + 2 * k + j, " ".join(words[:99 - k] + [f"v{k}"])) for j in range(2)]
    want = classes(rows)
    df = spark.createDataFrame([(i if i < unnamed else None, t) for i, t in rows], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, bytes(r.key)) for r in B.duplicate_classes(df).collect())
    digest = {t: hashlib.md5(t.encode()).digest() for _, t in rows}

    def name(i):
        return i if i < unnamed else None

    assert got == Counter((name(i), name(want[i]), digest[t]) for i, t in rows)
    assert sum(c >= unnamed for c in want.values()) > 12 and any(i >= unnamed > c for i, c in want.items())
    kept = sorted((r.doc_id or unnamed, r.text) for r in B.keep_one(df).collect())
    first = {}
    for i, t in rows:
        if want[i] >= unnamed:
            first[want[i]] = min(first.get(want[i], t), t, key=digest.get)
    assert kept == sorted([(i, t) for i, t in rows if i == want[i] < unnamed] + [(unnamed, t) for t in first.values()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.duplicate_classes(df).count() == 0
    assert B.keep_one(df).count() == 0


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(1, 1), (2, 3), (3, 2), (7, 3)],
    [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_shingles_of_short_and_long_texts():
    texts = ["", None, "a", "a b", "a b c d e", "a b c d e f", "q " * 5000]
    doc, h, count = B.shingles(texts, B.WordHashes())
    size = np.bincount(doc, weights=count, minlength=len(texts))
    assert size.tolist() == [0, 0, 1, 1, 1, 2, 4996]
    assert (np.bincount(doc, minlength=len(texts)) == [0, 0, 1, 1, 1, 2, 1]).all()


def passage_rows(n, own, seed=11):
    """Documents that share one passage of 60 words and hold ``own`` words of their own."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    return [(i, " ".join(passage + [f"d{i}x{rng.randrange(10 ** 6)}" for _ in range(own)])) for i in range(n)]


def _sets(spark, rows):
    """(node, members) and (node, root) with every text its own component."""
    from docscope.llm.common import prepare
    prepare(spark)
    docs = spark.createDataFrame(rows, "node long, text string")
    sets = docs.mapInArrow(B._multisets, "node long, members array<bigint>")
    return sets, docs.selectExpr("node", "node as root")


@pytest.mark.parametrize("own", [4, 6, 7, 8, 9, 20])
def test_texts_that_share_a_passage_meet_only_if_similar(spark, own):
    rows = passage_rows(60, own)
    sets, roots = _sets(spark, rows)
    got = {tuple(sorted((r.a, r.b))) for r in B.prefix_pairs(sets, roots).collect()}
    bags = [multiset(t) for _, t in rows]
    want = {(i, j) for j in range(60) for i in range(j) if similarity(bags[i], bags[j]) >= 0.8}
    assert got == want  # nothing missed, and none built in vain: all pairs or no pair


def test_prefix_pairs_miss_no_similar_pair(spark):
    rng = random.Random(8)
    rows = []
    for i in range(140):
        base = [f"w{rng.randrange(6)}_{j}" for j in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(rng.choice([base, base * 2, base[:-1] + ["end"]]))))
        if i % 2:
            words = rows[rng.randrange(i)][1].split()
            words[rng.randrange(len(words))] = "changed"
            rows[i] = (i, " ".join(words))
    sets, roots = _sets(spark, rows)
    got = {tuple(sorted((r.a, r.b))) for r in B.prefix_pairs(sets, roots).collect()}
    bags = [multiset(t) for _, t in rows]
    want = {(i, j) for j in range(140) for i in range(j) if similarity(bags[i], bags[j]) >= 0.8}
    assert want and want <= got


def test_large_passage_group_equals_brute_force(spark):
    rows = passage_rows(120, 8) + [(1000 + i, t) for i, t in passage_rows(40, 3, seed=4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in B.duplicate_classes(docs).collect()}
    assert got == classes(rows)
