"""Spelling variants against counting and comparing word by word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docscope.llm import spelling as S

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute_counts(rows, delete_every=97, min_chars=5, min_count=3):
    n = Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % delete_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def one_error(words, word):
    """Words of the set that one insertion, deletion or replacement makes of ``word``."""
    letters = {c for w in words for c in w}
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cuts if b}
    made |= {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return (made & words.keys()) - {word}


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        near = one_error(words, w)
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def groups(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return [tuple(r) for r in S.variant_groups(table, **options).collect()]


def vocabulary(seed, n, letters="abcé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randrange(1, longest))): rng.randrange(3, 60) for _ in range(n)}


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcé"), (3, "abcdefghijklmnopqrstuvwxyzÿ×"), (4, "aあ😀")])
def test_search_finds_every_near_word_once(seed, letters):
    words = list(vocabulary(seed, 400, letters))
    index, got = S.BidirectionalIndex(words), Counter()
    for rightwards in (True, False):
        for w, v in zip(*S.find_near(index, words, rightwards)):
            if rightwards or not words[v].startswith(words[w][:len(words[w]) // 2]):
                got[words[w], words[v]] += 1
    want = {(w, v) for w in words for v in one_error(dict.fromkeys(words), w)}
    assert set(got) == want and set(got.values()) <= {1}


def test_words_with_letters_the_index_lacks():
    index = S.BidirectionalIndex(["house", "hause", "mouse"])
    who, found = S.find_near(index, ["houße", "ßouse", "zzzzz"], True)
    assert list(zip(who, found)) == [(0, 0)]
    who, found = S.find_near(index, ["houße", "ßouse", "zzzzz"], False)
    assert list(zip(who, found)) == [(1, 0), (1, 2)]


def test_intervals_of_both_directions_agree():
    index = S.BidirectionalIndex(["banana", "bandana", "ananas"])
    codes = index.encode(["ana"])[0]
    low, high, mirror = np.array([0]), np.array([index.n]), np.array([0])
    for c in codes[::-1]:
        low, high, mirror = index.extend(False, np.array([c]), low, high, mirror)
    other, end, back = np.array([0]), np.array([index.n]), np.array([0])
    for c in codes:
        other, end, back = index.extend(True, np.array([c]), other, end, back)
    assert (high - low).tolist() == (end - other).tolist() == [5]
    assert mirror.tolist() == other.tolist() and back.tolist() == low.tolist()


def test_groups_over_many_shards(spark):
    words = vocabulary(7, 900, "abcdé") | {"x" * 700: 9, "x" * 701: 30, "y" + "x" * 700: 4}
    want = brute(words)
    assert set(groups(spark, words)) == want
    got = groups(spark, words, shard_words=70, block_words=40)  # frequent halves lie over several shards
    assert len(got) == len(want) and set(got) == want


def test_chains_ties_and_small_vocabularies(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 5, "zzzyz": 10, "zzzxz": 10}
    assert set(groups(spark, words)) == brute(words)
    assert groups(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    assert groups(spark, {}) == []


def test_counts_and_edges(spark):
    rows = [(1, "House HOUSE house, hôuse; Ôther ôther"), (2, None), (3, ""), (None, "house house naïve×÷ Äpfel äpfel"),
            (None, "123 -- abcd abcd abcd"), (3, "x" * 5000), (3, "x" * 5000), (3, "x" * 5000)] + [
        (i, "colour color colours flavour flavor honour") for i in range(300)]
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string")
    for every in (97, 7):
        got = {r["word"]: r["n"] for r in S.word_counts(docs, delete_every=every).collect()}
        assert got == brute_counts(rows, every)
    assert len(got) > 20  # many runs have lost a letter
    assert S.word_counts(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    import __spark_entry__ as E

    from docscope.sources.tables import table

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = E.queries()["op11_spelling_fm"](spark, sf).collect()
    want = brute(brute_counts(rows))
    assert len(got) == len(want)
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
