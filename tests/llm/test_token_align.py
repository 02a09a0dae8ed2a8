"""Token alignment against plain loops over whole texts, without units."""

import hashlib
import random
from collections import Counter

import pytest

from docscope.llm import token_align as T


@pytest.fixture(scope="module")
def both():
    a, b = T.vocabulary_files()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return T.Tokenizers(f.read(), g.read())


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(both, texts):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum)."""
    docs = []
    for t in texts:
        a = both.a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(([], [], [], []))
            continue
        x, y = spans(x), spans(y)
        links = [(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if p[0] < q[1] and q[0] < p[1]]
        groups, start = [], 0
        for end in sorted({p[1] for p in x} & {q[1] for q in y}):
            groups.append("|".join(",".join(str(i) for i, p in zip(ids, at) if start <= p[0] and p[1] <= end)
                                   for ids, at in ((a, x), (b, y))))
            start = end
        docs.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    count = Counter(p for d in docs for p in d[3])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(len(a), len(b), len(g), len(l), ";".join(g), sum(count[p] == highest[p[1]] for p in l),
             sum(count[p] for p in l)) for a, b, g, l in docs]


ODD = [None, "", " ", "  ", "\n", " \n x", "a  b", "a\n\n  b", "tab\t x  y", "x 　 y", "▁a b", "a▁ b",
       "<|endoftext|> it's <s> </s> <unk> <0x0A>", "naïve café ﬁ é é", "日本語のテキスト です", "🙂 👍🏽 x", "a\u0000b \u0000 c",
       "x\u001c y \u0085 z", "᠎ a ᠎ b", "don't we'll I'M  'S", "1 234  5678", "...  !!! ??", "a" * 3000,
       "longwordwithoutspaces" * 40, "  lead and trail  ", "﻿ bom ​ zero", "same text here", "same text here", "one trailing ", "x "]


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    out = T.align_documents(docs, **options).orderBy("doc_id").collect()
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"], r["n_best"], r["count_sum"]) for r in out]


def test_edges_against_whole_texts(spark, both):
    assert run(spark, ODD) == brute(both, ODD)


def test_random_texts_and_small_chunks(spark, both, monkeypatch):
    rng = random.Random(3)
    words = ["the", "Thonre", "naïve", "it's", "x", "12", "(a", "b)", "\n", "\t", "", "über", "日本", "foo.\nbar", "ing's"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(150)] + ODD
    want = brute(both, texts)
    assert run(spark, texts) == want
    monkeypatch.setattr(T, "CHUNK_UNITS", 5)  # a new chunk after every batch
    assert run(spark, texts) == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_digests_its_groups(spark, both):
    import __spark_entry__ as E

    from docscope.sources.tables import table

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in E.queries()["op12_token_align"](spark, sf).collect()}
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = brute(both, [r["text"] for r in rows if len(r["text"] or "") < 4000])
    small = [r["doc_id"] for r in rows if len(r["text"] or "") < 4000]
    assert len(got) == len(rows)
    for d, w in zip(small, want):  # counts cover longer documents too, so only their own columns are compared
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == w[:4]
        assert r["groups_sha256"] == (hashlib.sha256(w[4].encode()).hexdigest() if w[0] else "")
