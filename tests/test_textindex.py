"""Index searches against the scans they replace."""

import random
import re

import pytest

from conftest import SF_SMOKE

from docscope.operators import search as S
from docscope.operators import textindex as TI

TEXTS = [("Install Guide", "how to install\tthe thing"), ("Search", "searching INSTALL"), ("", None), (None, ""),
         ("Über uns", "GRÜSSE aus Köln, ΣΊΣΥΦΟΣ"), ("100% a_b", "back\\slash 50%_off"), ("aaa", "aaaaaaa"), ("ab", "x"),
         ("a", "b"), ("in", "stall in stall"), ("tail", "ends in in"), ("𝄞 clef", "𝄞𝄞𝄞 notes"), ("line", "one\ntwo in\nstall")]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = list(TEXTS) + [(" ".join(rng.choices(["in", "stall", "Ab", "ba", "aab"], k=3)),
                           "".join(rng.choices("ab In", k=rng.randrange(40)))) for _ in range(150)]
    return spark.createDataFrame([(i, t, b, 0, i) for i, (t, b) in enumerate(rows)],
                                 "id long, title string, text string, pord int, uord long").cache()


def _stored(spark, postings, path):
    TI.write_postings(postings, path)
    return spark.read.parquet(path)


def test_keyword_search_equals_the_scan(spark, texts, tmp_dir):
    postings = _stored(spark, TI.token_postings(texts, "id", ["title", "text"]), tmp_dir + "/tokens")
    dictionary = TI.token_dictionary(postings).cache()
    for terms in (["in"], ["in", "stall"], ["IN*all"], ["in stall"], ["stall*"], ["*"], [], [""], ["%_"], ["%"], ["\\"],
                  ["ÜBER"], ["σίσυφος"], ["missing"], ["in", "missing"], [" "], ["a b"], ["ab", "in st"], ["𝄞"]):
        got = {r.id for r in TI.keyword_search(texts, "id", dictionary, postings, terms, ["title", "text"]).collect()}
        want = {r.id for r in S.keyword_filter(texts, terms, ("title", "text")).collect()}
        assert got == want, terms
    only = TI.keyword_search(texts, "id", dictionary, postings, ["install"], ["title"])
    assert {r.id for r in only.collect()} == {0}


def test_large_dictionary_matches_are_not_broadcast(spark, texts, monkeypatch):
    postings = TI.token_postings(texts, "id", ["title", "text"]).cache()
    dictionary = TI.token_dictionary(postings).cache()
    monkeypatch.setattr(TI, "MATCH_BYTES", 10)
    hits = TI.keys_with_fragment(dictionary, postings, "a", ["title", "text"])
    assert "ResolvedHint" not in hits._jdf.queryExecution().analyzed().toString()
    want = {r.id for r in S.keyword_filter(texts, ["a"], ("title", "text")).collect()}
    assert {r.key for r in hits.collect()} == want


def test_substring_search_equals_the_scan(spark, texts, tmp_dir):
    postings = _stored(spark, TI.gram_postings(texts, "id", ["title", "text"]), tmp_dir + "/grams")
    for q in ("in", "aa", "aaa", "aaaa", "aaaaa", "aaaaaa", "aaaaaaaa", "install", " Stall ", "in stall", "ab", "bab a", "𝄞𝄞",
              "𝄞𝄞𝄞", "zz", "zzzz", "ö", "x", "", None, "köln,", "σίσ", "two in\nst", "ing install"):
        got = TI.substring_search(texts, "id", postings, q, ["title", "text"])
        want = S.substring_hits(texts, q)
        if want is None:
            assert got is None
        else:
            assert {r.id for r in got.collect()} == {r.id for r in want.collect()}, q


def test_cover():
    assert TI.cover("ab") == [] and TI.cover("abc") == [(0, "abc")]
    assert TI.cover("abcd") == [(0, "abc"), (1, "bcd")]
    assert TI.cover("abcdefg") == [(0, "abc"), (3, "def"), (4, "efg")]


def _scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]


@pytest.mark.parametrize("name,columns", [
    ("keyword_search", ("text", "body", "parts")), ("page_of_results", ("text", "body", "parts")),
    ("documents_keyword_search", ("text",)), ("documents_page_of_results", ("text",)),
    ("documents_page_after", ("text",)), ("substring_search", ("text",))])
def test_searches_read_no_text(spark, name, columns):
    from docscope.plans.queries import QUERIES
    scans = _scans(QUERIES[name](spark, SF_SMOKE))
    assert scans
    for line in scans:
        schema = line.split("ReadSchema: struct<")[1]
        assert not any(f"{c}:" in schema for c in columns), line


def test_searches_name_their_partitions(spark):
    from docscope.plans import corpus as C
    rows = TI.substring_keys(C.gram_index(spark, SF_SMOKE), "ing", ["title", "text"])
    (scan,) = _scans(rows)
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", scan) and "EqualTo(gram,ing)" in scan


def _repeated(spark, rows_of_key=1):
    """Null keys, repeated words, null and empty texts, repeated keys if asked for; one partition."""
    rows = [(None if i % 10 == 7 else i // rows_of_key, "one two two", "three\vone  " * (i % 3) if i % 4 else None)
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, title string, text string").coalesce(1)


def test_token_postings_are_lists_of_documents(spark, monkeypatch, tmp_dir):
    """a row for each token and segment, not for each token and document."""
    df = _repeated(spark, 2)
    postings = _stored(spark, TI.token_postings(df, "id", ["title", "text"]), tmp_dir + "/whole")
    got = {(r.token, r.field): sorted(r["keys"], key=str) for r in postings.collect()}
    assert postings.count() == len(got) == 4
    rows = df.collect()
    for (token, field), keys in got.items():
        assert keys == sorted((r.id for r in rows if token in re.split(r"\s+", r[field] or "")), key=str)
    monkeypatch.setattr(TI, "SEGMENT", 50)
    monkeypatch.setattr(TI, "SEGMENT_BYTES", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        cut = _stored(spark, TI.token_postings(df, "id", ["title", "text"]), tmp_dir + "/cut")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert cut.count() > 20
    for terms in (["two"], ["ree", "one"], ["two three"]):
        want = sorted(r.id for r in S.keyword_filter(df, terms, ("title", "text")).where("id is not null").collect())
        for p in (postings, cut):
            hits = TI.keyword_search(df, "id", TI.token_dictionary(p), p, terms, ["title", "text"])
            assert {r.id for r in hits.collect()} == set(want), terms


def test_gram_postings_are_lists_of_places(spark, monkeypatch, tmp_dir):
    """a row for each gram and segment, not for each place, so a task sorts few rows."""
    df = _repeated(spark)
    postings = _stored(spark, TI.gram_postings(df, "id", ["title", "text"]), tmp_dir + "/whole")
    grams = [(r.gram, r.field) for r in postings.collect()]
    assert len(grams) == len(set(grams)) < 40
    places = {(g, f, k, p) for r in postings.collect() for g, f, k, p in
              zip([r.gram] * len(r["keys"]), [r.field] * len(r["keys"]), r["keys"], r.places)}
    assert places == {(t[i:i + 3], f, r.id, i) for r in df.collect() for f in ("title", "text")
                      for t in [r[f] or ""] for i in range(len(t))}
    monkeypatch.setattr(TI, "SEGMENT", 50)
    cut = _stored(spark, TI.gram_postings(df, "id", ["title", "text"]), tmp_dir + "/cut")
    for q in ("two", "tw", "o two", "\vone", "e  three"):
        want = {r.id for r in S.substring_hits(df, q).where("id is not null").collect()}
        for p in (postings, cut):
            assert {r.id for r in TI.substring_search(df, "id", p, q, ["title", "text"]).collect()} == want, q
