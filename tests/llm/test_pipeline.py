"""The pipeline's stages, each against a plainer version, on documents with edge rows."""

from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from docscope.llm import quality, toxicity
from docscope.llm.common import stash
from docscope.llm.sentencepiece_codec import default_model
from test_bagminhash import classes
from test_mixing import M_words, targets

SF = "/root/testdata/sf0.001"
EDGES = [(90_001, None, "en", "a", None), (90_002, "", None, None, 0), (90_003, "  \n", "en", "a", 3),
         (90_004, "word " * 30_000, "en", None, 1), (90_005, "same text here for two rows", "en", "b", 1),
         (90_006, "same text here for two rows", "de", "c", 1), (90_005, "same text here for two rows", "en", "b", 1),
         (None, "a row without an id and enough words to be a shingle", "en", "b", 1)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = stash(docs.unionByName(spark.createDataFrame(EDGES, docs.schema)), "test-docs")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stash(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "mix", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert P.ORACLE_SQL is None


def test_classifier_stages_drop_what_they_score(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = stages[0].columns
    x = toxicity.score_documents(stages[0], toxicity.fit(stages[0], labels), names).filter("p_toxic < 0.5")
    assert rows(stages[1]) == rows(x)
    q = quality.score_documents(stages[1], quality.fit(stages[1], labels), names).filter(F.col("score") >= 0.3)
    assert rows(stages[2]) == rows(q)


def test_near_duplicate_stage_keeps_one_of_each_class(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    after = Counter((r.doc_id, r.text) for r in stages[3].collect())
    with_id = list(dict.fromkeys(r for r in before if r[0] is not None))
    kept = {i for i, c in classes(with_id).items() if i == c}
    want = Counter()
    for r in before:
        if r[0] is None or r[0] in kept:
            want[r] = want[r] + 1 if not (r[1] or "").split() else 1
    assert after == want


def test_mix_stage_follows_the_targets(stages):
    size, taken, longest = Counter(), Counter(), Counter()
    for r in stages[3].collect():
        n = M_words(r.text)
        size[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in stages[4].collect():
        taken[r.source] += M_words(r.text)
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in targets(size).items())
    assert max(rows(stages[4]).values()) <= 3 * max(rows(stages[3]).values())


def test_token_stage_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in stages[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages[5].collect()) == want


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered(spark):
    names = set(E.queries())
    assert "pipeline" in names
    assert {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
