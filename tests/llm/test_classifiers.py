"""Toxicity chain and quality classifier: held-out accuracy, edge cases, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docscope.llm import quality as Q
from docscope.llm import toxicity as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    out = Q.score_documents(docs, Q.fit(docs, labels))
    rows = out.join(labels, "doc_id").filter(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).collect()
    assert len(rows) > 40
    assert sum((r.score >= Q.CUT) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.col("doc_id"), F.lit(4)) == 0
    out = X.score_documents(docs, X.fit(docs, labels.filter(~held)))
    rows = out.join(labels, "doc_id").filter(held).collect()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.p_toxic >= X.CUT for r in clean) <= 0.02 * len(clean)
    assert sum(r.p_toxic >= X.CUT for r in toxic) >= 0.85 * len(toxic)


def test_chain_uses_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(0)
    n, seen = 90, []
    dense, labels = rng.normal(size=(n, 2)), (rng.random((n, 3)) < 0.4).astype(float)
    rows, idx = np.arange(n), np.arange(n)  # every row has a feature of its own: memory is perfect
    real = X.fit_linear

    def spy(r, i, m, x, y, k, steps=X.STEPS):
        seen.append(x.shape)
        return real(r, i, m, x, y, k, steps)

    monkeypatch.setattr(X, "fit_linear", spy)
    models = X.train_chain(rows, idx, n, dense, labels, n)
    assert [m.dense.shape[0] - 1 for m in models] == [2, 3, 4]
    assert len(seen) == 3 + 2 * X.FOLDS and seen[1] == (60, 2)


def test_constant_models():
    m = X.fit_linear(np.array([0]), np.array([0]), 2, np.zeros((2, 1)), np.ones(2), 1)
    assert m.predict(np.array([0]), np.array([0]), 1, np.zeros((1, 1))).tolist() == [1.0]


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(1)
    x = rng.random(200)
    y = (rng.random(200) < x).astype(float)
    a, b = Q.isotonic(x, y)
    assert (np.diff(a) >= 0).all() and (np.diff(b) >= 0).all()
    want = y[np.argsort(x)].copy()
    cum = np.concatenate([[0], np.cumsum(want)])
    # minimax formula of isotonic regression
    fit = [max(min((cum[j] - cum[i]) / (j - i) for j in range(k + 1, 201)) for i in range(k + 1)) for k in range(200)]
    values = sorted(set(np.round(b, 12)))
    assert np.allclose(sorted(set(np.round(fit, 12))), values)


def test_fourier_features_approach_the_kernel(monkeypatch):
    monkeypatch.setattr(Q, "FEATURES", 20_000)
    m = Q.Model(0.5)
    rng = np.random.default_rng(2)
    d = Q.N_STATISTICS
    m.centre, m.scale = np.zeros(d), np.ones(d)
    width = Q.WIDTH * np.sqrt(d)
    m.w, m.b = rng.normal(size=(d, 20_000)) / width, rng.uniform(0, 2 * np.pi, 20_000)
    x = rng.normal(size=(5, d))
    f = m.expand(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-gap / (2 * width ** 2))).max() < 0.05


EDGE = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, " \n\t", "a"), (None, "no id", "a"),
        (4, "word " * 60_000, "a"), (5, "ñ漢字 \x00 !!", "a")]


def test_edges(spark, tables):
    docs, labels = tables
    df = spark.createDataFrame([(i, t, s, 0.5, 0.5) for i, t, s in EDGE],
                               "doc_id long, text string, source string, score double, p_toxic double")
    got = Q.score_documents(df, Q.fit(docs, labels)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert Q.keep_good(df, labels.limit(0)).columns == df.columns
    assert Q.keep_good(df, labels.limit(0)).count() == len(EDGE)  # without labels every score is 0.5
    assert X.keep_clean(df, labels.limit(0)).columns == df.columns
    assert X.keep_clean(df, labels.limit(0)).count() == len(EDGE)
    one = spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 0, 0), (None, 1, 1), (5, None, None)],
                                "doc_id long, quality int, toxic int")
    assert X.score_documents(df, X.fit(df, one)).count() == len(EDGE)
    assert Q.score_documents(df, Q.fit(df, one)).count() == len(EDGE)


def test_empty_table(spark, tables):
    docs, labels = tables
    empty = docs.limit(0)
    assert Q.keep_good(empty, labels).count() == 0
    assert X.keep_clean(empty, labels).count() == 0


def test_normal_equations_equal_one_solve_over_all_rows(spark, tables):
    """The ridge weights from sums by partition against a dense solve over the training rows."""
    docs, labels = tables
    m = Q.fit(docs.repartition(7), labels)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").filter("quality is not null").filter(
        (part != 0) & (part != 4)).select("text", "quality").collect()
    assert len(rows) < Q.MAX_TRAIN
    x = Q.statistics([r.text for r in rows], Q.WordHashes())
    y = np.array([float(r.quality) for r in rows])
    assert np.allclose(m.centre, x.mean(axis=0))
    f = m.expand(x)
    d = f.shape[1]
    # ridge regression as least squares over rows that pull every weight to nought
    pull = np.sqrt(Q.RIDGE * len(y) / d) * np.eye(d)
    want = np.linalg.lstsq(np.vstack([f, pull]), np.concatenate([y, np.zeros(d)]), rcond=None)[0]
    assert np.abs(f @ m.weights - f @ want).max() < 1e-6


def test_linear_model_equals_a_dense_one():
    """The sparse fit against the same steps on the dense matrix of all features."""
    rng = np.random.default_rng(3)
    n, k = 60, 8
    present, dense = rng.random((n, k)) < 0.3, rng.normal(size=(n, 2))
    y = (rng.random(n) < 0.2 + 0.5 * present[:, 0]).astype(float)
    rows, idx = np.nonzero(present)
    got = X.fit_linear(rows, idx, n, dense, y, k)
    a = present.astype(float)
    ratio = np.log((y @ a + 0.5) / (y.sum() + 1)) - np.log(((1 - y) @ a + 0.5) / (n - y.sum() + 1))
    x = np.hstack([a * ratio, dense, np.ones((n, 1))])
    w, seen = np.zeros(k + 3), np.full(k + 3, 1e-8)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    penalty = np.concatenate([np.full(k, X.PENALTY), np.zeros(3)])
    for _ in range(X.STEPS):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / n + penalty * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    assert np.allclose(got.predict(rows, idx, n, dense), 1 / (1 + np.exp(-x @ w)), atol=1e-6)


def test_repeated_doc_ids_train_once(spark, tables):
    """100,000 rows of one labelled doc_id: one of them, the smallest text, is trained on."""
    from docscope.llm.common import sampled_texts
    docs, labels = tables
    one = labels.filter("quality is not null and toxic is not null").orderBy("doc_id").first().doc_id
    many = docs.filter(F.col("doc_id") != one).select("doc_id", "text").unionByName(
        spark.range(100_000).select(F.lit(one).cast("long").alias("doc_id"),
                                    F.format_string("text %05d of many", F.col("id") % 1000).alias("text")))
    once = docs.select("doc_id", "text").withColumn(
        "text", F.when(F.col("doc_id") == one, "text 00000 of many").otherwise(F.col("text")))
    sample = labels.select("doc_id").distinct()
    assert sampled_texts(many, sample).filter(F.col("doc_id") == one).collect() == [(one, "text 00000 of many")]
    a, b = Q.fit(many, labels), Q.fit(once, labels)
    assert np.allclose(a.centre, b.centre) and np.allclose(a.weights, b.weights, atol=1e-6)
    a, b = X.fit(many, labels), X.fit(once, labels)
    assert a.chosen == b.chosen
    assert all(np.allclose(m.dense, o.dense) and np.allclose(m.sparse, o.sparse)
               for m, o in zip(a.models, b.models) if m.sparse is not None)
