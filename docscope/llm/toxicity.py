r"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the model of a category sees the text
features and the probabilities of all earlier categories. While training, those
probabilities are out-of-fold: a document's come from models fitted on the
other folds, so a later model never learns from an earlier one's memory.

Features: presence of whole words (``\w+``, lower case) and of word beginnings of 4
to 7 characters (insults live on in compounds), hashed; the ``n_features`` with the
largest chi-square (at least ``MIN_CHI2``) against any category among those in at least
``min_docs`` training documents; and shares of byte classes. Linear models: logistic
regression with an L2 penalty on presence times the feature's log ratio between the
classes, by full-batch gradient steps.

Categories of the given labels, in chain order: ``spam`` (quality 0), ``toxic``
(toxic 1), ``toxic_spam`` (both). A document is rejected if ``p_toxic >= 0.5``.

Training rows are a bounded sample, at most ``max_train`` labelled documents, the
smallest by hash; their ids are broadcast (bounded by ``max_train``), and only their texts
are shuffled, after partial aggregation to one a task. Every document is then scored whole.

Edge cases: null text counts as empty and, like a text without words, has no word
features; null labels count as not of the category; of several labels of a doc_id the
largest counts, of several texts the smallest trains; very long texts count whole; a category without both classes gets its share as constant
probability (0 without training rows). Repeated rows stay. An empty table gives an
empty result. Extra columns are ignored (``score_documents``) or kept (``keep_clean``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscope.llm.common import prepare, sampled_texts, stash
from docscope.llm.quality import N_CLASSES, byte_shares

CATEGORIES = ("spam", "toxic", "toxic_spam")
REJECT, CUT = "toxic", 0.5
MAX_TRAIN = 16_000
N_FEATURES = 2_048
MIN_DOCS = 4
#: Below this a feature is noise among the hundreds of thousands tried.
MIN_CHI2 = 30.0
BUCKETS = 1 << 21
FOLDS = 3
STEPS = 200
PENALTY = 1e-5
#: Words whose features a task remembers (it starts anew when full).
WORD_CACHE = 400_000
_WORD = re.compile(r"\w+")


def word_buckets(word: str) -> list[int]:
    """Hash buckets of a word's features: the word itself and its beginnings."""
    raw = [f"={word}", *(word[:k] for k in range(4, 8) if len(word) >= k)]
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in raw]


class WordFeatures(dict):
    """Features of a word, computed once per task; ``chosen``: position by bucket
    (None: the buckets themselves)."""

    def __init__(self, chosen: dict[int, int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = word_buckets(word)
        if self.chosen is not None:
            found = [self.chosen[b] for b in found if b in self.chosen]
        r = self[word] = tuple(found)
        return r


def present(text: str | None, features: WordFeatures) -> set[int]:
    """The features present in a text."""
    out: set[int] = set()
    for f in map(features.__getitem__, set(_WORD.findall((text or "").lower()))):
        if f:
            out.update(f)
    return out


class Linear:
    """Logistic regression over sparse presence features and dense columns."""

    def __init__(self, constant: float):
        self.constant = constant  # the probability, if there are no weights
        self.sparse = self.dense = None

    def margin(self, rows, idx, n, dense):
        return (np.bincount(rows, weights=self.sparse[idx], minlength=n) + dense @ self.dense[:-1]
                + self.dense[-1])

    def predict(self, rows, idx, n, dense):
        if self.sparse is None:
            return np.full(n, self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows, idx, n, dense), -30, 30)))


def fit_linear(rows, idx, n, dense, y, n_features: int, steps: int = STEPS) -> Linear:
    """Adagrad on all rows at once."""
    model = Linear(float(y.mean()) if n else 0.0)
    if not n or y.min() == y.max():
        return model
    model.sparse, model.dense = np.zeros(n_features), np.zeros(dense.shape[1] + 1)
    model.dense[-1] = np.log(y.mean() / (1 - y.mean()))
    g2s, g2d = np.full(n_features, 1e-8), np.full(len(model.dense), 1e-8)
    wide = np.hstack([dense, np.ones((n, 1))])
    # a feature counts by its log ratio between the classes, so telling words outweigh the many others
    ratio = (np.log((np.bincount(idx, weights=y[rows], minlength=n_features) + 0.5) / (y.sum() + 1))
             - np.log((np.bincount(idx, weights=1 - y[rows], minlength=n_features) + 0.5) / (n - y.sum() + 1)))
    own = np.zeros(n_features)
    for _ in range(steps):
        r = (model.predict(rows, idx, n, dense) - y) / n
        gs = ratio * np.bincount(idx, weights=r[rows], minlength=n_features) + PENALTY * own
        gd = wide.T @ r
        g2s += gs * gs
        g2d += gd * gd
        own -= 0.3 * gs / np.sqrt(g2s)
        model.dense -= 0.3 * gd / np.sqrt(g2d)
        model.sparse = ratio * own
    return model


class Chain:
    """Chosen features and one linear model per category, in order."""

    def __init__(self, chosen: dict[int, int], models: list[Linear], categories=CATEGORIES):
        self.chosen, self.models, self.categories = chosen, models, categories

    def predict(self, texts: list[str | None], features: WordFeatures) -> np.ndarray:
        n = len(texts)
        found = [present(t, features) for t in texts]
        rows = np.repeat(np.arange(n), [len(x) for x in found])
        idx = np.fromiter((i for x in found for i in x), np.int64, len(rows))
        dense, _ = byte_shares(texts)
        out = np.zeros((n, len(self.models)))
        for c, model in enumerate(self.models):
            out[:, c] = model.predict(rows, idx, n, np.hstack([dense, out[:, :c]]))
        return out


def train_chain(rows, idx, n, dense, labels: np.ndarray, n_features: int, folds: int = FOLDS) -> list[Linear]:
    """Models in chain order; ``labels``: n x categories."""
    fold = np.arange(n) % folds
    models, earlier = [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        x, y = np.hstack([dense, earlier]), labels[:, c]
        models.append(fit_linear(rows, idx, n, x, y, n_features))
        if c + 1 < labels.shape[1]:
            out = np.zeros(n)
            for k in range(folds):
                inside = fold != k
                part = inside[rows]
                place = np.cumsum(inside) - 1
                m = fit_linear(place[rows[part]], idx[part], int(inside.sum()), x[inside], y[inside], n_features)
                other = np.cumsum(~inside) - 1
                out[~inside] = m.predict(other[rows[~part]], idx[~part], int((~inside).sum()), x[~inside])
            earlier = np.hstack([earlier, out[:, None]])
    return models


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the partition by feature bucket: all, and by category."""
    features = WordFeatures()
    counts: np.ndarray | None = None
    k = len(CATEGORIES)
    for batch in batches:
        if counts is None:
            counts = np.zeros((k + 1, BUCKETS), np.int32)
        y = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CATEGORIES])
        for text, row in zip(batch.column("text").to_pylist(), y):
            found = np.fromiter(present(text, features), np.int64)
            counts[0, found] += 1
            for c in range(k):
                if row[c]:
                    counts[c + 1, found] += 1
    if counts is not None:
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *[pa.array(counts[c, at].astype(np.int64)) for c in range(k + 1)]],
            names=["bucket", "n", *CATEGORIES])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, n_features: int = N_FEATURES,
        min_docs: int = MIN_DOCS) -> Chain:
    """Fit on labelled rows of ``docs`` (doc_id, text); ``labels``: (doc_id, quality, toxic)."""
    prepare(docs.sparkSession)
    sample = (labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 0), F.lit(False)).alias("spam"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        .withColumn("toxic_spam", F.col("spam") & F.col("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    train = stash(sampled_texts(docs, sample).select(
        "doc_id", "text", *[F.col(c).cast("int").alias(c) for c in CATEGORIES]), "tox-train")
    totals = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES]).first()
    n = totals["n"]
    if not n:
        return Chain({}, [Linear(0.0) for _ in CATEGORIES])
    counted = train.mapInArrow(_count_features, "bucket long, n long, " + ", ".join(
        f"{c} long" for c in CATEGORIES)).groupBy("bucket").agg(
            *[F.sum(c).alias(c) for c in ("n", *CATEGORIES)]).filter(F.col("n") >= min_docs)

    def chi2(c):  # of the 2 x 2 table of presence and category
        pos = float(totals[c])
        a, b = F.col(c), F.col("n") - F.col(c)
        cross = a * (n - pos - b) - b * (pos - a)
        below = F.col("n") * (n - F.col("n")) * pos * (n - pos)
        return F.when(below > 0, n * cross * cross / below).otherwise(0.0)

    best = counted.select("bucket", F.greatest(*[chi2(c) for c in CATEGORIES]).alias("chi2")).filter(
        F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "bucket").limit(n_features).collect()
    chosen = {r["bucket"]: i for i, r in enumerate(best)}

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures(chosen)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            dense, _ = byte_shares(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in CATEGORIES],
                 pa.array([sorted(present(t, features)) for t in texts], pa.list_(pa.int32())),
                 pa.array(list(dense), pa.list_(pa.float64()))],
                names=["doc_id", *CATEGORIES, "idx", "dense"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    data = train.mapInArrow(featurise, f"doc_id {kind}, " + ", ".join(f"{c} int" for c in CATEGORIES)
                            + ", idx array<int>, dense array<double>").toArrow()  # the bounded sample
    data = data.sort_by("doc_id").combine_chunks()
    lists = data.column("idx").combine_chunks()
    idx = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(data.num_rows), lists.value_lengths().to_numpy())
    dense = data.column("dense").combine_chunks().flatten().to_numpy().reshape(data.num_rows, N_CLASSES)
    y = np.column_stack([data.column(c).to_numpy() for c in CATEGORIES]).astype(float)
    return Chain(chosen, train_chain(rows, idx, data.num_rows, dense, y, max(1, len(chosen))))


def score_documents(docs: DataFrame, model: Chain, keep: list[str] | None = None,
                    prefix: str = "p_") -> DataFrame:
    """(doc_id, p_<category>...) of every row; or its columns ``keep`` and the
    probabilities under ``prefix``."""
    prepare(docs.sparkSession)
    names = keep or ["doc_id"]
    scores = [f"{prefix}{c}" for c in model.categories]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias(scores[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures(model.chosen)
        for batch in batches:
            p = model.predict(batch.column(len(names)).to_pylist(), features)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(p.shape[1])]],
                names=[*names, *scores])

    return rows.mapInArrow(run, T.StructType(
        [*rows.schema.fields[:-1], *[T.StructField(c, T.DoubleType()) for c in scores]]))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept."""
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = score_documents(docs, fit(docs, labels), docs.columns, prefix)
    return scored.filter(F.col(f"{prefix}{REJECT}") < cut).select(*[F.col(f"`{c}`") for c in docs.columns])
