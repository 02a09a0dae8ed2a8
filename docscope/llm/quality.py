"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every text is described by document statistics (lengths, shares of character
classes, distinct and repeated words, shingles and lines). Random Fourier features
``sqrt(2/D) cos(Wx + b)`` of the standardised statistics approximate a Gaussian
kernel; ridge regression on them is fitted from its normal equations, which
every partition sums over its own training rows (one D x D matrix a partition)
and Spark adds up. Isotonic regression (pool adjacent violators) on rows that
the ridge fit has not seen turns scores into probabilities of label 1.

Training rows are a bounded sample: at most ``max_train`` labelled documents,
the smallest by hash, whose ``crc32(doc_id) mod 5`` is not 0 (remainders 1 to 3
fit the ridge, 4 the calibration). Their ids are broadcast (bounded by
``max_train``), and only their texts are shuffled, after partial aggregation to one a task.
Every document is then scored whole. Labels, language, source and doc_id are no inputs.

Edge cases: null text counts as empty; empty texts have all-zero statistics and are
scored like others; null labels are no labels; of several labels of a doc_id the largest
counts, of several texts the smallest trains; very long texts are described whole; with no training rows, or one class only, every score is the mean label (0.5
without any). Repeated rows stay. An empty table gives an empty result.
Extra columns are ignored (``score_documents``) or kept (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscope.llm.bagminhash import WordHashes, shingles
from docscope.llm.common import fresh, prepare, sampled_texts, stash

MAX_TRAIN = 16_000
FEATURES = 256
RIDGE = 1e-3
#: Kernel width in standard deviations of the statistics, per square root of their number.
WIDTH = 0.7
CUT = 0.3
SEED = 11

# Byte classes
_CLASSES = np.zeros(256, np.int64)
_CLASSES[ord("a"):ord("z") + 1] = 1
_CLASSES[ord("A"):ord("Z") + 1] = 2
_CLASSES[ord("0"):ord("9") + 1] = 3
for _c in b" \t\r\f\v":
    _CLASSES[_c] = 4
_CLASSES[ord("\n")] = 5
for _c in b".,;:?'\"-()":
    _CLASSES[_c] = 6
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASSES[_c] = 7
_CLASSES[128:] = 8
N_CLASSES = 9
N_STATISTICS = N_CLASSES + 9


def byte_shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the byte classes, number of bytes) by text."""
    raw = [(t or "").encode() for t in texts]
    size = np.array([len(b) for b in raw], np.int64)
    kinds = _CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)) * N_CLASSES, size)
    count = np.bincount(doc + kinds, minlength=len(raw) * N_CLASSES).reshape(len(raw), N_CLASSES)
    return count / np.maximum(size, 1)[:, None], size


def statistics(texts: list[str | None], cache: WordHashes) -> np.ndarray:
    """Document statistics (n x N_STATISTICS) of a batch of at most 4096 texts."""
    n = len(texts)
    share, size = byte_shares(texts)
    words = [(t or "").lower().split() for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    total = int(count.sum())
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, total)
    doc = np.repeat(np.arange(n, dtype=np.uint64), count)
    key = np.sort((doc << np.uint64(52)) | (flat >> np.uint64(12)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
    owner = (key[at] >> np.uint64(52)).astype(np.int64)
    times = np.diff(np.append(at, total))
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, times)
    same = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[1:][same].astype(np.int64), minlength=n)
    s_doc, _, s_count = shingles(texts, cache)
    s_total = np.bincount(s_doc, weights=s_count, minlength=n)
    s_distinct = np.bincount(s_doc, minlength=n)
    lines = [(t or "").split("\n") for t in texts]
    some = np.maximum(count, 1)
    return np.column_stack([
        share, np.log1p(size), np.log1p(count), size / some, distinct / some, most / some, again / some,
        s_distinct / np.maximum(s_total, 1), np.log1p([len(x) for x in lines]),
        [len(set(x)) / len(x) for x in lines]])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, probability) points of a rising curve."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x.tolist(), y.tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


class Model:
    """Fitted parameters; ``weights`` None: the constant ``mean``."""

    def __init__(self, mean: float):
        self.mean, self.weights = mean, None

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        f = np.sqrt(2.0 / FEATURES) * np.cos(z @ self.w + self.b)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.mean)
        return np.clip(np.interp(self.raw(x), self.curve_x, self.curve_y), 0.0, 1.0)


def labelled_sample(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled documents, smallest by hash."""
    return (labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max(F.col(column)).cast("double").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))


def _statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        x = statistics(batch.column("text").to_pylist(), cache)
        n = len(x)
        yield pa.RecordBatch.from_arrays([
            batch.column("part"), batch.column("label"), pa.ListArray.from_arrays(
                pa.array((np.arange(n + 1) * N_STATISTICS).astype(np.int32)), pa.array(x.ravel()))],
            names=["part", "label", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_train: int = MAX_TRAIN,
        ridge: float = RIDGE) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text); ``labels``: (doc_id, ``column``)."""
    prepare(docs.sparkSession)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    sample = labelled_sample(labels.filter(part != 0), column, max_train)
    train = stash(
        sampled_texts(docs, sample).select("text", "label", part.alias("part"))
        .mapInArrow(_statistics_task, "part int, label double, x array<double>"), "quality-train")
    moments = train.filter("part <> 4").select("label", *[
        F.col("x")[i].alias(f"x{i}") for i in range(N_STATISTICS)]).agg(
            F.count(F.lit(1)).alias("n"), F.mean("label").alias("mean"),
            F.min("label").alias("low"), F.max("label").alias("high"),
            *[F.mean(f"x{i}").alias(f"m{i}") for i in range(N_STATISTICS)],
            *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(N_STATISTICS)]).first()
    if not moments["n"]:
        return Model(0.5)
    model = Model(moments["mean"])
    if moments["low"] == moments["high"]:
        return model
    rng = np.random.default_rng(SEED)
    model.centre = np.array([moments[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.array([moments[f"s{i}"] or 1.0 for i in range(N_STATISTICS)])
    model.w = rng.normal(size=(N_STATISTICS, FEATURES)) / (WIDTH * np.sqrt(N_STATISTICS))
    model.b = rng.uniform(0, 2 * np.pi, FEATURES)
    d = FEATURES + 1

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            f = model.expand(_matrix(batch))
            total[:, :d] += f.T @ f
            total[:, d] += f.T @ batch.column("label").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.ListArray.from_arrays(
            pa.array((np.arange(d + 1) * (d + 1)).astype(np.int32)), pa.array(total.ravel()))], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks().flatten().to_numpy().reshape(table.num_rows, d + 1)
        return pa.table({"i": table.column("i")[:1], "row": pa.array([rows.sum(axis=0)])})

    summed = (train.filter("part <> 4").mapInArrow(normal_equations, "i long, row array<double>")
              .groupBy("i").applyInArrow(add, "i long, row array<double>").collect())
    a = np.zeros((d, d + 1))
    for r in summed:
        a[r["i"]] = r["row"]
    model.weights = np.linalg.solve(a[:, :d] + ridge * moments["n"] / d * np.eye(d), a[:, d])
    held = train.filter("part = 4").select("label", "x").toArrow()  # a part of the bounded sample
    if held.num_rows == 0:
        held = train.select("label", "x").toArrow()
    x = held.column("x").combine_chunks().flatten().to_numpy().reshape(held.num_rows, N_STATISTICS)
    model.curve_x, model.curve_y = isotonic(model.raw(x), held.column("label").to_numpy())
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None,
                    name: str = "score") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; or its columns ``keep`` and the score
    under ``name``."""
    prepare(docs.sparkSession)
    names = keep or ["doc_id"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            score = model.score(statistics(texts, cache)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``, all columns kept."""
    name = fresh("score", docs.columns)
    return score_documents(docs, fit(docs, labels), docs.columns, name).filter(F.col(name) >= cut).select(
        *[F.col(f"`{c}`") for c in docs.columns])
