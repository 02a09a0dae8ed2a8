"""MinHash near-duplicates by BagMinHash: weighted Jaccard of word-shingle multisets.

A document is the multiset of its runs of five words (words: lower-cased runs of
characters other than white space; one to four words are one shingle). Two documents
are linked if sum(min counts) / sum(max counts) >= 0.8; linked documents form
classes.

Signature (BagMinHash): every shingle owns a Poisson process in time over the
signature registers and the weight axis. The axis is split hierarchically into layers
(0,1], (1,2], (2,4], (4,8], ...; the layers below a shingle's count give all their points,
the layer that the count cuts gives the points below it, so a shingle costs about
log2(count) layers however often it repeats. A register holds the earliest point
that hit it; two documents agree in a register with probability equal to their
weighted Jaccard similarity. Points are made in rising time, and a shingle stops as soon as its
next point is later than every register of its document.

Candidates: ``BANDS`` bands of ``ROWS`` registers; a pair at similarity 0.8 (0.85)
shares no band with probability 6e-4 (3e-6). Verification is exact, on whole
multisets:

1. equal texts are one node, so copies cost nothing below;
2. a bucket's head is its node with most rows in its buckets; every node is compared with
   the best of its buckets' heads, and verified links give first components; then with the
   other heads, as far as they are in another component (both linear in the bucket);
   a one-bit sketch of the signature (more than ``SKETCH_FAR`` differing bits of 320) puts
   unlikely heads off to the third step;
3. nodes of buckets that still hold several components are joined exactly, whatever their buckets: the
   members of a multiset are ordered by rising frequency among them, and a pair of
   *different* components at similarity t or more shares a member among the first
   ``n - ceil(2t/(1+t) n) + 1`` of the smaller and the first ``n - ceil(t n) + 1`` of the larger one, where what
   follows in both is long enough to reach the overlap that t asks for. All of this is the join's
   condition. Pairs inside one component need no comparison: their class is known.

So a group of thousands of near copies costs about one comparison per member, and texts that only
share a passage meet in none: their own members are rarer and stand first. No bucket is capped.

Edge cases: a text without words (null, empty, white space) is its own class and
links with nothing; equal texts are one class, whatever their language or source; repeated
rows (equal doc_id and text) share a class. Rows without a doc_id are compared like others; the
class_id of a class that only such rows make up is null, and of these the text with the smallest
digest is kept. An empty table gives an empty result. Extra input columns are ignored (``duplicate_classes``) or kept (``keep_one``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import clean_columns, fresh, prepare, stash
from docscope.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 8
REGISTERS = BANDS * ROWS
SKETCH_WORDS = REGISTERS // 64
SKETCH_FAR = 52
#: Distinct words whose hashes a task remembers (it starts anew when full).
WORD_CACHE = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C55)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


class WordHashes(dict):
    """Hash of a word, computed once per task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, 52-bit shingle hash, count) of the distinct shingles of a
    batch of at most 4096 texts, sorted by document and hash."""
    words = [(t or "").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        whole = max(0, total - SHINGLE + 1)
        h = np.zeros(whole, np.uint64)
        for k in range(SHINGLE):
            h = h * _MUL + flat[k:k + whole] + _GOLD
        inside = doc[:whole] == doc[total - whole:]  # first and last word of one document
        key = (doc[:whole][inside] << np.uint64(52)) | (_mix(h[inside]) >> np.uint64(12))
        short = [i for i, n in enumerate(lengths) if 0 < n < SHINGLE]
        if short:
            few = np.zeros(len(short), np.uint64)
            for j, i in enumerate(short):
                for x in flat[ends[i] - lengths[i]:ends[i]]:
                    few[j] = few[j] * _MUL + x + _GOLD
            key = np.concatenate([key, (np.array(short, np.uint64) << np.uint64(52)) | (_mix(few) >> np.uint64(12))])
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    once = key[at]
    return ((once >> np.uint64(52)).astype(np.int64), once & np.uint64((1 << 52) - 1),
            np.diff(np.append(at, len(key))))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int,
               m: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs x m): time of the earliest point, inf where a document has no shingle."""
    reg = np.full(n_docs * m, np.inf)
    if not len(h):
        return reg.reshape(n_docs, m)
    n_layers = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    who = np.repeat(np.arange(len(h)), n_layers)
    layer = np.arange(len(who)) - np.repeat(np.cumsum(n_layers) - n_layers, n_layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1.0))
    width = np.where(layer == 0, 1.0, low)
    weight, owner = count[who].astype(np.float64), doc[who]
    with np.errstate(over="ignore"):
        state = _mix(h[who] ^ (layer.astype(np.uint64) * _GOLD))
        time = np.zeros(len(who))
        cut = low + width > weight  # the layer that the count cuts
        done = 0  # points made so far; neither they nor the times depend on how many are made at once
        while len(state):
            many = max(1, min(256, 20_000 // len(state)))
            steps = np.arange(done + 1, done + many + 1, dtype=np.uint64) * _GOLD
            done += many
            draw = _mix(state[:, None] + steps[None, :])
            at = -np.log(_unit(draw)) / (width[:, None] * m)
            at[:, 0] += time
            np.cumsum(at, axis=1, out=at)
            second = _mix(draw ^ _M2)
            cell = ((second >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            place = owner[:, None] * m + cell
            if cut.any():
                position = low[:, None] + width[:, None] * _unit(_mix(second + _GOLD))
                ok = ~cut[:, None] | (position <= weight[:, None])
                np.minimum.at(reg, place[ok], at[ok])
            else:
                np.minimum.at(reg, place.ravel(), at.ravel())
            time = at[:, -1]
            latest = reg.reshape(n_docs, m).max(axis=1)
            go = time <= latest[owner]
            state, time, owner, low, width, weight, cut = (
                x[go] for x in (state, time, owner, low, width, weight, cut))
    return reg.reshape(n_docs, m)


def bands_and_sketch(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n x BANDS) and one-bit sketches (n x SKETCH_WORDS), as int64."""
    n = len(reg)
    bits = _mix(np.ascontiguousarray(reg).view(np.uint64))
    with np.errstate(over="ignore"):
        band = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLD, n, axis=0)
        rows = bits.reshape(n, BANDS, ROWS)
        for r in range(ROWS):
            band = _mix(band * _MUL + rows[:, :, r])
    flags = (bits & np.uint64(1)).astype(np.uint8).reshape(n, SKETCH_WORDS * 8, 8)
    sketch = np.ascontiguousarray(np.packbits(flags, axis=2).reshape(n, SKETCH_WORDS * 8)).view(np.int64)
    return band.view(np.int64), sketch


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()),
                     ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n = len(texts)
        if not n:
            continue
        doc, h, count = shingles(texts, cache)
        size = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        band, sketch = bands_and_sketch(signatures(doc, h, count, n))
        none = size == 0
        keys = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(size),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32(), mask=None),
                                     pa.array(band.ravel()), mask=pa.array(none)),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCH_WORDS, pa.int32()),
                                     pa.array(sketch.ravel()), mask=pa.array(none))], schema=_SIGNED)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node the multiset as a set: the k-th occurrence of a shingle is a member of its own."""
    cache = WordHashes()
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        doc, h, count = shingles(texts, cache)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            member = _mix(np.repeat(h, count) + nth.astype(np.uint64) * _GOLD)
        size = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(member.view(np.int64)))], schema=schema)


def _verify(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                similarity = common / (len(x) + len(y) - common)
                if similarity >= threshold:
                    out.append((i, similarity))
            rows = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("a").take(rows), batch.column("b").take(rows),
                pa.array([s for _, s in out], pa.float64())], schema=schema)
    return run


def _far(a: str, b: str) -> F.Column:
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i]))
                for i in range(SKETCH_WORDS)), F.lit(0))


def multisets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of the ``wanted`` nodes (node), from their whole texts.
    ``docs``: (doc_id, text); ``nodes``: (node, key, first_doc)."""
    wanted = wanted.distinct().join(nodes.select("node", "key", F.col("first_doc").alias("doc_id")), "node")
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    # rows that repeat a document are equal: one is read
    one_each = texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "text")
    unnamed = nodes.filter("first_doc is null")
    if not unnamed.isEmpty():  # texts that only rows without doc_id hold: equal ones go before the join
        alone = texts.filter("doc_id is null").dropDuplicates(["key"])
        one_each = one_each.unionByName(
            alone.join(wanted.filter("doc_id is null").select("node", "key"), "key").select("node", "text"))
    return stash(one_each.mapInArrow(_multisets, "node long, members array<bigint>"), "bmh-sets")


def linked(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b, similarity) among candidate ``pairs`` (a, b), by whole multisets."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    return stash(two.select("a", "b", "x", "y").mapInArrow(
        _verify(threshold), "a long, b long, similarity double"), "bmh-links")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``linked`` with the multisets of the pairs' own nodes."""
    return linked(pairs, multisets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, nodes), threshold)


def _up(x: F.Column) -> F.Column:
    """Rounded up, but for what floating point adds."""
    return F.ceil(x - 1e-9)


def prefix_pairs(sets: DataFrame, roots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of ``sets`` (node, members) whose ``roots`` (node, root) differ and whose similarity may
    reach the threshold: every pair that does, and few others."""
    t = threshold
    each = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("m"))
    shared = each.groupBy("m").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # members of one node alone come first, in whatever order: only how many there are counts
    lists = each.join(shared, "m").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "m"))).alias("c"))
    own = F.col("n") - F.size("c")
    probe, index = (F.col("n") - _up(F.col("n") * x) + 1 for x in (t, 2 * t / (1 + t)))
    first = lists.select("node", "n", own.alias("own"), index.alias("index"), F.posexplode(
        F.slice("c", F.lit(1), F.greatest(probe - own, F.lit(0)).cast("int"))).alias("i", "x"))
    first = stash(first.join(roots, "node").select(
        "node", "root", "n", "index", (F.col("own") + F.col("i")).alias("pos"), F.col("x.m").alias("m")), "bmh-prefixes")
    y, x = first.filter("pos < index").alias("y"), first.alias("x")
    overlap = _up((F.col("x.n") + F.col("y.n")) * (t / (1 + t)))
    within = (F.struct("y.n", "y.node") < F.struct("x.n", "x.node")) & (F.col("y.n") >= _up(F.col("x.n") * t))
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= overlap
    return (x.join(y, (F.col("x.m") == F.col("y.m")) & (F.col("x.root") != F.col("y.root")) & within & reach)
            .select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct())


def _mixed_buckets(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root, sketch) of the buckets that hold several components."""
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rooted.select("node", "root", F.explode("bands").alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rest = rows.join(mixed.select("bucket"), "bucket", "left_semi")
    return stash(rest.join(nodes.select("node", "sketch", "score", "size"), "node"), "bmh-rest")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_shingles, key) for every row of ``docs`` (doc_id, text);
    ``class_id`` is the smallest doc_id of the class, ``key`` the digest of the text."""
    return _classes(docs, threshold).select("doc_id", "class_id", "n_shingles", "key")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``duplicate_classes`` and first_key, the smallest key of the class (null without words)."""
    prepare(docs.sparkSession)
    docs = clean_columns(docs, "doc_id", "text")
    signed = stash(docs.mapInArrow(
        _sign, "doc_id long, key binary, n_shingles long, bands array<bigint>, sketch array<bigint>"),
        "bmh-signed")
    nodes = stash(signed.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "bmh-nodes")
    # A bucket's head is its most popular node, the one with most rows in its own buckets: among
    # near copies of one text that is the text they were made from, or what is closest to it.
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    score = rows.join(sizes, "bucket").groupBy("node").agg(F.sum(F.col("n") - 1).alias("score"))
    nodes = stash(nodes.join(score, "node"), "bmh-scored")
    best = F.struct("score", (-F.col("node")).alias("minus"))
    heads = (nodes.select("node", "score", F.explode("bands").alias("bucket")).groupBy("bucket")
             .agg(F.max(best).alias("h")))
    # one head a node first: it settles nearly all of a large group, at one comparison a node
    first = rows.join(heads, "bucket").filter(-F.col("h.minus") != F.col("node")).groupBy("node").agg(
        F.max("h").alias("h"))
    compared = stash(first.select((-F.col("h.minus")).alias("a"), F.col("node").alias("b")), "bmh-first")
    links = verified(compared, docs, nodes, threshold)
    roots = components(links.select("a", "b"))

    # then, in buckets that still hold several components, the heads that are in another one
    rest = _mixed_buckets(nodes, roots)
    head = rest.groupBy("bucket").agg(F.max(F.struct("score", "node", "root", "sketch")).alias("h"))
    stars = (rest.withColumn("s", F.struct("sketch")).join(head, "bucket")
             .filter((F.col("root") != F.col("h.root")) & (_far("s", "h") <= SKETCH_FAR))
             .select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct())
    stars = stash(stars.join(compared, ["a", "b"], "left_anti"), "bmh-stars")
    if not stars.isEmpty():
        compared = compared.unionByName(stars)
        links = links.unionByName(verified(stars, docs, nodes, threshold))
        roots = components(links.select("a", "b"))
        rest = _mixed_buckets(nodes, roots)

    # then every pair of different components that may be similar enough
    apart = stash(rest.select("node", "root").distinct(), "bmh-apart")
    if not apart.isEmpty():
        sets = multisets(apart.select("node"), docs, nodes)
        more = stash(prefix_pairs(sets, apart, threshold).join(compared, ["a", "b"], "left_anti"), "bmh-pairs")
        links = links.unionByName(linked(more, sets, threshold))
        roots = components(links.select("a", "b"))
    named = nodes.select("node", "key", "first_doc").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.min("key").alias("first_key"))
    classes = named.join(least, "root").select("key", "class_id", "first_key")
    return (signed.select("doc_id", "key", "n_shingles")
            .join(classes, "key", "left")
            .withColumn("class_id", F.coalesce("class_id", "doc_id"))
            .select("doc_id", "class_id", "n_shingles", "key", "first_key"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of every class of ``docs``, all columns kept: the one with
    the smallest doc_id, or in a class without any the smallest digest; texts without words all stay."""
    names = docs.columns
    key, n, w, d, k = (fresh(x, names) for x in ("bmh_key", "bmh_n", "bmh_words", "bmh_doc", "bmh_text"))
    classes = _classes(docs, threshold)
    kept = stash(classes.filter(
        "doc_id = class_id or n_shingles = 0 or (class_id is null and key = first_key)").groupBy(
            F.col("doc_id").alias(d), F.col("key").alias(k)).agg(
                F.count(F.lit(1)).alias(n), F.max("n_shingles").alias(w)), "bmh-kept")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    out = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & F.col(key).eqNullSafe(F.col(k)))
    columns = [F.col(f"`{c}`") for c in names]
    once = out.filter((F.col(n) == 1) | (F.col(w) == 0)).select(*columns)
    again = out.filter((F.col(n) > 1) & (F.col(w) > 0)).dropDuplicates([d, k]).select(*columns)
    return once.unionByName(again)
