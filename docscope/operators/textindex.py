"""Search by index: token postings for keywords, 3-gram postings for substrings.

Both are tables that Spark writes once and searches by partition and join; a search
reads no text.

* **Tokens.** A text's lower-cased, white-space separated tokens: lists (token, field, keys) of the
  documents that hold a token, and a dictionary with one row per token. A term without
  white space occurs in a text if and only if it occurs inside one of its tokens, so
  the term is matched against the dictionary and its tokens are joined to the postings.
* **Grams.** Every place of a text with the up to three characters that begin there: lists (gram, field,
  keys, places). A substring is covered by grams side by side; a document holds it where the grams
  stand at the same distances. Two characters are a gram's prefix.

A task groups the tokens of the documents it reads into lists, segment by segment, so the shuffle, the
sort and the files carry a row per term and segment, not one per place.

Postings are partitioned by a hash of the term (of a gram's first two characters, so a prefix lies
in one partition), those of grams sorted inside files: a search names its partitions and Parquet skips
row groups. Writing rebalances, so the postings of a frequent term are many files, not one task.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# workers have the libraries, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
#: Stands in a gram for the characters behind the end of a text.
NO_CHAR = (1 << 21) - 1
#: A task groups this many places of terms, or this many bytes, into lists at a time.
SEGMENT, SEGMENT_BYTES = 2_000_000, 64 << 20
#: Partitions of a postings table.
BUCKETS = 16
#: A bucket's terms are written in this many slices at least, if they are many.
SLICES = 8
#: A dictionary match up to this many bytes is broadcast, a larger one is joined by shuffle.
MATCH_BYTES = 8 << 20


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _lowered(field: str) -> Column:
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def token_postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(token, field, keys, bucket): a token's documents, each once, in one list per segment."""
    def lists(field, keys, tokens):
        keys, tokens = pa.chunked_array(keys).combine_chunks(), pa.chunked_array(tokens).combine_chunks()
        places = pa.table([pc.list_flatten(tokens), pc.list_parent_indices(tokens)], ["token", "row"])
        # one thread keeps the order of rows, so a row's repeats of a token stand side by side
        found = places.group_by("token", use_threads=False).aggregate([("row", "list")])
        rows = found["row_list"].combine_chunks()
        ends, rows = rows.offsets.to_numpy(), rows.values.to_numpy()
        new = np.r_[True, rows[1:] != rows[:-1]]
        new[ends[:-1]] = True
        kept = np.r_[0, np.cumsum(new)][ends]
        listed = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), keys.take(pa.array(rows[new])))
        yield from pa.table([found["token"], pa.repeat(field, len(found)), listed],
                            ["token", "field", "keys"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments(batches, fields, pc.ascii_split_whitespace, lambda x: len(x.values), lists)

    # ASCII white space is that of the pattern \s
    rows = df.select(F.col(key).alias("key"), *map(_lowered, fields)).mapInArrow(
        run, f"token string, field string, keys array<{df.schema[key].dataType.simpleString()}>")
    return rows.where("token <> ''").withColumn("bucket", bucket_of(F.col("token")))


def _segments(batches, fields, cut, places, lists):
    """``lists(field, keys, cut texts)`` for every SEGMENT places or SEGMENT_BYTES of a field's texts."""
    held = {f: ([], [], [0, 0]) for f in fields}
    for b in batches:
        for f, texts in zip(fields, b.columns[1:], strict=True):
            keys, cuts, size = held[f]
            keys.append(b.column(0))
            cuts.append(cut(texts))
            size[0] += places(cuts[-1])
            size[1] += texts.nbytes
            if size[0] >= SEGMENT or size[1] >= SEGMENT_BYTES:
                yield from lists(f, keys, cuts)
                held[f] = ([], [], [0, 0])
    for f, (keys, cuts, size) in held.items():
        if size[0]:
            yield from lists(f, keys, cuts)


def token_dictionary(postings: DataFrame) -> DataFrame:
    """(token, bucket): the distinct tokens."""
    return postings.groupBy("token").agg(F.first("bucket").alias("bucket"))


def gram_postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gram, field, keys, places, bucket): the documents and places of a gram, side by side in two
    lists per segment."""
    def cut(texts):
        return [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype("int64")
                for t in texts.cast(pa.binary()).to_pylist()]

    def lists(field, keys, cuts):
        texts = [t for c in cuts for t in c]
        # a gram as one number, 21 bits a code point
        ahead = [np.r_[t, [NO_CHAR] * (GRAM - 1)] for t in texts]
        codes = np.concatenate([sum(c[i:i + len(t)] << 21 * (GRAM - 1 - i) for i in range(GRAM))
                                for c, t in zip(ahead, texts, strict=True) if len(t)])
        order = np.argsort(codes, kind="stable")
        grams, starts = np.unique(codes[order], return_index=True)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        places = np.concatenate([np.arange(len(t), dtype="int32") for t in texts])
        ends = pa.array(np.r_[starts, len(codes)], pa.int32())
        names = ["".join(chr(c) for c in (int(g) >> 21 * (GRAM - 1 - i) & NO_CHAR for i in range(GRAM)) if c != NO_CHAR)
                 for g in grams]
        found = pa.chunked_array(keys).combine_chunks().take(pa.array(rows[order]))
        yield from pa.table([pa.array(names, pa.string()), pa.repeat(field, len(names)),
                             pa.ListArray.from_arrays(ends, found),
                             pa.ListArray.from_arrays(ends, pa.array(places[order]))],
                            ["gram", "field", "keys", "places"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments(batches, fields, cut, lambda texts: sum(map(len, texts)), lists)

    rows = df.select(F.col(key).alias("key"), *map(_lowered, fields)).mapInArrow(
        run, f"gram string, field string, keys array<{df.schema[key].dataType.simpleString()}>, places array<int>")
    return rows.withColumn("bucket", bucket_of(F.substring("gram", 1, 2)))


def write_postings(postings: DataFrame, path: str) -> None:
    # in slices: what one map task sends to one partition can't be split
    term = F.col(postings.columns[0])
    spread = (postings.withColumn("slice", F.pmod(F.hash(term), F.lit(SLICES)))
              .hint("rebalance", F.col("bucket"), F.col("slice")).drop("slice"))
    if "gram" in postings.columns:  # searches push an equality of grams, but none of tokens
        spread = spread.sortWithinPartitions("bucket", "gram")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def fragments(term: str) -> tuple[list[str], bool]:
    """The parts of a term that lie inside one token each, and whether they say all that the
    term asks (one part, with wildcards at its ends at most)."""
    parts = [p for p in re.split(r"[\s*]+", term) if p]
    return parts, len(parts) == 1 and term.strip("*") == parts[0]


def keys_with_fragment(dictionary: DataFrame, postings: DataFrame, fragment: str, fields: list[str]) -> DataFrame:
    """(key) of the documents with a token that contains the fragment, whatever its case."""
    matched = dictionary.where(F.contains("token", F.lower(F.lit(fragment))))
    # one row of at most BUCKETS numbers: the partitions to read, and what a broadcast would weigh
    found = matched.agg(F.collect_set("bucket").alias("buckets"),
                        F.sum(F.octet_length("token") + F.lit(16)).alias("size")).first()
    side = matched.select("token")
    if (found["size"] or 0) <= MATCH_BYTES:
        side = F.broadcast(side)
    rows = postings.where(F.col("bucket").isin(found["buckets"]) & F.col("field").isin(fields))
    return rows.join(side, "token", "left_semi").select(F.explode("keys").alias("key")).distinct()


def keyword_search(df: DataFrame, key: str, dictionary: DataFrame, postings: DataFrame, terms: list[str],
                   fields: list[str]) -> DataFrame:
    """``df`` (whose ``key`` is unique) where every term occurs in one of the fields: the rows of
    ``search.keyword_filter``. Texts are read for terms that span tokens only, and then only of
    the documents that hold all their parts."""
    from docscope.operators.search import keyword_filter

    out, left = df, []
    for term in terms:
        if term in ("", "*"):
            continue
        parts, enough = fragments(term)
        for part in parts:
            hits = keys_with_fragment(dictionary, postings, part, fields)
            out = out.join(hits.withColumnRenamed("key", key), key, "left_semi")
        if not enough:
            left.append(term)
    return keyword_filter(out, left, tuple(fields)) if left else out


def cover(query: str) -> list[tuple[int, str]]:
    """(offset, gram): grams side by side over the query, the last one at its end."""
    offsets = [*range(0, len(query) - GRAM + 1, GRAM)]
    if offsets and offsets[-1] + GRAM < len(query):
        offsets.append(len(query) - GRAM)
    return [(o, query[o:o + GRAM]) for o in offsets]


def substring_keys(postings: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """(key) of the documents whose field contains the query (lower-cased, two characters at least)."""
    rows = postings.where(F.col("field").isin(fields))
    grams = cover(query)
    if not grams:
        return rows.where((F.col("bucket") == bucket_of(F.lit(query[:2]))) & F.col("gram").startswith(query)).select(
            F.explode("keys").alias("key")).distinct()
    offsets: dict[str, list[int]] = {}
    for o, g in grams:
        offsets.setdefault(g, []).append(o)
    here = F.lit(False)
    starts = F.lit(None).cast("array<int>")
    for g, os in offsets.items():
        # equality on a literal is pushed to the scan, as is the partition
        here = here | ((F.col("bucket") == bucket_of(F.lit(g[:2]))) & (F.col("gram") == g))
        starts = F.when(F.col("gram") == g, F.array(*[F.col("place") - o for o in os])).otherwise(starts)
    if len(grams) == 1:
        return rows.where(here).select(F.explode("keys").alias("key")).distinct()
    each = rows.where(here).select("gram", "field", F.inline(F.arrays_zip("keys", "places")).alias("key", "place"))
    placed = each.select("key", "field", F.explode(starts).alias("start"))
    return (placed.groupBy("key", "field", "start").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(grams)).select("key").distinct())


def substring_search(index: DataFrame, key: str, postings: DataFrame, query: str,
                     fields: list[str]) -> DataFrame | None:
    """Rows of ``index`` whose title or text contains the query: those of ``search.substring_hits``."""
    from docscope.operators.search import MIN_QUERY_CHARS

    q = (query or "").strip()
    if len(q) < MIN_QUERY_CHARS:
        return None
    hits = substring_keys(postings, q.lower(), fields)
    return index.join(hits.withColumnRenamed("key", key), key, "left_semi")
