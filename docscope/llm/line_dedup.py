"""Line dedup over all documents (DataFrame and SQL functions only).

Every line becomes a row of its key's 128-bit hash, its document and its position;
texts are read once and travel no further. The rows are range-partitioned by (hash,
document, largest first) and sorted inside a partition by hash, document and position.
A line that very many documents hold is thereby split over several partitions. In this
order each partition streams past the first occurrence in every document and sums them up
to one row per hash: how many documents hold it, and which one keeps it. A small second aggregation joins the
ends of a hash that crosses partitions, so a hot line costs it one row per partition.

A repeated line (in ``min_docs`` documents or more) stays in its first document, the
largest doc_id, and goes from all others. The lost positions come back as a compressed
bitmap per document: ``bits`` holds the 64-line words with any line lost, words of which
every line stays are left out. The general interface is ``keep_bitmaps`` (no text in
its result) and ``apply_bitmaps``, which cuts the texts.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Lines whose key is shorter than ``min_chars`` code points always stay.

Edge cases: a null or empty text is one empty line (kept text: empty). Rows of the same
doc_id are one document: a repeated line stays in all rows of the largest
doc_id. Rows without doc_id are one document that is smaller than all others. A line
repeated inside one document counts once. Very long texts are whole: their
positions spread over as many words as needed. An empty table gives an empty result. Extra
columns are ignored (``keep_bitmaps``) or kept (``apply_bitmaps``).
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.llm.common import blocks_for, clean_columns, fresh, stash

#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Lines a range partition holds at about 60 bytes each.
RANGE_ROWS = 1_000_000
WORD_BITS = 64


def lines_of(text) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Trimmed, A-Z lower-cased; ``translate`` only where ``lower`` would change more."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, ascii_uppercase, ascii_lowercase))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, position) of every line long enough to be compared;
    ``row`` tells apart the texts of one doc_id."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"),
                       F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    # what is shorter before trimming is so after it
    keyed = rows.filter(F.char_length("line") >= min_chars).select(
        "doc_id", "row", "position", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "row", "position")


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, row, position) of the lines that go."""
    rows = stash(line_rows(clean_columns(docs, "doc_id", "text"), min_chars), "line-rows")
    parts = blocks_for(rows.count(), range_rows)
    order = [F.col("h1").asc(), F.col("h2").asc(), F.col("doc_id").desc_nulls_last()]
    # equal (hash, document) rows lie in one range, so the window below needs no shuffle of its own
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("position", "row")) == 1
    ranged = stash(rows.repartitionByRange(parts, *order).withColumn("first", first)
                   .withColumn("range", F.spark_partition_id()), "line-ranges")
    per_range = stash(ranged.filter("first").groupBy("range", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")), "line-heads")
    whole = per_range.groupBy("h1", "h2").agg(
        F.sum("n").alias("n"), F.max("keeper").alias("keeper")).filter(F.col("n") >= min_docs)
    # every range of a hash gets its verdict, so that no task joins more lines of it than a range holds
    known = per_range.select("range", "h1", "h2").join(whole.select("h1", "h2", "keeper"), ["h1", "h2"])
    return (ranged.join(known, ["range", "h1", "h2"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "row", "position"))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, row, n_dropped, bits): one row per document that loses lines. ``bits`` is an
    array of (word, lost): bit b of ``lost`` set means line 64 * word + b goes."""
    word = F.floor(F.col("position") / WORD_BITS).cast("int")
    words = lost_lines(docs, **options).groupBy("doc_id", "row", word.alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, position % {WORD_BITS})")).alias("lost"))
    return words.groupBy("doc_id", "row").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", "lost"))).alias("bits"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (names lengthened if taken)."""
    names = docs.columns
    row, d, r, lines, bits, lost = (fresh(x, names) for x in (
        "line_row", "line_doc", "line_key", "line_all", "line_bits", "line_lost"))
    kept, n, dropped = (fresh(x, names) for x in ("kept_text", "n_lines", "n_dropped"))
    found = bitmaps.select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("bits").alias(bits),
                           F.col("n_dropped").alias(lost))
    joined = docs.withColumn(row, F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(row) == F.col(r)), "left")
    # 64 lines at a time: one look into the bitmap for each word
    marks = F.map_from_entries(F.col(bits))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD_BITS).cast("int")), lambda w: F.struct(
        w.alias("word"), F.coalesce(F.try_element_at(marks, w), F.lit(0).cast("long")).alias("lost")))
    cut = F.array_join(F.flatten(F.transform(words, lambda w: F.filter(
        F.slice(lines, w["word"] * WORD_BITS + 1, WORD_BITS),
        lambda x, i: F.getbit(w["lost"], i) == 0))), "\n")
    text = F.when(F.col(bits).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(cut)
    return (joined.withColumn(lines, lines_of(F.col("text")))
            .select(*[F.col(f"`{c}`") for c in names], text.alias(kept),
                    F.size(lines).cast("long").alias(n), F.coalesce(lost, F.lit(0)).cast("long").alias(dropped)))
