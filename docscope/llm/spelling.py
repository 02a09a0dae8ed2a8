"""Spelling variants: words one insertion, deletion or replacement apart, and their forms.

``word_counts`` counts the words of all documents with SQL functions. ``near_words`` finds for
every word its near words with a bidirectional FM-index over the delimited
vocabulary (every word between U+0000): the index holds the Burrows-Wheeler
transform of that text and of its mirror, and an interval of suffix ranks in each. A
pattern grows by one character to the left or to the right, and both intervals follow.

Search scheme. A word is cut into halves. One error leaves one half whole:

* right search: match the left half exactly from the middle leftwards up to the delimiter,
  then go on to the right across the other half allowing one error, to the delimiter;
* left search: match the right half exactly rightwards to the delimiter, then go left
  across the other half allowing one error. Words that begin with the left half too were
  found by the right search and don't count again.

A state of a search is an interval and a place in the word; where its error may still
come it branches into the characters that occur next in the interval. All states of a block of
words advance together, as arrays.

Shards. For right searches the vocabulary is range-partitioned by word, for left searches by
mirrored word, so the words that share a half are neighbours: a word visits the shards that its
half's range touches (nearly always one), and very frequent halves are split over several.
Tasks are (shard, block of words): ``SHARD_WORDS`` indexed words and ``BLOCK_WORDS`` searched ones at
most, which bounds memory. Every word lies in one shard of each kind, so a near word
is found once and a task sums its finds per searched word before the shuffle.
The driver holds the shards' first and last words only.

``variant_groups`` adds the form (the near word of largest n, ties to the smaller word, if
its n is at least ``RATIO`` times the word's) and the root: forms followed to the last, by
doubling; n grows along the way, so there is no cycle.

Edge cases: null and empty texts have no words. A null doc_id hashes as the empty text.
Repeated rows count again. A word of any length is whole. An empty vocabulary gives an
empty result. Words are not empty and hold no U+0000, the delimiter. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.llm.common import blocks_for, clean_columns, prepare, stash

RUN = r"[A-Za-zÀ-ÿ]+"
#: One in so many (document, run) pairs loses a character.
DELETE_EVERY = 97
MIN_CHARS, MIN_COUNT = 5, 3
RATIO = 2
SHARD_WORDS = 60_000
BLOCK_WORDS = 60_000
#: States that advance together, before they branch; places looked up together.
STATES = 16_000
LOOKUPS = 1 << 17
_LAST = "\U0010ffff"


def lower_ascii(x: Column) -> Column:
    """A-Z lower-cased; ``translate`` only where ``lower`` would change more."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(
        F.translate(x, ascii_uppercase, ascii_lowercase))


def word_counts(docs: DataFrame, run: str = RUN, delete_every: int = DELETE_EVERY, min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text): lower-cased runs, of which
    those whose hash with the doc_id ``delete_every`` divides lose one character."""
    rows = clean_columns(docs, "doc_id", "text").select("doc_id", F.explode(
        F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("found"))
    # a document's hash names its runs: equal runs of one document are one row from here on where they meet
    lowered = rows.select("doc_id", lower_ascii(F.col("found")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    word = F.when(F.col("h") % delete_every == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).filter(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling until all differ. Text ends like no other place."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - step] = rank[step:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class Transform:
    """Burrows-Wheeler transform with counts at every 64th place."""

    BLOCK = 64

    def __init__(self, text: np.ndarray, order: np.ndarray, letters: int):
        n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        self.blocks = np.full((n // self.BLOCK + 1, self.BLOCK), letters, np.uint16 if letters > 255 else np.uint8)
        self.flat = self.blocks.reshape(-1)
        self.flat[:n] = text[order - 1]  # the text is taken as a ring
        self.seen = np.zeros((len(self.blocks), letters + 1), np.int32)
        row = np.repeat(np.arange(len(self.blocks)), self.BLOCK)[:n]
        np.add.at(self.seen, (row[row + 1 < len(self.seen)] + 1, self.flat[:n][row + 1 < len(self.seen)]), 1)
        np.cumsum(self.seen, axis=0, out=self.seen)
        self.less = np.concatenate([np.zeros((len(self.seen), 1), np.int32), np.cumsum(self.seen, axis=1)[:, :-1]],
                                   axis=1).astype(np.int32)

    def rank(self, letter: np.ndarray, at: np.ndarray, less: bool = False) -> np.ndarray:
        """How often ``letter`` (or with ``less`` any smaller one) stands before place ``at``."""
        block, rest = at // self.BLOCK, at % self.BLOCK
        out = (self.less if less else self.seen)[block, letter].astype(np.int64)
        for x in range(0, len(at), LOOKUPS):
            part = slice(x, x + LOOKUPS)
            inside = self.blocks[block[part]]
            aim = letter[part, None].astype(inside.dtype)
            hit = (inside < aim) if less else (inside == aim)
            hit &= np.arange(self.BLOCK) < rest[part, None]
            out[part] += hit.sum(axis=1)
        return out


class BidirectionalIndex:
    """Intervals (low, high) of the text's suffixes that begin with a pattern, with ``mirror``,
    the low end of the mirrored text's suffixes that begin with the mirrored pattern."""

    def __init__(self, words: list[str]):
        text = "\0" + "\0".join(words) + "\0"
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.letters, coded = np.unique(code, return_inverse=True)
        coded = coded.astype(np.int64)
        self.n, self.delimiter = len(coded), 0  # the smallest letter
        self.order = suffix_array(coded)
        self.left = Transform(coded, self.order, len(self.letters))
        back = coded[::-1].copy()
        self.mirror_order = suffix_array(back)
        self.right = Transform(back, self.mirror_order, len(self.letters))
        self.starts = np.flatnonzero(coded == self.delimiter)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words in one array (-1: no such letter here), their starts and lengths."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        return np.where(self.letters[at] == code, at, -1), np.cumsum(size) - size, size

    def extend(self, rightwards: bool, letter: np.ndarray, low: np.ndarray, high: np.ndarray,
               mirror: np.ndarray | None = None):
        """(low, high, mirror) after one more letter on that side. ``low`` and ``high`` lie in the text's
        order when going left, in the mirror's when going right; ``mirror`` is the low end in the other."""
        t = self.right if rightwards else self.left
        letter = np.maximum(letter, 0)
        a, b = t.rank(letter, low), t.rank(letter, high)
        if mirror is not None:
            mirror = mirror + t.rank(letter, high, True) - t.rank(letter, low, True)
        return t.first[letter] + a, t.first[letter] + b, mirror

    def next_letters(self, rightwards: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) of the letters that follow on that side, each once, delimiters not."""
        t = self.right if rightwards else self.left
        small = high - low <= len(self.letters)
        size = np.where(small, high - low, 0)
        state = np.repeat(np.arange(len(low)), size)
        place = low[state] + np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size)
        few = np.unique(state * len(self.letters) + t.flat[place])
        many = (np.flatnonzero(~small)[:, None] * len(self.letters) + np.arange(len(self.letters))).ravel()
        key = np.concatenate([few, many])
        letter = key % len(self.letters)
        keep = letter != self.delimiter
        return key[keep] // len(self.letters), letter[keep]


def find_near(index: BidirectionalIndex, words: list[str], rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(searched word, found word) numbers, each pair once: the right (or left) search of the scheme."""
    code, start, size = index.encode(words)
    half = size // 2
    who = np.arange(len(words))
    # the half that stays whole, from the middle to its delimiter
    reach = half if rightwards else size - half
    low, high, mirror = np.zeros(len(words), np.int64), np.full(len(words), index.n), np.zeros(len(words), np.int64)
    step, done = 0, [np.zeros(0, np.int64)] * 4
    while len(who):
        more = step < reach[who]
        place = start[who] + np.where(rightwards, half[who] - 1 - step, half[who] + step)
        letter = np.where(more, code[np.where(more, place, 0)], index.delimiter)
        known = letter >= 0
        low, high, mirror = index.extend(not rightwards, letter, low, high, mirror)
        go = known & (high > low)
        ended = go & (step == reach[who])
        done = [np.concatenate([d, x[ended]]) for d, x in zip(done, (who, low, high, mirror))]
        go &= ~ended
        who, low, high, mirror = (x[go] for x in (who, low, high, mirror))
        step += 1
    # over to the other side: its interval is as long and begins at the mirror's low end
    who, low, high, mirror = done
    high, low = mirror + high - low, mirror
    found_who, found_rank = [], []
    waiting = [(who, low, high, np.zeros(len(who), np.int64), np.ones(len(who), bool))]
    span = np.where(rightwards, size - half, half)

    def letter_at(who, place):
        at = start[who] + np.where(rightwards, half[who] + place, half[who] - 1 - place)
        return np.where(place < span[who], code[np.where(place < span[who], at, 0)], index.delimiter)

    while waiting:
        who, low, high, place, whole = waiting.pop()
        if len(who) > STATES:
            cut = len(who) // 2
            waiting += [tuple(x[:cut] for x in (who, low, high, place, whole)),
                        tuple(x[cut:] for x in (who, low, high, place, whole))]
            continue
        # the letter that the word has next, with or without an error so far
        steps = [(np.arange(len(who)), letter_at(who, place), place + 1, whole)]
        may = np.flatnonzero(whole)
        branch, letter = index.next_letters(rightwards, low[may], high[may])
        branch = may[branch]
        swap = (place[branch] < span[who[branch]]) & (letter != letter_at(who[branch], place[branch]))
        for some, to in ((swap, 1), (np.ones(len(branch), bool), 0)):  # another letter, or one more
            steps.append((branch[some], letter[some], place[branch[some]] + to, np.zeros(int(some.sum()), bool)))
        state, letter, to, left = (np.concatenate(x) for x in zip(*steps))
        known = letter >= 0
        state, letter, to, left = state[known], letter[known], to[known], left[known]
        lo, hi, _ = index.extend(rightwards, letter, low[state], high[state])
        alive = hi > lo
        state, to, left, lo, hi = state[alive], to[alive], left[alive], lo[alive], hi[alive]
        owner = who[state]
        ended = to > span[owner]  # the delimiter has been read; without an error it is the word itself
        hit = ended & ~left
        found_who.append(owner[hit])
        found_rank.append(lo[hit])
        # a letter of the word left out: the interval stays, the place moves on
        skip = may[(place[may] < span[who[may]]) & (size[who[may]] > 1)]  # no word is empty
        go = ~ended
        ahead = [np.concatenate(x) for x in (
            (owner[go], who[skip]), (lo[go], low[skip]), (hi[go], high[skip]), (to[go], place[skip] + 1),
            (left[go], np.zeros(len(skip), bool)))]
        if len(ahead[0]):
            waiting.append(tuple(ahead))
    w, rank = np.concatenate(found_who), np.concatenate(found_rank)
    if rightwards:  # ranks in the mirror's order: its text place is counted from the end
        begin = index.n - 1 - index.mirror_order[rank]
        word = np.searchsorted(index.starts, begin) - 1
    else:
        word = np.searchsorted(index.starts, index.order[rank])
    pairs = np.unique(np.stack([w, word]), axis=1)
    return pairs[0], pairs[1]


def _route(bounds: dict[bool, tuple[list[str], list[str]]]):
    """Shards whose range the exact half of a word touches."""
    schema = pa.schema([("rightwards", pa.bool_()), ("shard", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for side, key in zip(batch.column("rightwards").to_pylist(), batch.column("key").to_pylist()):
                first, last = bounds[side]
                whole = key[:len(key) // 2 if side else len(key) - len(key) // 2]
                for shard in range(bisect_left(last, whole), bisect_right(first, whole + _LAST)):
                    for column, value in zip(out, (side, shard, key if side else key[::-1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
    return run


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(rows: pa.Table) -> pa.Table:
    """One shard's index and one block of words: near words found, summed per searched word."""
    rightwards = rows["rightwards"][0].as_py()
    indexed = rows.filter(rows["indexed"])
    words, n = indexed["word"].to_pylist(), indexed["n"].to_numpy()
    asked = rows.filter(pa.compute.invert(rows["indexed"]))["word"].to_pylist()
    who, found = find_near(BidirectionalIndex(words), asked, rightwards) if words and asked else ([], [])
    near, best = defaultdict(int), {}
    for w, v in zip(who, found):
        word, other = asked[w], words[v]
        if not rightwards and other.startswith(word[:len(word) // 2]):
            continue
        near[word] += 1
        best[word] = min(best.get(word, (0, "")), (-int(n[v]), other))
    return pa.table([list(near), list(near.values()), [-best[w][0] for w in near], [best[w][1] for w in near]],
                    schema=_FOUND)


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``vocabulary``: (word, n), words distinct. Returns (word, n_near, best_n, best) for the words
    that have a near word: how many, and the one of largest n (ties: the smallest)."""
    prepare(vocabulary.sparkSession)
    vocabulary = stash(clean_columns(vocabulary, "word", "n"), "spell-words")
    shards = blocks_for(vocabulary.count(), shard_words)

    def sharded(rightwards: bool, key: Column) -> DataFrame:
        return (vocabulary.withColumn("key", key).repartitionByRange(shards, "key")
                .withColumn("range", F.spark_partition_id()).withColumn("rightwards", F.lit(rightwards)))

    ranged = stash(sharded(True, F.col("word")).unionByName(sharded(False, F.reverse("word"))), "spell-ranges")
    ends = ranged.groupBy("rightwards", "range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = ends.withColumn("shard", F.row_number().over(Window.partitionBy("rightwards").orderBy("lo")) - 1)
    ends = stash(ends, "spell-ends")
    bounds = {side: ([], []) for side in (True, False)}
    for r in ends.orderBy("rightwards", "shard").collect():
        bounds[r["rightwards"]][0].append(r["lo"])
        bounds[r["rightwards"]][1].append(r["hi"])
    visits = stash(ranged.select("rightwards", "key").mapInArrow(
        _route(bounds), "rightwards boolean, shard int, word string"), "spell-visits")
    blocks = visits.groupBy("rightwards", "shard").agg(F.ceil(F.count(F.lit(1)) / block_words).cast("int").alias("blocks"))
    asked = visits.join(blocks, ["rightwards", "shard"]).select(
        "rightwards", "shard", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(False).alias("indexed"),
        "word", F.lit(0).cast("long").alias("n"))
    indexed = (ranged.join(ends.select("rightwards", "range", "shard"), ["rightwards", "range"])
               .join(blocks, ["rightwards", "shard"])
               .select("rightwards", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                       F.lit(True).alias("indexed"), "word", F.col("n").cast("long").alias("n")))
    found = asked.unionByName(indexed).groupBy("rightwards", "shard", "block").applyInArrow(
        _search, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")).select(
            "word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``forms``: (word, form), without cycles. Returns (word, root): forms followed to the last."""
    roots = stash(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        ahead = roots.select(F.col("word").alias("via"), F.col("root").alias("next"))
        doubled = stash(roots.join(ahead, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        roots = doubled.select("word", "root")
        if doubled.filter("moved").isEmpty():
            return roots


def variant_groups(vocabulary: DataFrame, ratio: float = RATIO, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``vocabulary`` (word, n)."""
    vocabulary = stash(clean_columns(vocabulary, "word", "n"), "spell-vocabulary")
    near = near_words(vocabulary, **options)
    is_form = F.col("best_n") >= F.col("n") * ratio
    known = stash(vocabulary.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "spell-forms")
    roots = last_forms(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
