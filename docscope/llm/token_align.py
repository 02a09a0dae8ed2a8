"""Alignment of two tokenizers' token sequences over whole documents.

A text is encoded by a byte-level BPE (A) and a SentencePiece BPE with byte fallback (B).
Where tokens of both end at the same byte, the sequences are cut into groups: the
cumulative ends of each side are a dictionary from end to index, the intersection of
the two key sets, sorted, slices both id lists, and every slice is expanded into its
links, the pairs of an A and a B token whose byte ranges overlap.

Texts are cut into units first: a space inside the text, after a character that is no white space, begins one.
No token of either side crosses such a place, so both sides end there and groups never
reach over it; a unit's tokens, groups and links do not depend on its
text. A task therefore encodes and aligns each distinct unit once (a batch's new ones as one text) and
keeps it in a dictionary, a *chunk*, which is closed and begun anew when it holds ``CHUNK_UNITS`` units or
has served ``CHUNK_USES`` of them. A document comes out as the list of its units'
numbers, a chunk as one row: links by unit, and how often each linked pair of ids occurs.

Corpus counts (how many links hold an id pair, over all documents, and each B id's
highest) are sums of the chunks' counts. They are joined to the pairs of each chunk,
never to the tokens of each document: the documents of a chunk meet its counted pairs in one
group, whose size the two bounds limit, and sum over their units. Nothing is collected
or broadcast but the two vocabulary files, which the driver reads and ships.

Edge cases: null and empty texts, and texts whose joined A or B bytes differ from space
and text (such as those with U+2581), have no tokens: zeros, no groups, and they count nothing.
Very long texts are whole (a unit without spaces may be a whole text). Special token
strings in a text are plain text. Repeated rows are rows of their own. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import clean_columns, prepare, stash

# Fixed value: how a byte-level BPE cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_UNITS = 400_000
CHUNK_USES = 8_000_000
#: A space begins a unit unless white space, its mark or the text's start is before it or the text's end behind.
_CUT = re.compile("(?<=[^\\s▁᠎]) (?=.)", re.DOTALL)
#: Ends that a following space could join in one token, and the mark that never comes back as itself.
_BLUNT = re.compile("[\\s᠎]\\Z|▁")
_ODD = re.compile("[\\s▁᠎] ")


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """``text`` cut into units, each without the space that begins it."""
    if text.startswith(" ") or text.endswith(" ") or _ODD.search(text):
        return _CUT.split(text)
    return text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes in order for U+0100 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both encoders and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        known = byte_alphabet()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = t.encode() if i in special else bytes(map(known.__getitem__, t))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.ascii = self._by_rank(json.loads(byte_bpe)["model"])
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.text = GroupText(max(len(self.a_bytes), len(self.b_bytes)))

    def _by_rank(self, model: dict):
        """A's fast form for ASCII text: where merge i makes id 256 + i, merging by id is merging by rank.
        Other texts take the file's own tokenizer, whose Unicode classes count."""
        import tiktoken

        made = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        if any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(made)):
            return None
        ranks = {t: i for i, t in enumerate(self.a_bytes[:256 + len(model["merges"])])}
        return tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of units that follow each other as in a text."""
        text = " " + " ".join(new)
        a = (self.ascii.encode_ordinary(text) if self.ascii and text.isascii()
             else self.a.encode(text, add_special_tokens=False).ids)
        return np.array(a, np.int64), np.array(list(chain.from_iterable(self.b.encode(new, num_threads=1))), np.int64)

    def whole(self, new: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both sides give the units back."""
        text = (" " + " ".join(new)).encode()
        return all(b"".join(map(known.__getitem__, ids.tolist())) == text
                   for known, ids in ((self.a_bytes, a), (self.b_bytes, b)))


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends, and the number of A's and of B's tokens up to each: the slices'
    ends in both id lists."""
    at_a, at_b = (dict(zip(ends.tolist(), range(1, len(ends) + 1))) for ends in (a_ends, b_ends))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.fromiter(x, np.int64, len(common)) for x in (
        common, map(at_a.__getitem__, common), map(at_b.__getitem__, common)))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, A index, B index) of every overlapping pair of tokens, slice after slice:
    inside a slice each end, of either side, closes the overlap of one pair."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class GroupText:
    """Groups as text: every id followed by the sign that its place in its group asks for."""

    def __init__(self, ids: int):
        self.signed = {sign: np.array([f"{i}{sign}" for i in range(ids)], object) for sign in ",|;"}

    def parts(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> np.ndarray:
        """Ids and signs, slice after slice, A's before B's."""
        out = np.empty(len(a) + len(b), object)
        for ids, to, other, sign in ((a, to_a, np.concatenate([[0], to_b[:-1]]), "|"), (b, to_b, to_a, ";")):
            place = np.arange(len(ids)) + np.repeat(other, np.diff(to, prepend=0))
            text = self.signed[","][ids]
            text[to - 1] = self.signed[sign][ids[to - 1]]
            out[place] = text
        return out


class Chunk:
    """Distinct units of some documents, numbered as they come."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.n_links = (array("q") for _ in range(4))
        self.links = array("q")
        self.used = np.zeros(0, np.int64)
        self.uses = 0

    def learn(self, new: list[str], tokenizers: Tokenizers) -> None:
        """Encode and align units not seen yet: as one text, but for those whose end would
        melt into the next one's space, and one by one where some don't come back whole."""
        alone = [u for u in new if _BLUNT.search(u)]
        together = [u for u in new if not _BLUNT.search(u)] if alone else new
        plain = [u for u in together if u.isascii()]
        rest = [u for u in together if not u.isascii()]
        for some in filter(None, [plain, rest, *([u] for u in alone)]):
            a, b = tokenizers.encode(some)
            if tokenizers.whole(some, a, b):
                self.add(some, a, b, tokenizers)
            elif len(some) == 1:
                self.number[some[0]] = -1
            else:
                half = len(some) // 2
                self.learn(some[:half], tokenizers)
                self.learn(some[half:], tokenizers)

    def add(self, new: list[str], a: np.ndarray, b: np.ndarray, tokenizers: Tokenizers) -> None:
        a_ends, b_ends = np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in new])
        common, to_a, to_b = group_ends(a_ends, b_ends)
        ends, i, j = links_of(a_ends, b_ends)
        counts = [np.searchsorted(x, unit_ends, "right") for x in (a_ends, b_ends, common, ends)]
        parts = tokenizers.text.parts(a, b, to_a, to_b).tolist()
        cut = [0, *(counts[0] + counts[1]).tolist()]
        self.number.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        self.text += ["".join(parts[x:y]) for x, y in zip(cut, cut[1:])]
        for column, n in zip((self.n_a, self.n_b, self.n_groups, self.n_links), counts):
            column.frombytes(np.diff(n, prepend=0).tobytes())
        self.links.frombytes((a[i] << 32 | b[j]).tobytes())

    def use(self, flat: np.ndarray) -> None:
        n = np.bincount(flat, minlength=len(self.text))
        n[:len(self.used)] += self.used
        self.used, self.uses = n, self.uses + len(flat)

    def full(self) -> bool:
        return len(self.number) >= CHUNK_UNITS or self.uses >= CHUNK_USES

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First link of each unit, pair number of each link, the pairs, and their counts."""
        each = np.frombuffer(self.n_links, np.int64) if self.n_links else np.zeros(0, np.int64)
        used = np.zeros(len(each), np.int64)
        used[:len(self.used)] = self.used
        codes = np.frombuffer(self.links, np.int64) if self.links else np.zeros(0, np.int64)
        pair, place = np.unique(codes, return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, place, np.repeat(used, each))
        return np.cumsum(each) - each, place, pair, n


_FIELDS = [("chunk", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
           ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
           ("units", pa.list_(pa.int32())), ("unit_starts", pa.list_(pa.int32())),
           ("unit_pairs", pa.list_(pa.int32())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
           ("n", pa.list_(pa.int64()))]
_DDL = ("chunk long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "units array<int>, unit_starts array<int>, unit_pairs array<int>, a array<int>, b array<int>, n array<long>")
_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]


def _align(byte_bpe: str, pieces: bytes, render: Callable[[str], str]):
    schema = pa.schema(_FIELDS)

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.get(f.name, None) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def summary(chunk: Chunk, name: int) -> pa.RecordBatch:
        starts, place, pair, n = chunk.pairs()
        lists = {"unit_starts": starts, "unit_pairs": place, "a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": n}
        return rows({"chunk": pa.array([name]), "is_doc": pa.array([False])} | {
            k: pa.array([v], schema.field(k).type) for k, v in lists.items()}, 1)

    def documents(chunk: Chunk, name: int, ids: pa.Array, cut: list[list[str]]) -> pa.RecordBatch:
        number, text = chunk.number, chunk.text
        lists, groups = [], []
        for parts in cut:
            found = list(map(number.__getitem__, parts))
            if -1 in found:
                found = []
            lists.append(found)
            groups.append(render("".join(map(text.__getitem__, found))[:-1]) if found else "")
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]))
        chunk.use(flat)
        columns = {"chunk": pa.array(np.full(len(cut), name)), "is_doc": pa.array([True] * len(cut)), "doc_id": ids,
                   "groups": pa.array(groups, pa.string()), "units": pa.ListArray.from_arrays(
                       pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            known = getattr(chunk, k)
            each = np.frombuffer(known, np.int64)[flat] if known else flat
            each = np.concatenate([[0], np.cumsum(each)])
            columns[k] = pa.array(each[ends[1:]] - each[ends[:-1]], pa.int64())
        return rows(columns, len(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, chunk = Tokenizers(byte_bpe, pieces), Chunk()
        name = TaskContext.get().partitionId() << 24
        for batch in batches:
            cut = [units(t) if t else [] for t in batch.column("text").to_pylist()]
            new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in chunk.number]
            if new:
                chunk.learn(new, tokenizers)
            yield documents(chunk, name, batch.column("doc_id").cast(pa.int64()), cut)
            if chunk.full():
                yield summary(chunk, name)
                chunk, name = Chunk(), name + 1
        yield summary(chunk, name)
    return run


def _count(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """Sums over the units of a chunk's documents, from its counted pairs."""
    shared = docs.filter(pa.compute.invert(docs["is_doc"]))
    docs = docs.filter(docs["is_doc"])
    starts, place = (shared[c].combine_chunks().flatten().to_numpy() for c in ("unit_starts", "unit_pairs"))
    count = np.zeros(counted.num_rows, np.int64)
    best = np.zeros(counted.num_rows, np.int64)
    at = counted["place"].to_numpy()
    count[at], best[at] = counted["total"].to_numpy(), counted["best"].to_numpy()
    columns = [docs[c] for c in _OUT]
    lists = docs["units"].combine_chunks()
    flat = lists.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
    for value in (best, count):
        per_unit = np.add.reduceat(value[place], starts) if len(starts) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(per_unit[flat])]).astype(np.int64)
        columns.append(pa.array(upto[ends[1:].astype(np.int64)] - upto[ends[:-1].astype(np.int64)], pa.int64()))
    return pa.table(columns, names=[*_OUT, "n_best", "count_sum"])


def align_documents(docs: DataFrame, render: Callable[[str], str] = str, byte_bpe: str | None = None,
                    pieces: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of
    ``docs`` (doc_id, text). ``groups`` holds ``render`` of the groups as text: ids joined by ",",
    sides by "|", groups by ";" (without tokens the empty text, not rendered)."""
    spark = docs.sparkSession
    prepare(spark)
    default = vocabulary_files()
    with open(byte_bpe or default[0], encoding="utf-8") as f:
        a_file = f.read()
    with open(pieces or default[1], "rb") as f:
        b_file = f.read()
    aligned = stash(clean_columns(docs, "doc_id", "text").mapInArrow(_align(a_file, b_file, render), _DDL),
                    "align-documents", compression="zstd")
    pairs = stash(aligned.filter("not is_doc").select(
        "chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("chunk", "place", "p.*"),
        "align-pairs")
    total = stash(pairs.groupBy("b", "a").agg(F.sum("n").alias("total")), "align-counts")
    highest = total.groupBy("b").agg(F.max("total").alias("highest"))
    known = total.join(highest, "b").select(
        "a", "b", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    counted = pairs.select("chunk", "place", "a", "b").join(known, ["a", "b"]).select(
        "chunk", "place", "total", "best")
    parts = aligned.select("chunk", "is_doc", *_OUT, "units", "unit_starts", "unit_pairs")
    return parts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        _count, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
                "n_best long, count_sum long")
