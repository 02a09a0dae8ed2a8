"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units that no piece of the vocabulary crosses (spaces
and the word after them). The batch's new distinct units are concatenated and
indexed: their suffixes are sorted to the depth of the longest piece, every piece of the
vocabulary is binary-searched for its range of occurrences, and the occurrences are
the edges of a graph over text positions. The edges are sorted by end position and
relaxed in that order.

Relaxation for a BPE vocabulary: the encoding of every prefix ends with exactly one token,
and an edge is that token if and only if it is *compatible* with the token that ends
where it starts, that is, if encoding the two tokens' joined text gives these two
tokens again. So each position takes the one compatible incoming edge, and the
result equals merging by score, leftmost first. Compatibility follows from the vocabulary's
own merges and is remembered per pair.

Characters outside the vocabulary become byte pieces. Normalisation is the model's: spaces
become U+2581 and one is put in front; nothing else changes. Decoding joins the
pieces' bytes and takes the first space off, so it gives the text back
(U+2581 in a text comes back as a space).

Edge cases: null and empty texts have no tokens; decoding no tokens gives the
empty text; texts of any length are whole (a unit may be a whole text without
spaces: long ones are indexed window by window). Repeated rows stay. An empty table gives an empty result. Extra input
columns are ignored (``encode``, ``decode``).
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import prepare

SPACE = "▁"
#: Texts are gathered until their new units hold this many bytes, or this many rows are waiting.
INDEX_BYTES = 800_000
PENDING_ROWS = 1_024
PENDING_CHARS = 8_000_000
#: Units, and token pairs, that a task remembers (each starts anew when full).
UNIT_CACHE = 300_000
PAIR_CACHE = 600_000
#: Characters of the units that a task remembers, likewise.
CACHE_CHARS = 30_000_000
#: Units up to this length are relaxed together, position by position.
TOGETHER = 48
#: Longer units than this are indexed in windows of so many characters.
WINDOW = 100_000
_UNITS = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, merges and byte pieces of a BPE model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: "normal", "byte" or "control" by id."""
        self.size = len(pieces)
        self.unknown = self.size  # marks a character outside the vocabulary
        normal = [i for i in range(self.size) if kinds[i] == "normal"]
        self.id_of = {pieces[i]: i for i in normal}
        self.rank = [-s for s in scores] + [0.0]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(self.size) if kinds[i] == "byte"}
        self.out = [b"" if kinds[i] == "control" else bytes([int(pieces[i][3:5], 16)]) if kinds[i] == "byte"
                    else pieces[i].replace(SPACE, " ").encode() for i in range(self.size)]
        self.text = [pieces[i] if kinds[i] == "normal" else "" for i in range(self.size)]
        self.runs = {i for i in normal if not pieces[i].strip(SPACE)}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        if crossing:
            raise ValueError("a piece crosses from a word into the next space")
        # parts of each piece's last merge; pieces that their own text doesn't encode to are left out
        self.parts: dict[int, tuple[int, int]] = {}
        reachable = []
        for p, i in self.id_of.items():
            if len(p) == 1:
                reachable.append(i)
            else:
                tokens, last = self.merge(p)
                if tokens == [i]:
                    reachable.append(i)
                    self.parts[i] = last
        data = sorted((self.text[i].encode(), i) for i in reachable)
        self.width = max(len(b) for b, _ in data)
        self.keys = np.array([b for b, _ in data], dtype=f"S{self.width}")
        self.past = np.array([b + b"\xff" * (self.width - len(b)) for b, _ in data], dtype=f"S{self.width}")
        self.key_id = np.array([i for _, i in data], np.int64)
        self.chars = np.ones(self.size + 1, np.int64)
        self.chars[self.key_id] = [len(self.text[i]) for _, i in data]

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Tokens of a short ``text`` by merging, best score first, leftmost first;
        and the parts of the last merge."""
        sym: list[str | None] = list(text)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(sym) and (k := self.id_of.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (self.rank[k], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            last = (self.id_of.get(a, self.unknown), self.id_of.get(b, self.unknown))
            sym[i], sym[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [self.id_of.get(s, self.unknown) for s in sym if s is not None], last

    def compatible(self, a: int, b: int) -> bool:
        """Does the joined text of tokens ``a`` and ``b`` encode to ``a``, ``b``?"""
        if a == self.unknown or b == self.unknown:
            return True
        if a in self.runs and b in self.runs or a in self.runs and self.text[b][0] == SPACE:
            return self.merge(self.text[a] + self.text[b])[0] == [a, b]
        # walk back in time: undo the later of the two tokens' last merges; the tokens are apart
        # unless the parts that then met had a merge before the undone one
        limit = float("inf")
        rank, parts, text, id_of = self.rank, self.parts, self.text, self.id_of
        ties = 0  # at equal rank the merge further left goes first
        while True:
            k = id_of.get(text[a] + text[b])
            if k is not None and (rank[k] < limit or ties and rank[k] == limit):
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and rank[a] > rank[b]:
                limit, ties, a = rank[a], 0, pa_[1]
            else:
                limit, ties, b = rank[b], 1, pb[0]


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file (read on the driver only)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    ids = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else
             "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
             for i in ids]
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)


class Encoder:
    """Encodes texts of one task; remembers units and token pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.kept = 0
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text ``i`` are ``ids[offsets[i]:offsets[i + 1]]``."""
        if len(self.index) > UNIT_CACHE or self.kept > CACHE_CHARS:
            self._forget()
        cut = [_UNITS.findall(" " + t.replace(SPACE, " ")) if t else () for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.index]
        group, size = [], 0
        for u in new:  # index by index, each of bounded size
            if len(u) > WINDOW:
                self._learn([u])
                continue
            group.append(u)
            size += len(u)
            if size >= INDEX_BYTES:
                self._learn(group)
                group, size = [], 0
        if group:
            self._learn(group)
        counts = np.array([len(c) for c in cut], np.int64)
        unit = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        length = self.start[unit + 1] - self.start[unit]
        ends = np.cumsum(length)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(
            self.start[unit] - (ends - length), length)
        by_unit = np.concatenate([[0], ends])
        return self.flat[take], by_unit[np.concatenate([[0], np.cumsum(counts)])]

    def _learn(self, units: list[str]) -> None:
        ids, counts = self._long(units[0]) if len(units[0]) > WINDOW else self._units(units)
        base = len(self.index)
        for k, u in enumerate(units):
            self.index[u] = base + k
            self.kept += len(u)
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def _edges(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(character, piece id) of every occurrence of a piece in ``data`` (bytes),
        ``at`` being the byte offsets of characters."""
        w = self.v.width
        window = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([data, np.zeros(w, np.uint8)]), w)
        suffix = np.ascontiguousarray(window[at]).view(f"S{w}").ravel()
        order = np.argsort(suffix, kind="stable")  # the suffix array, to the longest piece
        suffix = suffix[order]
        low = np.searchsorted(suffix, self.v.keys, "left")
        high = np.searchsorted(suffix, self.v.past, "right")
        n = np.maximum(high - low, 0)
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1])) + np.repeat(low - (ends - n), n)
        return order[where], np.repeat(self.v.key_id, n)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, joined, and the number of ids of each."""
        v = self.v
        raw = "\x00".join(units).replace(" ", SPACE).encode() + b"\x00"
        data = np.frombuffer(raw, np.uint8)
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
        lengths = np.array([len(u) for u in units], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # first character of a unit; one more as separator
        own = np.ones(len(begins), bool)
        own[first + lengths] = False
        data = data.copy()
        data[begins[~own]] = 0xFF  # separators match nothing
        char_at = np.flatnonzero(own)
        char, piece = self._edges(data, begins[char_at])
        char = char_at[char]
        single = np.zeros(len(begins), bool)
        single[char[v.chars[piece] == 1]] = True
        lone = np.flatnonzero(own & ~single)
        char = np.concatenate([char, lone])
        piece = np.concatenate([piece, np.full(len(lone), v.unknown)])
        unit = np.searchsorted(first, char, "right") - 1
        end = char + v.chars[piece]  # node k is the place before character k
        step = end - first[unit]
        order = np.argsort(step, kind="stable")
        char, piece, end, step, unit = char[order], piece[order], end[order], step[order], unit[order]
        last = np.full(len(begins) + 1, -1, np.int64)  # the token that ends at a node
        last[first] = -2
        long_unit = lengths[unit] > TOGETHER
        self._relax_together(char[~long_unit], piece[~long_unit], end[~long_unit], step[~long_unit], last)
        if long_unit.any():
            self._relax_singly(char[long_unit], piece[long_unit], end[long_unit], unit[long_unit], last)
        return self._collect(first, lengths, last, raw, begins)

    def _long(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one unit, window by window of the places where edges start: an edge into a
        place starts before it, so what ends there is known when its own window comes."""
        v, n = self.v, len(unit)
        reach = int(v.chars.max())
        last = np.full(n + 1, -1, np.int32)
        last[0] = -2
        for at in range(0, n, WINDOW):
            data = np.frombuffer(unit[at:at + WINDOW + reach].replace(" ", SPACE).encode(), np.uint8)
            begins = np.flatnonzero((data & 0xC0) != 0x80)[:WINDOW]
            char, piece = self._edges(data, begins)
            single = np.zeros(len(begins), bool)
            single[char[v.chars[piece] == 1]] = True
            lone = np.flatnonzero(~single)
            char = np.concatenate([char, lone]) + at
            piece = np.concatenate([piece, np.full(len(lone), v.unknown)])
            self._relax_singly(char, piece, char + v.chars[piece], np.zeros(len(char), np.int8), last)
        ids, node = array("i"), n
        while node:
            token = int(last[node])
            if token < 0:
                raise AssertionError("every place of a unit has a last token")
            node -= int(v.chars[token])
            if token == v.unknown:  # a character outside the vocabulary becomes its bytes
                ids.extend(v.byte_id[x] for x in reversed(unit[node].replace(" ", SPACE).encode()))
            else:
                ids.append(token)
        return np.frombuffer(ids, np.int32)[::-1], np.array([len(ids)], np.int64)

    def _relax_together(self, char, piece, end, step, last) -> None:
        bounds = np.searchsorted(step, np.arange(1, TOGETHER + 2))
        base = self.v.size + 1
        for k in range(TOGETHER):
            lo, hi = bounds[k], bounds[k + 1]
            if lo == hi:
                continue
            before = last[char[lo:hi]]
            key = before * base + piece[lo:hi]
            ok = before == -2
            check = np.flatnonzero(before >= 0)
            if len(check):
                distinct, back = np.unique(key[check], return_inverse=True)
                ok[check] = self._pairs(distinct)[back]
            last[end[lo:hi][ok]] = piece[lo:hi][ok]

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        if len(self.pairs) > PAIR_CACHE:
            self.pairs.clear()
        known, base, out = self.pairs, self.v.size + 1, np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            r = known.get(k)
            if r is None:
                r = known[k] = self.v.compatible(*divmod(k, base))
            out[i] = r
        return out

    def _relax_singly(self, char, piece, end, unit, last) -> None:
        order = np.lexsort((end, unit))
        known, base = self.pairs, self.v.size + 1
        now = {}  # nodes of the units at hand
        for c, p, e in zip(char[order].tolist(), piece[order].tolist(), end[order].tolist()):
            before = now.get(c)
            if before is None:
                before = int(last[c])
                if before == -1:
                    continue
            if before >= 0:
                k = before * base + p
                r = known.get(k)
                if r is None:
                    r = known[k] = self.v.compatible(before, p)
                if not r:
                    continue
            now[e] = p
            last[e] = p
            if len(now) > 1_000:
                now.clear()

    def _collect(self, first, lengths, last, raw, begins) -> tuple[np.ndarray, np.ndarray]:
        """Walk back from the units' ends, all units at once."""
        v = self.v
        units = np.arange(len(first))
        node = first + lengths
        rows, ids, chars, step = [], [], [], 0
        while len(units):
            token = last[node]
            if (token < 0).any():
                raise AssertionError("every place of a unit has a last token")
            node = node - v.chars[token]
            rows.append(units)
            ids.append(token)
            chars.append(node)
            more = node > first[units]
            units, node = units[more], node[more]
            step += 1
        unit = np.concatenate(rows)
        token = np.concatenate(ids)
        where = np.concatenate(chars)
        order = np.argsort(where, kind="stable")  # units stand in order of their characters
        unit, token, where = unit[order], token[order], where[order]
        lone = np.flatnonzero(token == v.unknown)
        if len(lone):  # a character outside the vocabulary becomes its bytes
            stop = np.append(begins, len(raw))
            width = np.ones(len(token), np.int64)
            width[lone] = stop[where[lone] + 1] - stop[where[lone]]
            ends = np.cumsum(width)
            unit, wide = np.repeat(unit, width), np.repeat(token, width)
            for i, e in zip(lone.tolist(), ends[lone].tolist()):
                a, b = stop[where[i]], stop[where[i] + 1]
                wide[e - (b - a):e] = [v.byte_id[x] for x in raw[a:b]]
            token = wide
        return token, np.bincount(unit, minlength=len(first))


def decode_ids(out: list[bytes], ids: list[int]) -> str:
    """Text of a list of ids; ``out``: bytes by id."""
    text = b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``."""
    prepare(docs.sparkSession)
    vocabulary = vocabulary or load_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        keys, texts, chars = [], [], 0

        def flush() -> pa.RecordBatch:
            ids, offsets = encoder.encode(texts)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

        for batch in batches:
            keys.append(batch.column(0))
            more = batch.column(1).to_pylist()
            texts += more
            chars += sum(map(len, filter(None, more)))
            if len(texts) >= PENDING_ROWS or chars >= PENDING_CHARS:
                yield flush()
                keys, texts, chars = [], [], 0
        if texts:
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of every row of ``encoded`` (key, ids)."""
    prepare(encoded.sparkSession)
    out = (vocabulary or load_vocabulary()).out
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1):  # one list at a time: token lists are long
                values = ids.values
                texts.append(decode_ids(out, values.to_numpy().tolist()) if values is not None else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, "ids", "decoded"])

    return encoded.select(F.col(key), "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
