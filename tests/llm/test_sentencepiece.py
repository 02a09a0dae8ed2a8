"""Token ids against the library's own encoder; exact round trips."""

import random
import tracemalloc

import pytest
import sentencepiece

from docscope.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


EDGES = ["", " ", "  ", "a", " a ", "▁a", "\n", "\x00", "         x", " " * 40, " " * 15 + "a", "x" * 3000,
         "hello world, this is a test  of   spaces", "<s>a</s><unk><0x41>", "漢字𠀀 é ﬁ", "a b",
         "the" * 500, "!" * 200, " \n \t "]


def samples():
    rng = random.Random(4)
    out = list(EDGES)
    for alphabet, n, size in (("aeiou tnsrl  \n\té漢字𠀀▁<>0x.THE!%ßñ", 300, 150), ("abcdethion", 150, 300),
                              ("thein ", 150, 200)):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(n)]
    return out


def test_ids_equal_the_library(vocabulary, library):
    texts = samples()
    ids, offsets = S.Encoder(vocabulary).encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode(t), repr(t)


def test_ids_do_not_depend_on_caches_and_index_size(vocabulary, library, monkeypatch):
    monkeypatch.setattr(S, "UNIT_CACHE", 20)
    monkeypatch.setattr(S, "PAIR_CACHE", 20)
    monkeypatch.setattr(S, "INDEX_BYTES", 50)
    monkeypatch.setattr(S, "TOGETHER", 4)
    encoder = S.Encoder(vocabulary)
    for t in samples()[::7]:
        ids, offsets = encoder.encode([t, None, t])
        assert ids[:offsets[1]].tolist() == library.encode(t) == ids[offsets[2]:].tolist()


@pytest.mark.parametrize("window", [3, 17, 100])
def test_long_units_by_windows(vocabulary, library, monkeypatch, window):
    monkeypatch.setattr(S, "WINDOW", window)
    monkeypatch.setattr(S, "CACHE_CHARS", 500)
    rng = random.Random(window)
    parts = ["the", "ing", "a", "é", "中", "0", "ss", "▁", "\U0001f600", "er", "ation", "----", "\x00"]
    texts = [*samples()[::5], "x" * 1_000, " " * 333 + "end",
             *("".join(rng.choice(parts) for _ in range(400)) for _ in range(5))]
    encoder = S.Encoder(vocabulary)
    for t in texts:
        ids, offsets = encoder.encode([t, "short", t])
        assert ids[:offsets[1]].tolist() == library.encode(t) == ids[offsets[2]:].tolist(), repr(t)


def test_memory_of_a_text_without_spaces(vocabulary):
    rng = random.Random(1)
    text = "".join(rng.choice(["the", "ing", "a", "0", "er", "ation"]) for _ in range(400_000))
    tracemalloc.start()
    ids, _ = S.Encoder(vocabulary).encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(vocabulary.out[i] for i in ids.tolist()).decode() == " " + text
    assert peak < 100 * len(text), peak


def test_round_trip_over_documents(spark, vocabulary, library):
    rows = [(i, t, 1) for i, t in enumerate(samples()[:60])] + [(1000, None, 2), (None, "null id", 3), (5, "again", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = S.decode(S.encode(df, vocabulary), vocabulary).collect()
    assert sorted((r.decoded, len(r.ids)) for r in out) == sorted(
        ((t or "").replace("▁", " "), len(library.encode(t or ""))) for _, t, _ in rows)


def test_empty_table(spark, vocabulary):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.decode(S.encode(df, vocabulary), vocabulary).count() == 0


def test_real_documents(spark, vocabulary, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in S.encode(df, vocabulary).collect()}
    for r in df.collect():
        assert got[r.doc_id] == library.encode(r.text)
