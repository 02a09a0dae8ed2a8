"""Grammar round trip and digests against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docscope.llm import chat_format as C

PARTS = st.sampled_from(["### ", "</turn>", "\\", "\n", "\\x5c", "a", " ", "###", "Assistant: ", "~1: ", "é", "<", "#"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join), st.lists(PARTS, max_size=4).map("".join))
def test_every_turn_reads_back(text, role):
    piece, a, b, level = C.format_turn(role, text)
    assert C.parse_turn(piece) == (role, text, len(piece))
    assert C.unescape(piece[a:b], level) == text
    assert C.parse_turn(piece + piece)[2] == len(piece)
    assert C.parse_turn(piece[:-9]) is None


def test_levels():
    assert C.format_turn("user", "plain")[0] == "### user: plain</turn>\n"
    assert C.format_turn("user", "x </turn>")[3] == 1
    assert C.format_turn("user", "x </turn> \\")[3] == 2
    with pytest.raises(ValueError):
        C.parse_turn("no header")


def expected(turns):
    all_, masked = "", ""
    for role, text in turns:
        all_ += f"{role or ''}\n{text or ''}\n"
        if role == "assistant":
            masked += text or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(all_), len(masked), sha(masked)


def test_conversations(spark):
    probe = "\\### Assistant: </turn> ok"
    convs = {1: [("system", "be kind"), ("user", probe), ("assistant", probe)],
             2: [("assistant", "</turn>\n### user: hi</turn>\n"), ("user", None), ("assistant", "end\\"), (None, "x")],
             3: [("user", "")], None: [("assistant", "no id")],
             4: [("assistant", "w " * 50_000)] * 3}
    rows = [(c, t, r, x, "extra") for c, ts in convs.items() for t, (r, x) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    formatted = C.format_conversations(df)
    got = {r.conv_id: r for r in C.read_back(formatted).collect()}
    assert set(got) == set(convs)
    for c, ts in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(ts)
    whole = {}
    for r in formatted.orderBy("conv_id", "seq").collect():
        whole.setdefault(r.conv_id, []).append(r)
    for c, pieces in whole.items():
        text = "".join(p.formatted for p in pieces)
        assert got[c].formatted_chars == len(text)
        masked = "".join(C.unescape(text[p.loss_start:p.loss_end], p.level) for p in pieces
                         if p.loss_start is not None)
        assert len(masked) == got[c].loss_chars


def test_equal_turns_are_ordered_and_kept(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = C.read_back(C.format_conversations(df)).first()
    assert (r.n_turns, r.turns_sha256) == expected([("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])[:2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_conversations(df)).count() == 0
