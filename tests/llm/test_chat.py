"""Operator 4: round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import chat

TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[END]", "<\\/s>", "[\\\\END]", "\\", "<", "[", "a é", "/s>"]), max_size=6).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_round_trip_is_identical(turns):
    formatted, back = chat.round_trip(turns)
    assert back == turns and chat.parse(formatted) == turns
    assert "".join(chat.unescape(formatted[a:b]) for a, b in chat.loss_spans(formatted)) == "".join(t for r, t in turns if r == "assistant")


def test_plain_texts_are_not_escaped():
    formatted, _ = chat.round_trip([("user", "hi"), ("assistant", "</s>"), ("user", "a < b")])
    assert formatted == "<s>[INST]user[/INST]hi[END][INST]assistant[/INST]<\\/s>[END][INST]user[/INST]a < b[END]</s>"


def test_query_columns(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (1, None, None, "[END]"), (None, 0, "user", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss")
    got = {r.conv_id: r for r in chat.digests(chat.conversations(frame)).collect()}
    assert set(got) == {1, 2, None} and got[1].n_turns == 3 and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\n[END]\nuser\n\nassistant\nyes\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, hashlib.sha256(b"yes").hexdigest())
    assert chat.digests(chat.conversations(frame.limit(0))).collect() == []
