from __future__ import annotations

import hashlib

from hypothesis import given, settings, strategies as st

from corvane.llm import chat_format as C

TEXT = st.text(alphabet="ab\\[]<>/sINST :|_TURN\n", max_size=30)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a:b]"]), TEXT | st.sampled_from(["</s>[INST] ok [/INST]", "<<SYS>>\n", "[TURN 3:x] y"])), max_size=6))
def test_round_trip(turns):
    text, spans, rewrote = C.incremental(turns, C.instruct)
    assert not rewrote and text == C.instruct(turns)
    assert [C.read_turn(text[s[0] : s[1]], text[s[2] : s[3]]) for s in spans] == turns
    for s, (_, said) in zip(spans, turns, strict=True):
        assert not C._CONTROL.search(text[s[2] : s[3]]) and C.unescape(text[s[2] : s[3]]) == said


def test_templates_that_rewrite_history_are_found():
    def only_last(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else ''}</{r}>" for i, (r, t) in enumerate(turns))

    _, spans, rewrote = C.incremental([("user", "a"), ("assistant", "b"), ("user", "c")], only_last)
    assert rewrote == [1, 2] and spans == [None, None, None]

    def trimmed(turns):
        return "".join(f"<{r}>{t.strip()}</{r}>" for r, t in turns)

    text, spans, rewrote = C.incremental([("user", " a "), ("assistant", "b")], trimmed)
    assert not rewrote and [text[s[2] : s[3]] for s in spans] == ["a", "b"]


def test_conversations_that_cannot_be_read_back_are_told(spark):
    def only_last(turns):
        return "".join(f"[INST] {t if i == len(turns) - 1 else ''} [/INST]" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.digests(C.formatted(df, only_last)).collect()}
    assert set(got) == {1, 2} and got[1].n_turns == 2 and got[1].turns_sha256 is None and got[1].loss_chars is None and got[1].formatted_chars > 0
    assert got[2].turns_sha256 == hashlib.sha256(b"user\nc\n").hexdigest()


def test_table(spark):
    rows = [(1, 1, "assistant", "two", "x", "y"), (1, 0, "user", "one", "x", "y"), (2, 0, None, None, "x", "y"), (3, 0, "user", "a", "x", "y"), (3, 0, "assistant", "b", "x", "y"), (3, 0, "assistant", "b", "x", "y"), (None, 0, "user", "n", "x", "y"), (4, None, "assistant", "c", "x", "y"), (4, 1, "assistant", "d" * 200_000, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, spans string")
    got = {r.conv_id: r for r in C.digests(C.formatted(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\none\nassistant\ntwo\n") and got[1].loss_sha256 == sha("two") and got[1].loss_chars == 3
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[3].turns_sha256 == sha("assistant\nb\nassistant\nb\nuser\na\n") and got[3].loss_chars == 2
    assert got[4].loss_sha256 == sha("c" + "d" * 200_000) and got[None].n_turns == 1
    empty = spark.createDataFrame([], df.schema)
    assert C.digests(C.formatted(empty)).collect() == []
