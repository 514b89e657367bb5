import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from treegrain.llm.chat import escape, fold, format_conversations, parse, read_back, render, unescape
from treegrain.llm.queries import op4_chat_formatting

pieces = st.lists(st.sampled_from(["\\", "<turn", "</turn>", "\n", '"', ">", "a", "é", '<turn role="assistant">\n', "\n</turn>\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), max_size=5))
def test_any_text_and_role_come_back(turns):
    out = "".join(render(r, t)[0] for r, t in turns)
    assert parse(out) == turns
    for r, t in turns:
        s, a, b = render(r, t)
        assert unescape(s[a:b]) == t and unescape(escape(t)) == t


def test_query_against_brute_force(spark, small):
    rows = {r.conv_id: r for r in op4_chat_formatting(spark, small).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert rows.keys() == turns.keys()
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        r = rows[c]
        assert r.n_turns == len(ts) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in ts).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(render(a, t)[0]) for a, t in ts)


def test_events_fold_into_messages():
    events = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "delta", "assistant", "Hel"),
        (1, 1, 3, "delta", None, "lo"),
        (1, 2, 4, "message", "user", "old question"),
        (1, 2, 6, "message", "user", "new question"),
        (1, 1, 5, "regenerate", None, None),
        (1, 1, 7, "delta", "assistant", "Good "),
        (1, 1, 8, "delta", "assistant", "day"),
        (1, 3, 9, "message", "assistant", "typo"),
        (1, 3, 10, "edit", None, "fixed"),
        (1, 4, 11, "message", "user", "never mind"),
        (1, 4, 12, "delete", None, None),
        (2, 0, 1, None, "user", None),
    ]
    key = lambda e: (e[0], e[1], e[2])
    assert list(fold(sorted(events, key=key))) == [(1, 0, "user", "hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "new question"), (1, 3, "assistant", "fixed"), (2, 0, "user", "")]


def test_event_log_in_spark(spark):
    log = [(1, 0, 1, "delta", "assistant", "a"), (1, 0, 3, "delta", "assistant", "c"), (1, 0, 2, "delta", "assistant", "b"), (9, 0, 1, "message", "user", "x")]
    rows = format_conversations(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    assert {(r.conv_id, r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None) for r in rows} == {(1, "abc"), (9, None)}


def test_nulls_repeats_ties_and_empty(spark):
    shape = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(None, None, None, None, "clash"), (None, 1, "user", "x", None), (1, 0, "user", "b", None), (1, 0, "user", "b", None), (1, 0, "assistant", "a", None)]
    out = {r.conv_id: r for r in read_back(format_conversations(spark.createDataFrame(rows, shape))).collect()}
    assert out[None].n_turns == 2 and out[1].n_turns == 3 and out[1].loss_chars == 1
    assert out[1].turns_sha256 == hashlib.sha256(b"assistant\na\nuser\nb\nuser\nb\n").hexdigest()
    assert read_back(format_conversations(spark.createDataFrame([], shape))).count() == 0


def test_a_long_conversation_streams(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("CAST(1 AS LONG) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (r,) = read_back(format_conversations(rows)).collect()
    assert r.n_turns == n
    assert r.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, n, 2)).encode()).hexdigest()
