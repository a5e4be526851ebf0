"""Layouts, reversible markup and digests of conversations."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, queries

hard_text = st.text(st.sampled_from("\\#</turn> :\nab###Ä😀"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(hard_text, hard_text), max_size=5))
def test_markup_round_trip(turns):
    parts = [chat.render(role, text) for role, text in turns]
    assert chat.read_back("".join(p[0] for p in parts)) == turns
    for (role, text), (markup, a, b) in zip(turns, parts):
        assert chat.unescape(markup[a:b]) == (text if role == "assistant" else "")


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "ok"}, "instruction", [("user", "do\n\nthis"), ("assistant", "ok")]),
        ({"output": "ok", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "ok")]),
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "completion": "c"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"messages": []}, "messages", []),
        ({"unknown": 1}, None, []),
        ([1, 2], None, []),
        (None, None, []),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.turns_of(record) == (layout, turns)


def test_fingerprint_ignores_order_and_values():
    a = {"id": 1, "messages": [{"role": "x", "content": "y"}]}
    b = {"messages": [{"content": "1", "role": "2"}, {"role": "", "content": ""}], "id": 9}
    assert chat.schema_fingerprint(a) == chat.schema_fingerprint(b) != chat.schema_fingerprint({"messages": [{"role": "x"}]})


def test_records(spark):
    told = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b ### c"}]})),
        (2, json.dumps({"prompt": "p", "completion": ""})),
        (3, "{broken"),
        (4, None),
        (5, json.dumps({"odd": 1})),
        (None, json.dumps({"question": "q", "answer": "a"})),
    ]
    got = chat.format_records(spark.createDataFrame(told, "id long, record string"), "id").collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.seq):
        by[r.id].append(r)
    assert [r.markup for r in by[1]] == ["### user: a </turn>\n", "### assistant: b \\### c </turn>\n"]
    assert by[2][1].loss_start == by[2][1].loss_end > 0
    assert all(by[k][0].layout is None and by[k][0].markup is None for k in (3, 4, 5)) and len(by[None]) == 2


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    return out


def test_query(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = r"\### Assistant: </turn> ok"
    want = brute([*table, (-7, 0, "user", hard), (-7, 1, "assistant", hard)])
    got = queries.op7_chat(spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


def test_nulls_ties_and_long_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", ":: ###"), (None, 1, "user", "no id")]
    rows += [(2, k, "assistant" if k % 2 else "user", "word " * (k % 50) + "\\") for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest_segments(chat.format_records(chat.row_records(frame), "conv_id", "turn"), "conv_id", "turn").collect()
    want = brute([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want
    none = spark.createDataFrame([], frame.schema)
    assert chat.digest_segments(chat.format_records(chat.row_records(none), "conv_id", "turn"), "conv_id", "turn").count() == 0
