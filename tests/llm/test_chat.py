"""Chat formatting: layouts, fingerprints and the round trip of the template."""

import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglattice.llm import chat_formatting as chat

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}], "id": 4, "n`x.y": {"q": None}}, "messages", [("user", "a"), ("assistant", "bc")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "b"}]}], "system": "s"}, "message parts", [("system", "s"), ("user", "b")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "system": "s"}, "speakers", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"dialogue": [{"speaker": "guide", "text": "q"}]}, "dialogue", [("guide", "q")]),
    ({"prompt": "p", "completion": "c", "source": {"text": 1}}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": ""}, "response", [("system", ""), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"question": "q", "answer": 7}, "question", [("user", "q"), ("assistant", "7")]),
    ({"system_prompt": "s", "question": "q", "response": "r"}, "system prompt", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"request": {"messages": [{"role": "user", "content": "q"}]}, "response": {"content": "r"}}, "nested request", [("user", "q"), ("assistant", "r")]),
    ({"messages": []}, None, None),
    ({"prompt": "p"}, None, None),
    ([1, 2], None, None),
    ("text", None, None),
    ({}, None, None),
    (None, None, None),
]


def paths(value, at=""):
    """The leaves' paths, by recursion."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at} - {""}


def records(spark):
    rows = [(i, json.dumps(r), "own", 3) for i, (r, _, _) in enumerate(RECORDS)] + [(90, "{bad", "", 0), (91, None, "", 0)]
    return spark.createDataFrame(rows, "id int, body string, layout string, turns int").withColumn("record", F.try_parse_json("body"))


def test_layouts(spark):
    got = {r.id: r for r in chat.canonical(records(spark)).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout, i
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns, i
    assert got[90].layout is None and got[91].turns is None


def test_field_paths_and_fingerprints(spark):
    known = set(chat.known_paths(chat.LAYOUTS))
    shown = records(spark).where("id < 90").select("id", chat.field_paths(F.col("record")).alias("p"), chat.fingerprint(F.col("record")).alias("f"))
    for r in shown.collect():
        record = RECORDS[r.id][0]
        mixed = record and "messages" in record and any(isinstance(m["content"], list) for m in record["messages"]) and any(isinstance(m["content"], str) for m in record["messages"])
        if not mixed:  # unlike values under one name are one leaf for Spark
            assert set(r.p) == (paths(record) if isinstance(record, (dict, list)) else set())
            assert r.f == chat.hash_of(frozenset(paths(record) & known) if isinstance(record, dict) else frozenset())


def test_claims_of_two_layouts_are_refused(spark):
    twice = (*chat.LAYOUTS, chat.Layout("again", frozenset({"prompt", "response"}), (chat.One("user", ("prompt",)),)))
    with pytest.raises(ValueError, match="again"):
        chat.canonical(records(spark), layouts=twice)


def test_empty_table(spark):
    none = records(spark).limit(0)
    assert chat.formatted(chat.canonical(none)).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.canonical(chat.records_of_turns(rows)))).count() == 0


HARD = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "\n", " ", "$0", "a", "é", "🙂", " ###\n", "\n</turn>\n"]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x\\ ###\n", "###"]), HARD), max_size=5), min_size=1, max_size=30))
def test_template_is_reversible(spark, conversations):
    rows = [(i, turns) for i, turns in enumerate(conversations)]
    df = chat.formatted(spark.createDataFrame(rows, "i int, turns array<struct<role: string, text: string>>"))
    shown = df.select("i", "formatted", "loss", chat.read_back(F.col("formatted")).alias("back"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned"))
    for r in shown.collect():
        turns = conversations[r.i]
        assert [tuple(t) for t in r.back] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert len(re.findall("\n</turn>\n", r.formatted)) == len(turns)
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)


def test_rows_become_conversations(spark):
    rows = [
        (1, 2, "assistant", "long " * 50_000, "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "b", "x"), (1, 2, "assistant", "b", "x"),
        (None, 1, "user", "lone", "x"), (None, 1, "assistant", "lone too", "x"), (2, None, None, "🙂", "x"), (2, 0, "assistant", "", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = chat.digests(chat.formatted(chat.canonical(chat.records_of_turns(df)))).collect()

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    by = {(r.conv_id, r.turns_sha256): r for r in got}
    one = [("user", ""), ("assistant", "b"), ("assistant", "b"), ("assistant", "long " * 50_000)]
    assert len(got) == 4 and by[1, digest(one)].loss_chars == 250_002
    assert by[2, digest([("", "🙂"), ("assistant", "")])].n_turns == 2
    assert by[None, digest([("assistant", "lone too")])].loss_chars == 8 and by[None, digest([("user", "lone")])].loss_chars == 0


def test_plan_has_no_python(spark, folder):
    from loglattice.llm.registry import QUERIES

    plan = QUERIES["op11_chat_formatting"](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
