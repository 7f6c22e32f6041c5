from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.llm import chat_format as C

EVENTS = "conv_id long, seq long, kind string, message string, role string, text string, _conv string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "delta", "b", "assistant", "He"), (1, 2, "delta", "b", None, "llo"), (1, 3, "regenerate", "b", None, None), (1, 4, "delta", "b", None, "Good"), (1, 6, "delta", "b", None, " day"),
        (1, 5, "edit", "a", None, "hello"), (1, 7, None, "c", "user", None), (2, 0, "message", "a", None, "x"), (None, 0, "message", "z", "user", "lost"),
    ]
    got = {r.conv_id: r for r in C.read_back(C.format_chats(events(spark, rows))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hello"), ("assistant", "Good day"), ("user", "")]
    assert got[1].loss_text == "Good day" and got[2].turns[0].role == "" and got[None].turns[0].text == "lost"
    assert got[1].formatted == "<s>[INST]user[/INST]hello</s>[INST]assistant[/INST]Good day</s>[INST]user[/INST]</s>"


TEXT = st.text(alphabet=st.sampled_from("<s>[/INST]\\ é🎉a\n"), max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]", "</s>"]), TEXT), min_size=1, max_size=6), min_size=1, max_size=8))
def test_round_trip(spark, convs):
    rows = [(i, k, "message", str(k), role, text) for i, turns in enumerate(convs) for k, (role, text) in enumerate(turns)]
    for r in C.read_back(C.format_chats(events(spark, rows))).collect():
        turns = convs[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")


def test_ties_and_empty(spark):
    rows = [(1, 0, "message", "b", "user", "two"), (1, 0, "message", "a", "user", "one"), (1, 0, "message", "c", "user", "one")]
    got = C.read_back(C.format_chats(events(spark, rows))).first()
    assert [t.text for t in got.turns] == ["one", "one", "two"]
    assert C.digests(C.format_chats(events(spark, []))).collect() == []


def test_plan_is_native(spark):
    plan = C.digests(C.format_chats(events(spark, [])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F
