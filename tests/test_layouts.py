"""Presets and converters from each layout, tokens of conversations, and training exports."""

import json

import pytest
from pyspark.sql import functions as F

from trainframe.functions import tokens
from trainframe.operators import presets
from trainframe.plans import export

CHAT = "messages array<struct<role:string,content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"


def said(*turns):
    return [{"role": r, "content": c, "tool_calls": calls, "tool_call_id": None} for r, c, calls in turns]


@pytest.fixture(scope="module")
def shapes(spark):
    make = spark.createDataFrame
    return {
        "qa": make([("ask", "tell"), ("", "x")], "q string, a string"),
        "alpaca": make([("do", "this", "done"), ("do", None, "done")], "instruction string, input string, output string"),
        "dpo": make([("p", "good", "bad"), ("p", "", "bad")], "prompt string, chosen string, rejected string"),
        "chat": make([(said(("system", "s", None), ("user", "u", None), ("assistant", "a", None)),), (None,)], CHAT),
        "sharegpt": make([([("human", "u"), ("gpt", "a")],)], "conversations array<struct<from:string,value:string>>"),
    }


EXPECT = {"qa": ("ask", "tell"), "dpo": ("p", "good"), "chat": ("u", "a"), "sharegpt": ("u", "a")}


def test_every_preset_from_every_shape(shapes):
    for name, (ask, tell) in EXPECT.items():
        df = shapes[name]
        assert [tuple(r) for r in presets.simple_qa(df).collect()] == [(ask, tell)]
        assert [tuple(r) for r in presets.alpaca(df).collect()] == [(ask, "", tell)]
        m = presets.openai_chat(df).collect()[0].messages
        assert (m[-2].role, m[-2].content, m[-1].role, m[-1].content) == ("user", ask, "assistant", tell)
        c = presets.sharegpt(df).collect()[0].conversations
        assert (c[-2]["from"], c[-2]["value"], c[-1]["from"], c[-1]["value"]) == ("human", ask, "gpt", tell)
    assert [r.question for r in presets.simple_qa(shapes["alpaca"]).collect()] == ["do\nthis", "do"]
    assert [tuple(r) for r in presets.dpo_pair(shapes["dpo"]).collect()] == [("p", "good", "bad")]


def test_options_and_errors(spark, shapes):
    m = presets.openai_chat(shapes["qa"], system_prompt="sys").collect()[0].messages
    assert [t.role for t in m] == ["system", "user", "assistant"]
    assert [t.content for t in presets.openai_chat(shapes["chat"], system_prompt="new").collect()[0].messages][0] == "s"
    assert presets.openai_chat(shapes["dpo"], "prompt", "rejected").collect()[0].messages[1].content == "bad"
    with pytest.raises(Exception, match="layout is not known"):
        presets.simple_qa(shapes["qa"], strict=True).collect()
    assert presets.simple_qa(spark.createDataFrame([(1,)], "n int")).count() == 0
    with pytest.raises(ValueError, match="no preset"):
        presets.get_preset("nope")
    with pytest.raises(ValueError):
        presets.openai_chat(shapes["qa"], "q", "nope")


def test_calls_become_turns_and_back(spark):
    calls = [{"id": "1", "function": {"name": "f", "arguments": '{"x": 1}'}}, {"id": "2", "function": {"name": "g", "arguments": "{}"}}]
    df = spark.createDataFrame([(said(("user", "u", None), ("assistant", "wait", calls), ("tool", "r1", None)),)], CHAT)
    c = presets.sharegpt(df).first().conversations
    assert [t["from"] for t in c] == ["human", "gpt", "function_call", "function_call", "observation"]
    assert json.loads(c[2]["value"])["name"] == "f"
    flow = [("human", "u"), ("function_call", '{"name": "f", "arguments": {"x": 1}}'), ("function_call", '{"name": "g"}'), ("observation", "r1"), ("observation", "r2"), ("gpt", "done"), ("function_call", "no json")]
    back = presets.sharegpt_to_messages(spark.createDataFrame([(flow,)], "conversations array<struct<from:string,value:string>>")).first().messages
    assert [m.role for m in back] == ["user", "assistant", "tool", "tool", "assistant", "assistant"]
    assert [k.id for k in back[1].tool_calls] == ["call_0", "call_1"] and [back[2].tool_call_id, back[3].tool_call_id] == ["call_0", "call_1"]
    assert json.loads(back[1].tool_calls[0].arguments) == {"x": 1} and back[5].tool_calls[0].id == "call_2"


def test_converters(spark):
    turns = said(("system", "s", None), ("user", "u1", None), ("assistant", "a1", None), ("user", "u2", None), ("assistant", "a2", None), ("user", "open", None))
    df = spark.createDataFrame([(turns, "i.png")], CHAT + ", images string")
    r = presets.to_llama_factory(df).first()
    assert (r.instruction, r.output, r.system, r.history) == ("u2", "a2", "s", [["u1", "a1"]])
    r = presets.to_swift_query_response(df).first()
    assert (r.query, r.response, r.history) == ("u2", "a2", [["u1", "a1"]])
    r = presets.to_llama_factory_vlm(df).first()
    assert (r.instruction, r.output, r.images) == ("open", "a2", ["i.png"])
    for name, f in presets.CONVERTERS.items():
        assert f(df).count() == 1, name
    assert len(presets.to_swift_messages(df, "x").first().messages) == 6
    batch = presets.to_openai_batch(df.select("messages"), "model", ["messages"]).first()
    assert (batch.custom_id, batch.method, batch.body.model) == ("request-0", "POST", "model")
    done = spark.createDataFrame([("a", (200, ([(("hey",),)], "m", (3,)))), ("b", (500, ([], "m", (0,))))], "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,model:string,usage:struct<total_tokens:int>>>")
    assert [(r.custom_id, r.content) for r in presets.from_openai_batch(done).collect()] == [("a", "hey")]


def test_formats_and_export(spark, shapes, tmp_path):
    kinds = {k: presets.detect_format(df.schema) for k, df in shapes.items()}
    assert kinds == {"qa": "simple_qa", "alpaca": "alpaca", "dpo": "dpo", "chat": "openai_chat", "sharegpt": "sharegpt"}
    assert not presets.check_compatibility(spark.range(1), "swift").valid
    assert presets.check_compatibility(shapes["dpo"], "axolotl").warnings
    for f in ("llama-factory", "swift", "axolotl"):
        names = export.export_for(shapes["chat"], f, str(tmp_path / f))
        assert all((tmp_path / f / n).exists() for n in names)
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, pred string")
    text = export.export_eval(df, "label", "pred", str(tmp_path / "eval"))
    assert "| accuracy | 0.6667 |" in text and (tmp_path / "eval" / "metrics.md").read_text() == text
    assert spark.read.json(str(tmp_path / "eval" / "bad_case")).count() == 1


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Don't stop, é1 漢字!"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.token_count for r in tokens.token_counter(df, ["text"]).collect()}
    assert got == {1: 8, 2: 0, 3: 0}
    assert [r.id for r in tokens.token_filter(df, ["text"], 8, 8).collect()] == [1]
    assert tokens.resolve_model("default") == "regex"
    chat = spark.createDataFrame([([("user", "a b"), ("gpt", "c"), ("odd", ""), ("odd", "d")],), (None,)], "messages array<struct<role:string,content:string>>")
    t = tokens.messages_token_counter(chat.where("messages is not null")).first().token_stats
    assert (t.total, t.user, t.assistant, t.other, t.turns, t.avg_turn) == (4, 2, 1, 1, 3, 1)
    assert tokens.messages_token_filter(chat, 4, 4, 3, 3).count() == 1 and tokens.messages_token_filter(chat, 5).count() == 0
    assert tokens.messages_token_stats(chat).first()["count"] == 1


def test_tokenizer_files(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("Hello, World",), (None,)], "text string")
    got = [r.n for r in df.coalesce(1).select(tokens.count_tokens(F.col("text"), public.path("byte_bpe_50k.json")).alias("n")).collect()]
    assert got == [3, 0]
