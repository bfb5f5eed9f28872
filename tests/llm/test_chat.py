"""Chat formatting: layouts, the exact round trip of any text, and the query against plain Python."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from trainframe.llm import chat

RECORDS = {
    1: ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, "messages", [("system", "s"), ("user", "u"), ("assistant", "a")]),
    2: ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "sharegpt", [("user", "u"), ("assistant", "a")]),
    3: ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\nx"), ("assistant", "o")]),
    4: ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    5: ({"prompt": "p", "response": "r", "system": "s"}, "prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    6: ({"prompt": "p", "completion": "c"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
    7: ({"prompt": "p", "chosen": "c", "rejected": "x"}, "preference", [("user", "p"), ("assistant", "c")]),
    8: ({"question": "q", "answer": "a", "id": 3}, "qa", [("user", "q"), ("assistant", "a")]),
    9: ({"qa": {"question": "q", "answer": "a"}}, "qa-nested", [("user", "q"), ("assistant", "a")]),
    10: ({"dialog": [{"speaker": "user", "text": "u"}, {"speaker": "bot", "text": None}]}, "dialog", [("user", "u"), ("assistant", "")]),
    11: ({"messages": []}, "messages", []),
    12: ({"unknown": 1}, None, None),
}


def test_layouts(spark):
    rows = [(k, json.dumps(r), "clash") for k, (r, _, _) in RECORDS.items()] + [(20, None, ""), (21, "no json", ""), (22, "[1]", "")]
    df = spark.createDataFrame(rows, "key long, record string, formatted string")
    got = {r.key: r for r in chat.format_chat(df, "key", "record").collect()}
    assert len(got) == len(rows)
    for k, (_, layout, said) in RECORDS.items():
        assert got[k].layout == layout
        if said is not None:
            assert chat.parse(got[k].formatted) == said and got[k].n_turns == len(said)
    assert all(got[k].formatted is None and got[k].layout is None for k in (20, 21, 22))
    # equal sets of paths have equal fingerprints, whatever the values and the order of keys
    assert got[3].fingerprint == got[4].fingerprint != got[5].fingerprint
    assert chat.fingerprint(chat.paths({"a": 1, "b": [{"c": 2}]})) == chat.fingerprint(chat.paths({"b": [{"c": "x"}, {"c": 0}], "a": 9}))


MARKS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[:]", "[/ROLE]", "\\", " ", "\n", "x", "é", "<", "[", "/"])
TEXT = st.lists(MARKS, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[:]", "</s>"]), TEXT | st.text(max_size=8)), max_size=6))
def test_round_trip(said):
    formatted, spans = chat.render(said)
    assert chat.parse(formatted) == said
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in said if r == "assistant"]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = {}
    for conv, said in convs.items():
        said.sort()
        turns = "".join(f"{r}\n{t}\n" for _, r, t in said)
        loss = "".join(t for _, r, t in said if r == "assistant")
        out[conv] = (len(said), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op1_chat_formatting(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert len({r.conv_id for r in got}) == len(got) and all(r.formatted_chars >= r.loss_chars for r in got)


def test_query(spark, tmp_path):
    rows = [(1, 2, "assistant", "a </s> b"), (1, 0, "system", None), (1, 1, "user", "[INST]\\"), (2, 0, "user", ""), (2, 1, "assistant", "é" * 100_000), (3, 0, None, "no role"), (4, 5, "assistant", "1"), (4, 6, "assistant", "2")]
    rows += [(5, k, ("user", "assistant")[k % 2], f"turn {k} \U0001f600") for k in range(500)]
    check(spark, tmp_path, rows)


def test_roles_stay_and_rows_repeat(spark, tmp_path):
    """Roles that are another layout's aliases keep their names, and repeated rows count each."""
    check(spark, tmp_path, [(1, 0, "human", "u"), (1, 1, "model", "m"), (1, 2, "gpt", "g"), (1, 3, "assistant", "a"), (1, 3, "assistant", "a"), (2, None, "user", "x"), (2, None, "user", "x"), (None, 1, "user", "nobody")])


def test_odd_json(spark):
    """Half a surrogate pair, nesting beyond the parser's depth, long numbers and mixed layouts end no job."""
    deep = "[" * 100_000 + "]" * 100_000
    rows = [
        (1, '{"prompt": "a\\ud83d", "response": "\\ud83d\\ude00"}'),
        (2, '{"prompt": "p", "response": %s}' % deep),
        (3, '{"prompt": "p", "response": %s}' % ("9" * 5000)),
        (4, '{"\\udc00": 1, "prompt": "p", "response": NaN}'),
        (5, '{"messages": [{"role": "human", "content": "m"}], "prompt": "p", "response": "r", "question": "q", "answer": "a"}'),
        (5, '{"messages": [{"role": "human", "content": "m"}]}'),
    ]
    got = [(r.key, r.layout, r.formatted and chat.parse(r.formatted)) for r in chat.format_chat(spark.createDataFrame(rows, "key long, record string"), "key", "record").collect()]
    assert sorted(got, key=str) == sorted([
        (1, "prompt-response", [("user", "a\ufffd"), ("assistant", "\U0001f600")]),
        (2, None, None),
        (3, None, None),
        (4, "prompt-response", [("user", "p"), ("assistant", "NaN")]),
        (5, "messages", [("user", "m")]),
        (5, "messages", [("user", "m")]),
    ], key=str)


def test_declared_fingerprints():
    """Each layout's records are found by the hash of their paths alone, whatever other fields they have."""
    table = chat.declared()
    for record, layout, _ in RECORDS.values():
        core = chat.paths(record) & set().union(*map(chat.named, chat.LAYOUTS))
        found = table.get(chat.fingerprint(core))
        assert (found and found.name) == layout


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])
