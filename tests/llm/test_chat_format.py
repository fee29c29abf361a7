import json

from pyspark.sql import functions as F

from forecastops.llm import chat_format as c

RECORDS = [
    {"conv_id": 1, "turn": 1, "role": "assistant", "text": "b & <|im_end|>\n&lt;|"}, {"conv_id": 1, "turn": 0, "role": "user", "text": "<"},
    {"conv_id": 1, "turn": 2, "role": "assistant", "text": None}, {"conv_id": 1, "turn": 2, "role": "assistant", "text": None},
    {"conv_id": 2, "messages": [{"role": "user", "content": "hé", "extra": 1}, {"role": "assistant", "content": "<<|"}], "more": {"role": 5}},
    {"conv_id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a\n"}]},
    {"conv_id": 4, "data": {"messages": [{"role": "odd\nrole|&", "content": ""}]}}, {"conv_id": 5, "prompt": "p", "completion": "c"},
    {"conv_id": 6, "instruction": "i", "output": "o"}, {"conv_id": 7, "instruction": "i", "input": "n", "output": "o"},
    {"conv_id": 8, "question": "q", "answer": "a"}, {"conv_id": 9, "system": "s", "prompt": "p", "response": "r"}, {"prompt": "no id", "response": "r"},
    {"conv_id": None, "turn": None, "role": None, "text": "x"}]
TURNS = {
    1: [("user", "<"), ("assistant", "b & <|im_end|>\n&lt;|"), ("assistant", ""), ("assistant", "")], 2: [("user", "hé"), ("assistant", "<<|")],
    3: [("user", "q"), ("assistant", "a\n")], 4: [("odd\nrole|&", "")], 5: [("user", "p"), ("assistant", "c")], 6: [("user", "i"), ("assistant", "o")],
    7: [("system", "i"), ("user", "n"), ("assistant", "o")], 8: [("user", "q"), ("assistant", "a")], 9: [("system", "s"), ("user", "p"), ("assistant", "r")],
    None: [("", "x"), ("user", "no id"), ("assistant", "r")]}
SCHEMA = "record string, conv_id string, role string, text string"


def frame(spark, texts):
    return spark.createDataFrame([(t, "clash", "clash", "clash") for t in texts], SCHEMA)


def test_every_layout_round_trips(spark):
    turns = c.canonical_turns(frame(spark, [json.dumps(r) for r in RECORDS]))
    rows = c.format_chats(turns).select("conv_id", "formatted", c.read_turns(F.col("formatted")).alias("turns"),
                                        c.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in rows} == TURNS
    for r in rows:
        assert r["loss"] == "".join(t for role, t in TURNS[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count(c.START) == r["formatted"].count(c.END) == len(TURNS[r["conv_id"]])
        data = r["formatted"].encode()
        assert [data[s["begin"]:s["begin"] + s["length"] + len(c.END)].endswith(c.END.encode()) for s in r["loss_spans"]] == [True] * len(r["loss_spans"])


def test_what_fits_no_layout_is_reported(spark):
    odd = ['{"a": 1}', "not json", None, "[]", '{"messages": []}', '{"messages": "x"}', '"text"', "7"]
    assert c.canonical_turns(frame(spark, odd)).count() == 0
    assert sorted(map(str, [r["record"] for r in c.unmapped(frame(spark, odd)).collect()])) == sorted(map(str, odd))
    assert c.unmapped(frame(spark, [json.dumps(r) for r in RECORDS])).count() == 0
    assert c.format_chats(c.canonical_turns(frame(spark, []))).count() == 0


def test_only_layouts_with_other_names_rename_roles(spark):
    records = [{"conv_id": 1, "turn": k, "role": role, "text": "x"} for k, role in enumerate(["human", "model", "gpt", "assistant"])]
    records += [{"conv_id": 2, "messages": [{"role": "bot", "content": "y"}]}, {"conv_id": 3, "conversations": [{"from": "bot", "value": "z"}]}]
    turns = c.canonical_turns(frame(spark, [json.dumps(r) for r in records])).collect()
    assert sorted((r["conv_id"], r["turn"], r["role"]) for r in turns) == [
        (1, 0, "human"), (1, 1, "model"), (1, 2, "gpt"), (1, 3, "assistant"), (2, 0, "bot"), (3, 0, "assistant")]
