import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelweave.llm import chat, queries

HARD = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nno", "back\\slash \\<|turn|>", "", "a\\", "[[INST]]<<SYS>>\\\\", "é漢🎉<|end|>"]


def read(turns):
    rows = chat.read_back(chat.format_chat(turns)).collect()
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in rows}


def test_turn_rows_round_trip(spark):
    rows = [(1, i, ["user", "assistant", None, "odd\nrole"][i % 4], text, 7, 8) for i, text in enumerate(HARD)]
    rows += [(2, 1, "user", "b", 0, 0), (2, 1, "user", "a", 0, 0), (2, 1, "user", "a", 0, 0), (2, None, "assistant", None, 0, 0)]
    rows += [(None, 0, "assistant", "no id", 0, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout int, formatted int")
    found = read(chat.canonical_turns(df))
    assert found[1][0] == [(r[2] or "", r[3]) for r in rows[: len(HARD)]]
    assert found[1][1] == "".join(r[3] for r in rows[: len(HARD)] if r[2] == "assistant")
    assert found[2][0] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert found[None] == ([("assistant", "no id")], "no id")
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_layouts_by_schema(spark):
    messages = spark.createDataFrame(
        [(1, [("user", "q", 5), (None, None, 5)]), (2, None)],
        "conv_id long, messages array<struct<role:string,content:string,extra:int>>",
    )
    found = read(chat.canonical_turns(messages))
    assert found[1][0] == [("user", "q"), ("", "")] and found[2][0] == []
    shared = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert read(chat.canonical_turns(shared))[1] == ([("user", "q"), ("assistant", "a")], "a")
    single = spark.createDataFrame([(1, "do", "it", None)], "conv_id long, instruction string, input string, output string")
    assert read(chat.canonical_turns(single))[1][0] == [("user", "do\nit"), ("assistant", "")]
    nested = spark.createDataFrame([(1, ("p",), ("r",))], "conv_id long, request struct<prompt:string>, reply struct<text:string>")
    assert read(chat.canonical_turns(nested))[1][0] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_mixed_json_records(spark):
    records = [
        (1, json.dumps({"prompt": HARD[0], "response": HARD[1], "other": 1})),
        (2, json.dumps({"messages": [{"role": "user", "content": "x", "n": 1}, {"role": "assistant", "content": "y"}]})),
        (3, json.dumps({"conversations": [{"from": "gpt", "value": "v"}]})),
        (4, json.dumps({"instruction": "i", "input": "j", "output": "o"})),
        (5, json.dumps({"request": {"prompt": "p"}, "reply": {"text": "t"}})),
        (6, json.dumps({"unheard": "of"})),
        (7, "{broken"),
        (8, None),
        (8, json.dumps({"instruction": "i", "output": None})),
    ]
    df = spark.createDataFrame(records, "conv_id long, raw string")
    turns = chat.canonical_from_json(df, "conv_id", "raw").cache()
    layouts = sorted([(r["conv_id"], r["layout"]) for r in turns.collect()], key=repr)
    assert layouts == [
        (1, "prompt and response"), (2, "messages"), (3, "shared"), (4, "instruction with input"), (5, "nested prompt"),
        (6, None), (7, None), (8, "instruction"), (8, None),
    ]
    found = read(turns.where("layout is not null"))
    assert found[1] == ([("user", HARD[0]), ("assistant", HARD[1])], HARD[1])
    assert found[2][0] == [("user", "x"), ("assistant", "y")] and found[3] == ([("assistant", "v")], "v")
    assert found[4][0] == [("user", "i\nj"), ("assistant", "o")] and found[5][0][1] == ("assistant", "t")


def test_loss_spans_lie_on_assistant_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "né<|end|>"), (1, 1, "assistant", "\\[INST]é")], "conv_id long, turn long, role string, text string")
    row = chat.format_chat(chat.canonical_turns(df)).first()
    (span,) = row["loss_spans"]
    assert row["formatted"][span["start"] : span["start"] + span["length"]] == "\\\\[\\INST]é"


def test_query_digests(spark, tmp_path):
    rows = [(5, 0, "user", HARD[1]), (5, 1, "assistant", None), (5, 2, "assistant", HARD[2])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 5}
    spelled = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)
    assert out[5]["turns_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
    assert (out[5]["n_turns"], out[5]["loss_chars"]) == (3, len(HARD[2]))
    assert out[-1]["loss_sha256"] == hashlib.sha256(HARD[0].encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    plan = chat.read_back(chat.format_chat(chat.canonical_turns(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_json_messages_that_lack_a_field(spark):
    first = {"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"content": "lone"}, {"role": "assistant", "content": None}, "odd", {"role": "assistant", "content": "a"}]}
    shared = {"conversations": [{"value": "v"}, {"from": "gpt", "value": "w"}]}
    records = [(1, json.dumps(first)), (2, json.dumps(shared)), (3, json.dumps({"messages": [{"role": "user"}]})), (4, json.dumps({"messages": []})), (5, json.dumps({"messages": "text"}))]
    turns = chat.canonical_from_json(spark.createDataFrame(records, "conv_id long, raw string"), "conv_id", "raw")
    assert {r["conv_id"]: r["layout"] for r in turns.collect()} == {1: "messages", 2: "shared", 3: None, 4: None, 5: None}
    found = read(turns)
    assert found[1] == ([("system", ""), ("user", "q"), ("", "lone"), ("assistant", ""), ("", ""), ("assistant", "a")], "a")
    assert found[2] == ([("", "v"), ("assistant", "w")], "w") and found[3][0] == []
