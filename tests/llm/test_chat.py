import json

from pyspark.sql import functions as F

from rayloom.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|>\n\\ [INST] <s> b"), (2, 5, "user", None), (2, 5, "assistant", ""), (2, None, None, "late"), (3, 0, "assistant", "x" * 50_000),
    (None, 0, "user", "nobody"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "\\|im_sep|> <\\|im_end|>\n😀"),
]


def conversations(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_mask(spark):
    df = conversations(spark).withColumns({c: F.lit(1) for c in ("e", "turns", "late")})
    out = chat.format_chats(chat.from_turn_rows(df)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m"))
    got = {r.conv_id: r for r in out.collect()}
    turns = {}
    for c, n, role, text in sorted(ROWS, key=lambda r: (r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.t] for c, r in got.items()} == turns
    assert {c: r.m for c, r in got.items()} == {c: "".join(x for role, x in some if role == "assistant") for c, some in turns.items()}
    assert all(r.formatted.count("<|im_end|>\n") == len(turns[c]) and "[INST]" not in r.formatted and "<s>" not in r.formatted for c, r in got.items())


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a", "id": 4}, {"question": "q", "answer": "a"}, {"unknown": 1}, None, "not json",
    ]
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    got = {r.id: r for r in chat.from_records(spark.createDataFrame(rows, "id long, raw string"), "raw").collect()}
    for i in range(6):
        assert [tuple(t) for t in got[i].turns] == [("user", "q"), ("assistant", "a")], records[i]
    assert all(got[i].turns is None for i in (6, 7, 8)) and len(got) == len(records)
    assert len({got[i].fingerprint for i in range(7)}) == 7


def test_columns_of_the_operator_are_replaced_and_others_stay(spark):
    raw = json.dumps({"prompt": "q", "completion": "a"})
    df = spark.createDataFrame([(raw, 1, "x"), (raw, 1, "x"), (None, 2, None)], "raw string, layout int, own string")
    got = chat.from_records(df, "raw").collect()
    assert sorted((r.own or "", r.layout or "") for r in got) == [("", ""), ("x", "prompt-completion"), ("x", "prompt-completion")]


def test_an_unknown_table_is_reported(spark):
    import pytest

    with pytest.raises(ValueError, match="no mapping"):
        chat.from_turn_rows(spark.createDataFrame([(1, "x")], "conv_id long, said string"))


def test_empty(spark):
    assert chat.format_chats(chat.from_turn_rows(conversations(spark, []))).count() == 0
