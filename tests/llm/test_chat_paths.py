"""Mappings are selected by the hash of field paths with their whole prefixes."""

import json

import pytest
from pyspark.sql import functions as F

from rayloom.llm import chat

TURNS = [("user", "q"), ("assistant", "a")]


def read(spark, records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    return {r.id: r for r in chat.from_records(spark.createDataFrame(rows, "id long, raw string"), "raw").collect()}


def test_nested_content_and_fields(spark):
    part = lambda *said: [{"type": "text", "text": s} for s in said]
    records = [
        {"messages": [{"role": "user", "content": part("q")}, {"role": "assistant", "content": part("a")}]},
        {"messages": [{"author": {"name": "x"}, "role": "user", "content": "q"}, {"author": {"name": "y"}, "role": "assistant", "content": "a"}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": part("a")}]},
        {"messages": [{"role": "user", "content": [*part("q"), {"image": 7}]}, {"role": "assistant", "content": "[1]"}]},
    ]
    got = read(spark, records)
    assert [[tuple(t) for t in got[i].turns] for i in range(4)] == [TURNS, TURNS, TURNS, [("user", 'q\n\n{"image":7}'), ("assistant", "[1]")]]
    assert len({got[i].fingerprint for i in range(4)}) == 3  # the last two mix strings and lists


def test_clashing_nested_names(spark):
    records = [
        {"meta": {"id": 1, "instruction": "no", "output": "no"}},
        {"data": {"messages": [{"role": "user", "content": "no"}]}},
        {"meta": {"x": 1, "prompt": "no"}, "completion": "no"},
        {"meta": {"x": 1, "prompt": "no"}, "question": "q", "answer": "a"},
        {"a b": {"c.d": [1.5, {"e": {}}]}, "question": "q", "answer": "a"},
    ]
    got = read(spark, records)
    assert [got[i].layout for i in range(5)] == [None, None, None, "question-answer", "question-answer"]


def test_tables_and_records_share_fingerprints(spark):
    df = spark.createDataFrame([], "turn long, role string, `a b` array<struct<x:int,y:array<string>>>, text string, conv_id long")
    raw = json.dumps({"conv_id": 1, "turn": 2, "role": "r", "text": "t", "a b": [{"x": 1, "y": ["s"]}]})
    told = spark.createDataFrame([(raw,)], "raw string").select(chat.fingerprint(F.col("raw")).alias("f"), chat.paths(F.col("raw")).alias("p")).first()
    assert told.p == chat.field_paths(df.schema) and told.f == chat.fingerprint_of(told.p)
    assert chat.turn_columns(df.schema) == ("conv_id", "turn", "role", "text") == chat.BY_FINGERPRINT[told.f]
    with pytest.raises(ValueError):
        chat.turn_columns(df.drop("turn").schema)
