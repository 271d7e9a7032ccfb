import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat_format as C

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "share", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r"}, "response", [("user", "p"), ("assistant", "r")]),
    ({"question": "p", "answer": "r"}, "question", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction_input", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"conv_id": 1, "turn": 0, "role": "tool", "text": "t"}, "turn_row", [("tool", "t")]),
    ({"else": 1}, None, None),
    # Further fields, at any depth, don't matter; neither do names that look like types.
    ({"id": 1, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "ok", "weight": 0.5}]}, "messages", [("user", "hi"), ("assistant", "ok")]),
    ({"meta": {"a": {"b": {"c": {"d": {"e": [[{"f": 1}]]}}}}}, "ARRAY<": {"x>y [": 1, "b`t: ": []}, "prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"messages": []}, "messages", []),
    ({"messages": [None]}, "messages", [("", "")]),
    ({"messages": "none"}, None, None),
    ({"messages": [1, "a"]}, None, None),
    ({"x": {"prompt": "p", "response": "r"}}, None, None),
    ({}, None, None),
]


def test_layouts(spark):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "no json"), (100, None)], "i int, record string")
    found = {r.row.i: r for r in C.canonical(rows).collect()}
    assert len(found) == len(RECORDS) + 2
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert found[i].layout == layout, found[i]
        assert (found[i].turns if found[i].turns is None else [(t.role, t.text) for t in found[i].turns]) == turns
        assert found[i].reason == (None if layout else "no mapping")
    assert found[99].reason == "not JSON" and found[100].reason == "no record" and found[100].turns is None


def test_layouts_of_tables(spark):
    """A table's layout follows from its schema, as a record's from its own paths; other columns stay as they are."""
    schema = "layout string, turns int, fingerprint string, messages array<struct<content:string,role:string,name:string>>"
    row = C.canonical_rows(spark.createDataFrame([("l", 7, "f", [("hi", "human", "n"), (None, None, "n")]), ("l", 8, "f", None)], schema)).collect()
    assert [(t.role, t.text) for t in row[0].turns] == [("user", "hi"), ("", "")] and row[0].layout == "messages" and row[0].reason is None
    assert row[0].row.turns == 7 and row[0].row.layout == "l" and row[1].turns is None and row[1].reason == "not turns"
    assert row[0].fingerprint == C.canonical(spark.createDataFrame([(json.dumps({"layout": "", "turns": 1, "fingerprint": "", "messages": [{"content": "a", "role": "b", "name": "c"}]}),)], "record string")).first().fingerprint
    plain = C.canonical_rows(spark.createDataFrame([(1,)], "x int")).first()
    assert plain.layout is None and plain.reason == "no mapping" and plain.row.x == 1
    nested = C.canonical_rows(spark.createDataFrame([((("p",), 2),)], "a struct<`b c`:struct<q:string>,n:int>"), (C.Layout("own", fields=(("user", "$.a.`b c`.q"),)),)).first()
    assert [(t.role, t.text) for t in nested.turns] == [("user", "p")]


def test_long_turns_and_talks(spark):
    """A text of 20 MB, and a talk of 1,500 turns, come back whole."""
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("<|im_end|> é"), 1_700_000).alias("text"))
    rows = rows.union(spark.range(1500).select(F.lit(2).cast("long"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant"), F.concat(F.lit("😀 turn "), "id")))
    done = C.format_turn_rows(rows).select("conv_id", C.read_back(F.col("formatted")).alias("t"), "loss_spans", F.col("formatted"))
    long = done.where("conv_id = 1").select(F.size("t"), F.sha2(F.col("t")[0]["text"].cast("binary"), 256).alias("sha")).first()
    assert long[0] == 1 and long.sha == hashlib.sha256(("<|im_end|> é" * 1_700_000).encode()).hexdigest()
    many = done.where("conv_id = 2").first()
    assert [t.text for t in many.t] == [f"😀 turn {i}" for i in range(1500)]
    assert [many.formatted[s.start : s.start + s.length] for s in many.loss_spans] == [f"😀 turn {i}" for i in range(1, 1500, 2)]


def test_odd_table(spark, odd, none):
    rows = odd.select(F.col("doc_id").alias("conv_id"), F.length("text").cast("long").alias("turn"), F.col("lang").alias("role"), "text", "score", "row")
    found = C.format_turn_rows(rows).collect()
    assert {r.conv_id for r in found} == {r.conv_id for r in rows.collect()}
    texts = {r.conv_id: [t.text for t in r.t] for r in C.format_turn_rows(rows).select("conv_id", C.read_back(F.col("formatted")).alias("t")).collect()}
    assert texts[2] == [""] and texts[9] == ["one", "one"] and texts[4] == [" \t\n\x0b\x0c\r "]
    assert C.format_turn_rows(none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")).count() == 0


text = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", ">", "\n", "n", "é", "😀", "\r", "\x00"]), max_size=12).map("".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(text, text), min_size=1, max_size=4), min_size=30, max_size=40))
def test_round_trip(spark, talks):
    rows = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in talk]) for i, talk in enumerate(talks)], "i int, turns array<struct<role:string,text:string>>")
    formatted = rows.select("i", C.render(F.col("turns")).alias("f"))
    for r in formatted.select("i", "f", C.read_back(F.col("f")).alias("b")).collect():
        assert [(t.role, t.text) for t in r.b] == talks[r.i]
        for t, (_, said) in zip(r.b, talks[r.i]):
            assert re.sub(r"<\\(\\*)\|", r"<\1|", r.f[t.start : t.start + t.length]) == said
        assert r.f.count(C.START) == len(talks[r.i]) == r.f.count(C.END)


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 0, "assistant", "<|im_end|>"), (None, 0, "user", "x")]
    done = {r.conv_id: r for r in C.format_turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert done[1].formatted == "<|im_start|>user\na<|im_end|>\n" + 2 * "<|im_start|>assistant\nb<|im_end|>\n"
    assert [done[1].formatted[s.start : s.start + s.length] for s in done[1].loss_spans] == ["b", "b"]
    assert done[2].formatted.startswith("<|im_start|>\n<|im_end|>\n") and "<\\|im_end|>" in done[2].formatted
    assert None in done
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_turn_rows(empty).count() == 0


def test_fingerprint_is_of_paths(spark):
    rows = spark.createDataFrame([(x,) for x in ('{"a":{"b":[{"c":1}]}}', '{"a":{"b":[{"c":"x"},{"c":null}]}}', '{"a":{"b":[{"d":1}]}}')], "record string")
    one, same, other = (r.fingerprint for r in C.canonical(rows).collect())
    assert one == same == hashlib.sha256(b"$.a\n$.a.b\n$.a.b[]\n$.a.b[].c").hexdigest() != other


@pytest.mark.parametrize("said", ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<<|"])
def test_no_marker_survives(spark, said):
    row = spark.createDataFrame([(said,)], "t string").select(C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).first()
    assert "<|" not in row.e and row.u == said
