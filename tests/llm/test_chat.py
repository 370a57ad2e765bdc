from __future__ import annotations

import oracle
from pyspark.sql import functions as F

from pairloom.llm import chat, registry

TURNS = "array<struct<role:string,text:string>>"


def formed(spark, pairs):
    rows = spark.createDataFrame([(k, a, b, "x") for k, (a, b) in enumerate(pairs)], f"id int, chosen {TURNS}, rejected {TURNS}, prompt string")
    return {r.id: r.preference for r in chat.format_preferences(rows).collect()}


def test_whole_table(spark):
    assert oracle.differences(registry.op7_chat, registry.oracle_sql()["op7_chat"], spark) == ""


def test_prefix_masks_and_odd_turns(spark):
    u, a, b = ("user", "hi"), ("assistant", "good"), ("assistant", "bad")
    got = formed(spark, [([u, a], [u, b]), ([u, a], [u, a]), ([u], [u, a]), ([], None), ([("user", None)], [("user", None), a]), ([(None, "x<|end|>")], [a]), ([u, a, u, a], [u, a, u, b, u])])
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|user|>\nhi<|end|>\n"
    assert got[0].chosen == "<|assistant|>\ngood<|end|>\n" and got[0].rejected == "<|assistant|>\nbad<|end|>\n"
    for p in got.values():
        for text, spans in ((p.chosen, p.chosen_spans), (p.rejected, p.rejected_spans)):
            for s in spans:
                assert text[s.start : s.end].endswith("<|end|>\n") and text[: s.start].endswith("<|assistant|>\n")
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected, got[1].chosen_spans) == (2, "", "", [])
    assert got[2].n_prompt_turns == 1 and got[2].chosen == "" and got[2].rejected
    assert got[3].n_prompt_turns == 0 and got[3].prompt == got[3].chosen == got[3].rejected == ""
    assert got[4].n_prompt_turns == 1 and got[5].chosen == "<||>\nx< |end|><|end|>\n"
    assert got[6].n_prompt_turns == 3 and [(s.start, s.end) for s in got[6].rejected_spans] == [(14, 25)]


def test_long_repeated_and_empty(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", "é" * 1000) for k in range(300)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, None, None), (3, 1, "assistant", None)]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.conv_id: r.preference for r in chat.format_preferences(chat.last_reply_pairs(rows)).collect()}
    assert set(got) == {1, 2, 3, None} and got[1].n_prompt_turns == 299 and got[1].chosen and got[1].rejected == ""
    assert got[2].n_prompt_turns == 2 and got[3].n_prompt_turns == 0
    assert chat.last_reply_pairs(rows.limit(0)).count() == 0
    assert chat.conversations(rows).where(F.col("conv_id") == 1).select(F.size("turns")).first()[0] == 300


def test_running_sums_and_many_turns(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 7, 8, 9, 1000)], "a array<long>")
    for r in rows.select("a", chat._running(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[: k + 1]) for k in range(len(r.a))]
    turn = F.struct(F.lit("assistant").alias("role"), F.lit("abc").alias("text"))
    last = spark.range(1).select(F.element_at(chat.trained_spans(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda k: turn)), -1).alias("s")).first().s
    size = len("<|assistant|>\nabc<|end|>\n")
    assert (last.start, last.end) == (50_000 * size - len("abc<|end|>\n"), 50_000 * size)
