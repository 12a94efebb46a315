"""Formatted conversations, read back and held against a plain formatter."""

import hashlib
import random
import re

import compare
import pytest
from pyspark.sql import functions as F

from gleanbox.llm import chat as C
from gleanbox.llm import queries

ROW = "conv_id long, turn long, role string, text string"


def plain_escape(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def plain_format(turns):
    """(formatted, loss ranges) of sorted turns (role, text)."""
    out, spans, last = "", [], None
    for role, text in turns:
        out += "<|more|>" if role == last else ("" if last is None else "<|end|>\n") + f"<|turn|>{plain_escape(role)}<|says|>"
        if role == "assistant":
            spans.append((len(out.encode()), len(plain_escape(text).encode())))
        out, last = out + plain_escape(text), role
    return out + "<|end|>\n", spans


def conversations(rows):
    every = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        every.setdefault(conv, []).append((role or "", text or ""))
    return every


def checked(spark, rows, df=None):
    records = C.format_conversations(spark.createDataFrame(rows, ROW) if df is None else df).cache()
    want = {conv: (turns, *plain_format(turns)) for conv, turns in conversations(rows).items()}
    got = {r["conv_id"]: (r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in records.collect()}
    assert got == {conv: (text, spans) for conv, (_, text, spans) in want.items()}
    read = records.select("conv_id", C.parse_turns(F.col("formatted")).alias("t"), C.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["t"]] for r in read} == {conv: turns for conv, (turns, _, _) in want.items()}
    assert {r["conv_id"]: r["l"] for r in read} == {conv: "".join(t for role, t in turns if role == "assistant") for conv, (turns, _, _) in want.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r["conv_id"]: tuple(r)[1:] for r in C.record_digests(records).collect()}
    for conv, (turns, text, _) in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert digests[conv] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned), len(text))
    return len(digests)


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_of_texts_full_of_marks(spark, seed):
    r = random.Random(seed)
    bits = ["<|", "|>", "<|turn|>", "<|says|>", "<|more|>", "<|end|>\n", "<|end|>", "<\\|", "<\\\\|", "<", "|", "\\", "\n", "", "é", "日本", "😀", "$1", "word "]
    text = lambda: r.choice([None, "".join(r.choice(bits) for _ in range(r.randrange(12)))])
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "<|says|>", "a<"]), text()) for c in range(40) for t in range(r.randrange(1, 9))]
    assert checked(spark, rows) == 40


def test_defined_cases(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, None, "user", "first"), (1, 0, "user", "a")]
    rows += [(None, 1, "assistant", "no id"), (None, 0, None, None), (2, 5, "assistant", None), (3, 0, "", ""), (4, 0, "user", "x" * 300_000), (4, 1, "assistant", "é<|" * 100_000)]
    clash = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as formatted", "2 as loss_spans", "3 as turns", "4 as row", "5 as blocks")
    assert checked(spark, rows, clash) == 5
    assert checked(spark, []) == 0


@pytest.mark.parametrize("n", [255, 256, 257, 512, 5000])
def test_long_conversations_merge_across_blocks(spark, n):
    r = random.Random(n)
    rows = [(1, k, r.choice(["user", "assistant"]), f"t{k}<|") for k in range(n)] + [(2, k, "assistant", f"é{k}") for k in range(n)]
    r.shuffle(rows)
    assert checked(spark, rows) == 2


def test_expressions_only(spark):
    plan = C.record_digests(C.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], ROW)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowToRow", "")


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_relational_chat(spark, sf)
    assert compare.differences(got, compare.connection(sf), queries.oracle_sql()["op13_relational_chat"]) == ""
    odd = "\\### Assistant: </turn> ok"
    own = got.filter("conv_id = -7").first()
    assert own["loss_chars"] == len(odd) and own["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
