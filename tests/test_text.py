from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptlattice.functions import prompts
from promptlattice.functions import text as T
from promptlattice.operators import grading

LETTERS = {
    "A": "A", "(B)": "B", "the answer is because": "B", "Answer: Because": "B", "c) is the correct": "C", "foo\nD\nbar": "D", "foo\r\nD\r\nbar": "D", "B. yes": "B", "éA": None, "A x": "A",
    "the answer is C": "C", "none": None, "ERROR: LLM API failed after 2 retries: x": None, "I pick D": "D", "The correct answer is: (a)": "A", "Ответ B": "B", "A é": "A", "x A\u0085": "A", "1A": None, "A_": None,
    "A? the answer is B": "B", "x D\nB y": "D", "x D\r\nB\ry": "D", "x D\nB\u0085y": "D", "x D\r\nB\r\ny": "D", " B ": "B", "x D\n B": "D",
}


def column(spark, values, f, schema="x string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r["y"] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_answer_letters(spark):
    assert column(spark, LETTERS, T.answer_letter) == list(LETTERS.values())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ABCD abc().:\nisthewrncoE", max_size=40), min_size=1, max_size=30))
def test_letters_are_letters_that_stand_there(spark, values):
    for v, got in zip(values, column(spark, values, T.answer_letter)):
        assert got is None or got in "ABCD" and got in v.upper()


def test_strip_and_tokens(spark):
    assert column(spark, ["\n\t x  \n", "\x1cx\x1f", "", None, "a b"], T.py_strip) == ["x", "x", "", None, "a b"]
    assert column(spark, ["abc", "abcd", "", "a\U0001f600éx", None], T.estimate_tokens) == [0, 1, 0, 1, None]


def test_verdicts(spark):
    said = ["correct: yes", "INCORRECT", "**CORRECT**", "Correctness is low", "", None]
    assert column(spark, said, T.verdict) == [True, False, False, True, False, None]


def test_grades(spark):
    rows = spark.createDataFrame([(" b ", "(B)"), ("A", "zzz"), ("A", "B"), (None, "A")], "gold_answer string, model_answer string")
    got = grading.grade_letters(rows).collect()
    assert [(r["correct"], r["extracted_answer"]) for r in got] == [(True, "B"), (None, None), (False, "B"), (None, "A")]
    assert got[1]["explanation"].endswith("zzz")
    judged = grading.grade_verdicts(spark.createDataFrame([("CORRECT x",), ("ERROR: x",)], "explanation string")).collect()
    assert [r["correct"] for r in judged] == [True, None]


def test_ratio_throughput_rotation(spark):
    df = spark.createDataFrame([(0, 0), (100, 40)], "o int, c int")
    assert [r[0] for r in df.select(T.ratio(F.col("c"), F.col("o"))).collect()] == [1.0, 0.4]
    t = spark.createDataFrame([(5, 100.0, 50.0), (0, 100.0, 50.0), (5, 50.0, 50.0), (5, 50.0, None)], "c int, t double, f double")
    assert [r[0] for r in t.select(T.throughput(F.col("c"), F.col("t"), F.col("f"))).collect()] == [100.0, None, None, None]
    assert [r[0] for r in spark.range(4).select(T.rotation(["none", "low", "high"], F.col("id"))).collect()] == ["none", "low", "high", "none"]
    assert T.one_place(4.25) == 4.2 and T.percent(0.0625) == "6.2%" and T.whole(None) == "-" and T.count(1234) == "1,234"


def test_passages(spark):
    got = column(spark, [[" a ", None, "", "  ", "b"], [], None], prompts.join_passages, "x array<string>")
    assert got == [f"a{prompts.PASSAGES}{prompts.PASSAGES}b", "", None]


def test_prompts(spark):
    df = spark.createDataFrame([("S", "Q", []), ("S", "Q", [("x", "y")])], "s string, q string, p array<struct<q:string,a:string>>")
    got = [r[0] for r in df.select(prompts.story_prompt(F.col("s"), F.col("p"), F.col("q"))).collect()]
    assert got == ["Story:\nS\n\nCurrent question: Q", "Story:\nS\n\nConversation so far:\nQ1: x\nA1: y\n\nCurrent question: Q"]
    one = df.limit(1)
    assert one.select(prompts.choice_prompt(*(F.col(c) for c in "sq"), *(F.lit(x) for x in "wxyz"))).first()[0] == "Context:\nS\n\nQuestion: Q\n\nA) w\nB) x\nC) y\nD) z"
    gold = column(spark, [[], ["p", "q"]], lambda x: F.struct(prompts.gold_answer(x), prompts.is_answerable(x)), "x array<string>")
    assert [tuple(g) for g in gold] == [("UNANSWERABLE", False), ("p", True)]
    assert re.search(r"\[nonce:[0-9a-f]{8}\]\n\nS$", one.select(prompts.summary_request(F.col("s"))).first()[0])


def test_request_fields(spark):
    efforts = column(spark, ["gpt-5", "gpt-5-mini", "gpt-5.4", "o3", "claude"], prompts.reasoning_effort)
    assert efforts == ["minimal", "minimal", "none", "none", None]
    bodies = column(spark, ["openai", "google"], lambda v: prompts.request_body(F.lit("m"), F.lit("hi"), v, F.lit("none")))
    assert '"max_completion_tokens":2000' in bodies[0] and '"reasoning_effort":"none"' in bodies[0] and '"max_tokens":2000' in bodies[1] and "reasoning" not in bodies[1]
