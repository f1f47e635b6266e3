"""Grades of answers: by letter, or by a judge's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_letter, py_strip, verdict


def grade_letters(df: DataFrame) -> DataFrame:
    """df (gold_answer, model_answer, ...) with extracted_answer, correct, which is null where no letter is found, and explanation. The letter is a column of its own
    first, so that the shapes are searched once a row."""
    letter, gold = F.col("extracted_answer"), F.upper(py_strip(F.col("gold_answer")))
    right = letter == gold
    said = F.concat(F.lit("Found '"), letter, F.lit("', gold '"), gold, F.lit("': "), F.when(right, "CORRECT").otherwise("INCORRECT"))
    none = F.concat(F.lit("No answer letter in: "), F.substring("model_answer", 1, 200))
    return df.withColumn("extracted_answer", answer_letter(F.col("model_answer"))).withColumns({"correct": right, "explanation": F.coalesce(said, none)})


def grade_verdicts(df: DataFrame) -> DataFrame:
    """df (explanation, ...) with correct; null where the judge failed."""
    return df.withColumn("correct", F.when(~F.startswith("explanation", F.lit("ERROR: ")), verdict(F.col("explanation"))))
