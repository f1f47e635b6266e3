"""Accuracy, token savings, breakdowns and comparisons, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counts(correct: Column) -> list[Column]:
    """total, evaluated (those not null), correct and accuracy (0.0 where nothing was evaluated)."""
    right, evaluated = F.count_if(correct), F.count(correct)
    return [F.count("*").alias("total"), evaluated.alias("evaluated"), right.alias("correct"), T.safe_rate(right, evaluated).alias("accuracy")]


def accuracy(results: DataFrame, correct: str = "correct", *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*counts(F.col(correct)))


def breakdown(results: DataFrame, by: str, correct: str = "correct", name: str = "key", keep_blank: bool = False, least: int = 1, most: int | None = None) -> DataFrame:
    """(key, evaluated, correct, accuracy) of the evaluated rows by a column. Null and empty keys are left out unless keep_blank. No rows if there are
    fewer than least keys; with more than most, see listed_or_counted."""
    rows = results.where(F.col(correct).isNotNull())
    if not keep_blank:
        rows = rows.where(F.nullif(F.col(by).cast("string"), F.lit("")).isNotNull())
    right, n = F.count_if(F.col(correct)), F.count("*")
    groups = rows.groupBy(F.col(by).alias(name)).agg(n.alias("evaluated"), right.alias("correct"), T.safe_rate(right, n).alias("accuracy"))
    if least <= 1 and most is None:
        return groups
    size = groups.agg(F.count("*").alias("__keys"))  # of the groups, not the rows
    kept = groups.crossJoin(F.broadcast(size)).where(F.col("__keys") >= least)
    return (kept if most is None else kept.where(F.col("__keys") <= most)).drop("__keys")


def listed_or_counted(results: DataFrame, by: str, correct: str = "correct", most: int = 50) -> DataFrame:
    """(keys, key, evaluated, correct, accuracy): the breakdown if there are at most `most` keys, else one row with their number alone."""
    groups = breakdown(results, by, correct)
    size = groups.agg(F.count("*").alias("keys"))
    listed = groups.crossJoin(F.broadcast(size)).where(F.col("keys") <= most).select("keys", "key", "evaluated", "correct", "accuracy")
    only = size.where(F.col("keys") > most).select("keys", *(F.lit(None).cast(t).alias(c) for c, t in listed.dtypes[1:]))
    return listed.unionByName(only)


def grouped_accuracy(results: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    """(level, key, total, evaluated, correct, accuracy): the overall row and all breakdowns in one GROUPING SETS aggregation. Blank keys are left out of breakdowns alone."""
    d = results.select(F.col(correct).alias("__correct"), *(F.col(k).cast("string").alias(k) for k in keys))
    sets = d.groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys))
    gid = F.grouping_id()
    out = sets.agg(*counts(F.col("__correct")), gid.alias("__gid"))
    everything = (1 << len(keys)) - 1
    level, key = F.when(F.col("__gid") == everything, "overall"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        at = everything - (1 << (len(keys) - 1 - i))
        level, key = level.when(F.col("__gid") == at, k), F.when(F.col("__gid") == at, F.col(k)).otherwise(key)
    return out.select(level.alias("level"), key.alias("key"), "total", "evaluated", "correct", "accuracy").where("level = 'overall' or nullif(key, '') is not null")


def token_columns(before: Column, after: Column) -> list[Column]:
    """Sums over the rows with tokens, tokens saved, and the saving in per cent, null where nothing was saved."""
    original, compressed = F.sum(F.when(before.isNotNull(), before)), F.sum(F.when(before.isNotNull(), after))
    saved = original - compressed
    return [F.count(before).alias("compressed_rows"), original.alias("original_tokens"), compressed.alias("compressed_tokens"), saved.alias("tokens_saved"), F.when(saved > 0, saved / original * 100).alias("saved_pct")]


def token_totals(results: DataFrame, *by: str) -> DataFrame:
    """Savings over the rows that were compressed, those with original_tokens; no row where there are none."""
    rows = results.where(F.col("original_tokens").isNotNull())
    return rows.groupBy(*by).agg(*token_columns(F.col("original_tokens"), F.col("compressed_tokens"))).where("compressed_rows > 0")


def comparison(results: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for each configuration with results, with its place in the run: accuracy and savings side by side, in one aggregation."""
    each = results.groupBy("config").agg(*counts(F.col("correct")), *token_columns(F.col("original_tokens"), F.col("compressed_tokens")))
    return each.join(F.broadcast(grid.select("config", "ordinal")), "config")


def answerability(results: DataFrame, correct: str = "correct") -> DataFrame:
    """The breakdown by is_answerable, null counting as unanswerable; only if both kinds are there."""
    return breakdown(results.withColumn("is_answerable", F.coalesce("is_answerable", F.lit(False))), "is_answerable", correct, "is_answerable", keep_blank=True, least=2)


BREAKDOWNS = {"financebench": ("question_type", "question_reasoning"), "longbench_v2": ("domain", "difficulty", "length_category"), "squad_v2": ("title",), "coqa": ("source", "turn_number")}


def report(name: str, benchmark: str, results: DataFrame) -> str:
    """A configuration's summary as text. A handful of group rows comes to the driver; numbers are rounded here and nowhere before."""
    one = accuracy(results).first()
    if not one["total"]:
        return f"--- {name}: no results ---"
    lines = [f"== {name} ==", f"Questions: {one['total']}", f"Evaluated: {one['evaluated']}", f"Correct: {one['correct']}", f"Accuracy: {T.percent(one['accuracy'])}"]
    if benchmark == "longbench_v2":
        lines.append(f"Without a letter: {one['total'] - one['evaluated']}")
    if tokens := token_totals(results).first():
        lines += [f"Original tokens: {T.count(tokens['original_tokens'])}", f"Compressed tokens: {T.count(tokens['compressed_tokens'])}"]
        lines.append(f"Saved: {T.count(tokens['tokens_saved'])} ({tokens['saved_pct']:.1f}%)" if tokens["saved_pct"] is not None else "Saved: 0 (no effective compression)")
    if benchmark == "squad_v2" and (rows := answerability(results).orderBy(F.desc("is_answerable")).collect()):
        lines += ["By answerability:"] + [f"  {'answerable' if r['is_answerable'] else 'unanswerable'}: {r['correct']}/{r['evaluated']} ({T.percent(r['accuracy'])})" for r in rows]
    for by in BREAKDOWNS[benchmark]:
        if benchmark == "squad_v2":
            rows = listed_or_counted(results, by).orderBy("key").collect()
            if rows and rows[0]["key"] is None:
                lines.append(f"By {by}: {rows[0]['keys']} of them")
                continue
        else:
            several = benchmark == "coqa"
            rows = breakdown(results, by, keep_blank=several, least=2 if several else 1).orderBy("key").collect()
        if rows:
            lines += [f"By {by}:"] + [f"  {r['key']}: {r['correct']}/{r['evaluated']} ({T.percent(r['accuracy'])})" for r in rows]
    return "\n".join(lines)
