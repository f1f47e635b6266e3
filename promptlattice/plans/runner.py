"""The accuracy run: items x configurations, less what is done, compressed, answered, graded and appended.

The plan is declarative up to the calls. Filters and the anti-join stand before them, since nothing is pushed through a call; each (memo key, configuration)
is compressed once and joined back; and the one action is the append, so no call runs twice. Summaries read the written table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import backends, grading, summary
from ..sources import datasets, sinks
from .config import RUBRICS, Settings, grid_frame, resolve_limit


@dataclass
class Backends:
    compressor: backends.Compressor = field(default_factory=backends.WordDropper)
    model: backends.Model = field(default_factory=backends.EchoModel)
    judge: backends.Judge = field(default_factory=backends.ContainsJudge)


def user_prompt(benchmark: str, context: Column) -> Column:
    if benchmark == "longbench_v2":
        return prompts.choice_prompt(context, F.col("question"), *(F.col(f"choice_{x}") for x in "ABCD"))
    if benchmark == "coqa":
        return prompts.story_prompt(context, F.col("prior"), F.col("question"))
    return prompts.qa_prompt(context, F.col("question"))


def first(items: DataFrame, limit: int | None) -> DataFrame:
    """The first items in order of ordinal; 0 is none, null is all."""
    return items if limit is None else items.orderBy("ordinal").limit(limit)


def within_budget(items: DataFrame, benchmark: str, system: str, most: int) -> DataFrame:
    """The items whose uncompressed prompt is within the budget of tokens. The filings' benchmark has no budget."""
    if benchmark == "financebench":
        return items
    return items.where(prompts.full_prompt_tokens(F.lit(system), user_prompt(benchmark, F.col("context"))) <= most)


def discarded(all_items: DataFrame, limited: DataFrame, kept: DataFrame, benchmark: str) -> int:
    """How many items the budget dropped; for conversations those that the limit dropped count too."""
    return (all_items if benchmark == "coqa" else limited).count() - kept.count()


def not_done(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (question_id, config) without those in results, whether these were right, wrong or failed."""
    return items.join(results.select("question_id", "config").where("question_id is not null").distinct(), ["question_id", "config"], "left_anti")


def compress_once(todo: DataFrame, backend: backends.Compressor, settings: Settings) -> DataFrame:
    """(memo_key, config) with compressed_text, tokens and error for each pair that todo's compressed configurations need, called once each."""
    need = todo.where("compressed").groupBy("memo_key", "config").agg(F.first("context").alias("text"), F.first("aggressiveness").alias("aggressiveness"), F.first("compressor").alias("compressor"))
    return backends.compress(need, backend, settings.attempts, settings.base_delay).select("memo_key", "config", "compressed_text", "original_tokens", "compressed_tokens", "error")


def plan_run(items: DataFrame, done: DataFrame, settings: Settings, use: Backends | None = None, limit: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The result rows that a run will append, as a plan."""
    from ..functions.text import ratio

    use = use or Backends()
    spark, benchmark = items.sparkSession, settings.benchmark
    kept = within_budget(first(items, resolve_limit(limit, settings)), benchmark, settings.system, settings.max_input_tokens)
    configs = grid_frame(spark, settings.grid(), only).withColumnRenamed("ordinal", "config_no")
    todo = not_done(kept.crossJoin(F.broadcast(configs)), done.where(F.col("benchmark") == benchmark))
    short = compress_once(todo, use.compressor, settings)
    ready = todo.join(short, ["memo_key", "config"], "left").withColumn("messages", prompts.messages(F.lit(settings.system), user_prompt(benchmark, F.coalesce("compressed_text", "context"))))
    answered = backends.answer(ready.drop("context", "compressed_text", "prior"), use.model, settings.attempts, settings.base_delay)
    graded = grading.grade_letters(answered) if benchmark == "longbench_v2" else grading.grade_verdicts(backends.judge(answered, use.judge, settings.attempts, settings.base_delay))
    full = graded.withColumns({"benchmark": F.lit(benchmark), "compression_ratio": F.when(F.col("original_tokens").isNotNull(), ratio(F.col("compressed_tokens"), F.col("original_tokens")))})
    wanted = spark.createDataFrame([], datasets.RESULT).schema
    return datasets.with_defaults(full, datasets.RESULT).select(*(F.col(f.name).cast(f.dataType) for f in wanted))


def run(items: DataFrame, settings: Settings, use: Backends | None = None, limit: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Runs what is not done yet, appends it, and returns all results of the benchmark as written. Run again, it appends nothing."""
    spark = items.sparkSession
    done = datasets.read_results(spark, settings.results)
    sinks.append_results(plan_run(items, done, settings, use, limit, only), settings.results)
    return datasets.read_results(spark, settings.results).where(F.col("benchmark") == settings.benchmark)


def reports(spark: SparkSession, results: DataFrame, settings: Settings, only: list[str] | None = None) -> str:
    """All configurations' summaries, and the comparison if there are several."""
    names = list(settings.grid()) if only is None else only
    texts = [summary.report(n, settings.benchmark, results.where(F.col("config") == n)) for n in names]
    if len(names) > 1:
        rows = summary.comparison(results, grid_frame(spark, settings.grid(), names)).orderBy("ordinal").collect()
        texts.append("\n".join(f"{r['config']:<24} {r['accuracy']:>7.1%} {r['correct']}/{r['evaluated']}" + (f" saved {r['saved_pct']:.1f}%" if r["saved_pct"] is not None else "") for r in rows))
    return "\n\n".join(texts)


def rubric(benchmark: str) -> str:
    return RUBRICS.get(benchmark, "")
