"""The latency matrix: combinations, folds of streamed responses, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import throughput

MODELS = (
    ("large-a", "openai", "gpt-5.4", None, "openai/gpt-5.4", "openai/gpt-5.4"),
    ("large-b", "anthropic", None, "claude-sonnet-4-6", "anthropic/claude-sonnet-4.6", "anthropic/claude-sonnet-4.6"),
    ("small-c", "google", None, None, "google/gemini-3.1-flash-lite-preview", "google/gemini-3.1-flash-lite-preview"),
)
PROVIDERS = (("native", "native", None), ("router", "router", None), ("gateway_none", "gateway", "none"), ("gateway_low", "gateway", "low"), ("gateway_high", "gateway", "high"))
SIZES = (("short", 200), ("medium", 2000), ("long", 10000))
RUNS = 3
#: Kinds of key a run may have. A native key is by vendor.
KEYS = ("openai", "anthropic", "router", "gateway")


def dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..plans.config import small_frame

    return (
        small_frame(spark, [(i, *m) for i, m in enumerate(MODELS)], "model_no int, model string, vendor string, openai_id string, anthropic_id string, router_id string, gateway_id string"),
        small_frame(spark, [(i, *p) for i, p in enumerate(PROVIDERS)], "provider_no int, provider string, kind string, compression string"),
        small_frame(spark, [(i, *s) for i, s in enumerate(SIZES)], "size_no int, input_size string, target_tokens int"),
    )


def valid(kind: Column, vendor: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """Whether a combination can run: there is no native Google client, and the others need their key."""
    native = F.lit(False)
    for v in ("openai", "anthropic"):
        native = native | ((vendor == v) & F.lit(v in keys))
    return F.when(kind == "native", native).when(kind == "router", F.lit("router" in keys)).when(kind == "gateway", F.lit("gateway" in keys)).otherwise(F.lit(False))


def matrix(spark: SparkSession, keys: tuple[str, ...] = KEYS, runs: int = RUNS, model: str | None = None, provider: str | None = None, size: str | None = None) -> DataFrame:
    """A row for each run of each valid combination, in the order of run_no. The dimensions are a few rows each, whatever the data."""
    models, providers, sizes = dimensions(spark)
    d = models.crossJoin(providers).where(valid(F.col("kind"), F.col("vendor"), keys)).crossJoin(sizes)
    for c, v in (("model", model), ("provider", provider), ("input_size", size)):
        if v is not None:
            d = d.where(F.col(c) == v)
    d = d.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))) if runs > 0 else d.withColumn("run", F.lit(1)).limit(0)
    return d.withColumn("model_field", F.when(F.col("kind") == "gateway", F.concat("gateway_id", F.lit("?compression="), "compression")).when(F.col("kind") == "router", F.col("router_id")).otherwise(F.coalesce("openai_id", "anthropic_id")))


def _payload(line: Column) -> Column:
    from ..functions.text import py_strip

    return F.when(F.startswith(line, F.lit("data: ")), py_strip(F.substring(line, F.lit(7), F.lit(2147483647))))


def openai_content(line: Column) -> tuple[Column, Column]:
    """(content, done) of a line in the chat-completions format. Bad JSON has no content."""
    data = _payload(line)
    delta = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    return F.nullif(F.try_element_at(delta["choices"], F.lit(1))["delta"]["content"], F.lit("")), F.coalesce(data == "[DONE]", F.lit(False))


def anthropic_content(line: Column) -> tuple[Column, Column]:
    """(content, done) of a line in the messages format: text deltas of content blocks, until the message stops."""
    data = F.from_json(_payload(line), "type string, delta struct<type:string,text:string>")
    text = F.when((data["type"] == "content_block_delta") & (data["delta"]["type"] == "text_delta"), F.nullif(data["delta"]["text"], F.lit("")))
    return text, F.coalesce(data["type"] == "message_stop", F.lit(False))


def fold(lines: DataFrame, totals: DataFrame | None = None, form: str = "openai", preview: bool = False) -> DataFrame:
    """Run metrics by run_id of lines (run_id, line_no, t_ms, line), in order of line_no, ties by time.

    Lines after the end mark do not count. The first line that is not empty sets the time to first byte, the first content that to first token. totals (run_id, status_code, total_ms, call_error)
    adds the calls' own outcome; a run of totals without lines has metrics too. Without totals the last line's time stands for the total. One shuffle by run."""
    content, done = (openai_content if form == "openai" else anthropic_content)(F.col("line"))
    seen = lines.where(F.nullif("line", F.lit("")).isNotNull()).select("run_id", "line_no", "t_ms", content.alias("content"), done.alias("done"))
    order = Window.partitionBy("run_id").orderBy("line_no", "t_ms")
    live = seen.withColumn("ended", F.coalesce(F.max(F.col("done").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    aggs = [
        F.min("t_ms").alias("time_to_first_byte_ms"), F.min(F.when(F.col("content").isNotNull(), F.col("t_ms"))).alias("time_to_first_token_ms"), F.max("t_ms").alias("last_ms"),
        F.count("content").cast("int").alias("chunks_received"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("int").alias("content_chars"),
    ]
    if preview:
        parts = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("line_no", "t_ms", "content"))))
        aggs.append(F.substring(F.array_join(F.transform(parts, lambda p: p["content"]), ""), 1, 100).alias("response_preview"))
    folded = live.groupBy("run_id").agg(*aggs)
    if totals is None:
        folded = folded.withColumns({"status_code": F.lit(200), "total_time_ms": F.col("last_ms"), "call_error": F.lit(None).cast("string")})
    else:
        folded = totals.withColumnRenamed("total_ms", "total_time_ms").join(folded, "run_id", "left").fillna(0, ["chunks_received", "content_chars"])
    bad = F.col("call_error").isNotNull()
    # a refused call has no total in the matrix; one that broke off has
    total = F.when(~F.startswith(F.coalesce("call_error", F.lit("")), F.lit("HTTP ")), F.col("total_time_ms"))
    rate = F.when(~bad, throughput(F.col("content_chars"), F.col("total_time_ms"), F.col("time_to_first_token_ms")))
    good = ~bad & F.col("time_to_first_token_ms").isNotNull()
    out = ["run_id", good.alias("success"), F.when(bad, F.col("call_error")).when(~good, "no content in stream").alias("error"), "status_code", "time_to_first_byte_ms", "time_to_first_token_ms"]
    out += [(F.col("total_time_ms") if preview else total).alias("total_time_ms"), "chunks_received", "content_chars", rate.alias("chars_per_sec")]
    return folded.select(*out, *(["response_preview"] if preview else []))


def combo_summary(runs: DataFrame, by: tuple[str, ...] = ("model", "provider", "input_size", "input_tokens")) -> DataFrame:
    """Means over successful runs, the exact median of the time to first token, counts, and the distinct errors of all runs, in order. Nothing is rounded."""
    ok = F.col("success")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return runs.groupBy(*by).agg(
        F.count_if(ok).alias("runs_ok"), F.count_if(~ok).alias("runs_failed"), mean("time_to_first_byte_ms").alias("ttfb_ms_avg"), mean("time_to_first_token_ms").alias("ttft_ms_avg"),
        F.median(F.when(ok, F.col("time_to_first_token_ms"))).alias("ttft_ms_med"), mean("total_time_ms").alias("total_ms_avg"), mean("chars_per_sec").alias("chars_per_sec_avg"),
        F.array_sort(F.collect_set(F.nullif("error", F.lit("")))).alias("errors"),
    )


def print_table(summaries: DataFrame) -> str:
    """The summary table as text."""
    from ..functions.text import whole

    rows = summaries.collect()
    head = f"{'model':<12} {'provider':<15} {'size':<8} {'ttft':>8} {'median':>8} {'total':>8} {'chars/s':>8} ok"
    return "\n".join([head] + [f"{r['model']:<12} {r['provider']:<15} {r['input_size']:<8} {whole(r['ttft_ms_avg']):>8} {whole(r['ttft_ms_med']):>8} {whole(r['total_ms_avg']):>8} {whole(r['chars_per_sec_avg']):>8} {r['runs_ok']}/{r['runs_ok'] + r['runs_failed']}" for r in rows])
