"""The latency run: the matrix's combinations become requests, these timed calls, and the calls' lines metrics, summaries and a report.

Calls happen once: their outcome is written before anything reads it twice. All of them run in one task, one after another, as calls side by side would slow each other.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import estimate_tokens
from ..operators import backends, latency
from ..sources import datasets, sinks
from ..streaming import monitor
from .config import small_frame

#: What the texts of each size are asked for with.
INPUT_PROMPTS = {
    "short": "In about a hundred words, tell how paper came to be made. One paragraph of plain prose.",
    "medium": "In about fifteen hundred words, tell how ships found their way at sea before there was radio. Plain prose without headings or lists.",
    "long": "In about seven and a half thousand words, tell how cities got clean water, from wells and aqueducts to treatment plants. Plain prose without headings or lists.",
}


CHAT = "/v1/chat/completions"


@dataclass(frozen=True)
class Endpoints:
    """Where each kind of key is good for."""

    openai: str = "https://api.openai.com" + CHAT
    anthropic: str = "https://api.anthropic.com" + "/v1/messages"
    router: str = "https://openrouter.ai/api" + CHAT
    gateway: str = field(default_factory=lambda: os.environ.get("GATEWAY_URL", ""))


def present_keys() -> dict[str, str | None]:
    return {kind: os.environ.get(name) for kind, name in backends.KEY_NAMES.items()}


def requests(combinations: DataFrame, texts: dict[str, str], endpoints: Endpoints = Endpoints(), most: int = 2000) -> DataFrame:
    """combinations with run_id in the order of the run, input_tokens, key_kind, url, key (what a recorded call is known by) and body. A size without a text has no requests."""
    spark = combinations.sparkSession
    sizes = small_frame(spark, list(texts.items()), "input_size string, input string")
    kind = F.when(F.col("kind") == "native", F.col("vendor")).otherwise(F.col("kind"))
    url = F.lit(None).cast("string")
    for k in backends.KEY_NAMES:
        url = F.when(F.col("key_kind") == k, F.lit(getattr(endpoints, k))).otherwise(url)
    body = lambda native: prompts.request_body(F.col("model_field"), prompts.summary_request(F.col("input")), F.col("vendor"), prompts.reasoning_effort(F.col("openai_id")), most, native)
    order = ((F.col("model_no") * 1000 + F.col("provider_no")) * 1000 + F.col("size_no")).cast("long") * 100_000 + F.col("run")
    d = combinations.join(F.broadcast(sizes), "input_size").withColumn("key_kind", kind).withColumn("url", url)
    d = d.withColumns({"run_id": order, "input_tokens": estimate_tokens(F.col("input")), "key": F.concat_ws("/", "model", "provider", "input_size"), "body": F.when(F.col("key_kind") == "anthropic", body(True)).otherwise(body(False))})
    return d.select("run_id", "model", "provider", "input_size", "input_tokens", "run", "key_kind", "key", "url", "body")


def folded(calls: DataFrame, preview: bool = False) -> DataFrame:
    """Metrics of calls as timed gives them, by run_id; the lines of the messages API in its own form."""
    lines = calls.select("run_id", "key_kind", F.posexplode("lines").alias("line_no", "l")).select("run_id", "key_kind", F.col("line_no").cast("long"), "l.t_ms", "l.line")
    native = F.col("key_kind") == "anthropic"
    one = lambda mine, form: latency.fold(lines.where(mine).drop("key_kind"), calls.where(mine).select("run_id", "status_code", "total_ms", "call_error"), form, preview)
    return one(~native, "openai").unionByName(one(native, "anthropic"))


def run(spark: SparkSession, texts: dict[str, str], call: backends.TimedCall, folder: str, keys: tuple[str, ...] = latency.KEYS, endpoints: Endpoints = Endpoints(), **chosen) -> tuple[DataFrame, DataFrame]:
    """(summaries, runs) of the matrix's combinations that have a key; chosen as for latency.matrix. The calls are written to folder/calls, the report to folder/report.json."""
    todo = requests(latency.matrix(spark, keys, **chosen), texts, endpoints).orderBy("run_id")
    backends.timed(todo, call).drop("body", "url").write.mode("overwrite").parquet(f"{folder}/calls")
    calls = spark.read.parquet(f"{folder}/calls")
    runs = calls.select("run_id", "model", "provider", "input_size", "input_tokens", "run").join(folded(calls), "run_id")
    summaries = latency.combo_summary(runs)
    sinks.export_matrix(summaries, runs, f"{folder}/report.json")
    return summaries, runs


def streamed_text(call: backends.TimedCall, prompt: str, url: str = Endpoints.openai, model: str = "gpt-5-mini", most: int = 16000) -> str:
    """The text that a streamed answer to prompt adds up to, on the driver; RuntimeError if the call fails. As generate of datasets.inputs it makes the run's texts, which are cached there."""
    asked = [{"content": prompt, "role": "user"}]
    body = {"stream": True, "model": model, "max_completion_tokens": most, "messages": asked}
    status, lines, _, error = call({"key": prompt, "key_kind": "openai", "url": url, "body": json.dumps(body)})
    if error or status != 200:
        raise RuntimeError(error or f"HTTP {status}")
    parts = []
    for _, line in lines:
        data = line[6:].strip() if line.startswith("data: ") else None
        if data == "[DONE]":
            break
        try:
            choices = json.loads(data).get("choices") if data else None
        except ValueError:
            continue
        if choices:
            parts.append((choices[0].get("delta") or {}).get("content") or "")
    return "".join(parts)


def texts_for(path: str, call: backends.TimedCall, prompts_by_size: dict[str, str] | None = None) -> dict[str, str]:
    """The texts of each size, from the cache or generated and cached."""
    return datasets.inputs(path, prompts_by_size or INPUT_PROMPTS, lambda p: streamed_text(call, p))


def cycle(spark: SparkSession, state: str, log: str, call: backends.TimedCall, text: str, endpoints: Endpoints = Endpoints(), now: Callable[[], str] = monitor.timestamp) -> DataFrame:
    """One cycle of the monitor: the next compression level, a call of each model through the gateway at that level, and a record each, appended to the log. Returns the records."""
    level = monitor.level_of(monitor.next_cycle(state))
    models = latency.matrix(spark, ("gateway",), 1, provider=f"gateway_{level}", size="short")
    # the monitor asks for the least effort that there is, whatever the model
    content = F.concat(F.lit(text), F.lit(" [nonce:"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8), F.lit("]"))
    body = prompts.request_body(F.col("model_field"), content, F.col("vendor"), F.lit("minimal"))
    todo = models.select(F.col("model_no").cast("long").alias("run_id"), "model", F.lit(level).alias("compression"), F.lit("gateway").alias("key_kind"), F.concat_ws("/", "model", F.lit(level)).alias("key"), F.lit(endpoints.gateway).alias("url"), body.alias("body"))
    called = backends.timed(todo.orderBy("run_id"), call).select("run_id", "model", "compression", "key_kind", "status_code", "lines", "total_ms", "call_error").collect()  # a row a model
    calls = spark.createDataFrame(called, "run_id long, model string, compression string, key_kind string, status_code int, lines array<struct<t_ms:double,line:string>>, total_ms double, call_error string")
    names = [c.split()[0] for c in datasets.LOG.split(", ")]
    records = calls.select("run_id", "model", "compression").join(folded(calls, preview=True), "run_id").withColumns({"timestamp": F.lit(now()), "chars_per_sec": F.round("chars_per_sec", 1)}).orderBy("run_id").select(*names)
    sinks.append_log(records.coalesce(1), log)
    return records
