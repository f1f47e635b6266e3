"""The long-running monitor: rotating compression levels, an appended log, its statistics, and the log as a stream."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.datasets import LOG

LEVELS = ("none", "low", "high")


def next_cycle(path: str) -> int:
    """The cycle that a state file names, which moves on by one. A file that is missing or unreadable counts as cycle 0."""
    p, at = Path(path), 0
    try:
        at = int(json.loads(p.read_text()).get("cycle", 0))
    except (OSError, ValueError, AttributeError, TypeError):
        pass
    new = p.with_suffix(".new")
    new.write_text(json.dumps({"cycle": at + 1}))
    new.replace(p)
    return at


def level_of(cycle: int) -> str:
    return LEVELS[cycle % len(LEVELS)]


def timestamp() -> str:
    return datetime.now(timezone.utc).isoformat()


def quick_stats(log: DataFrame, success: Column | None = None, stamp: Column | None = None, order: Column | None = None) -> DataFrame:
    """(total, ok, failed, first, last): counts, and the minutes of the first and last record in the log's order, not the least and greatest."""
    success = F.col("success") if success is None else success
    stamp = F.col("timestamp") if stamp is None else stamp
    order = F.col("ordinal") if order is None else order
    ok = F.count_if(success)
    return log.agg(
        F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), F.substring(F.min_by(stamp, order), 1, 16).alias("first"), F.substring(F.max_by(stamp, order), 1, 16).alias("last")
    )


def stream_log(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """The log's folder as a stream. A file stream sees new files, not lines added to old ones: the log has one file a write."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", most_files).json(path).withColumn("at", F.to_timestamp("timestamp"))


def windowed_latency(log: DataFrame, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: runs, successes and mean time to first token by window, model and level; the same plan for a stream and for a table. On a stream rows later than `late` are dropped."""
    timed = log if "at" in log.columns else log.withColumn("at", F.to_timestamp("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    by = timed.groupBy(F.window("at", window).alias("w"), "model", "compression")
    return by.agg(F.count("*").alias("runs"), F.count_if("success").alias("ok"), F.avg(F.when(F.col("success"), F.col("time_to_first_token_ms"))).alias("ttft_ms_avg")).select(F.col("w.start").alias("start"), "model", "compression", "runs", "ok", "ttft_ms_avg")


def write_windows(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to a table, once for what is there; started again, it goes on where it stopped."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
