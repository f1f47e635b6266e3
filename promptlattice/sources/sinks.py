"""Where results go: an appended table by benchmark and configuration, JSON exports at the edge, and the monitor's log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasets import RUN_METRICS


def append_results(results: DataFrame, path: str) -> None:
    """Appends result rows, partitioned by benchmark and configuration: each job commits once and rewrites nothing."""
    results.write.mode("append").partitionBy("benchmark", "config").parquet(path)


def export_json_array(results: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One JSON array in one file, for tools that want it; rows stream through the driver partition by partition."""
    fields = {} if keep_nulls else {"ignoreNullFields": "true"}
    with open(path, "w") as f:
        f.write("[")
        for i, row in enumerate(results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **fields}).alias("j")).toLocalIterator()):
            f.write((",\n" if i else "\n") + row["j"])
        f.write("\n]\n")


def append_log(runs: DataFrame, path: str) -> None:
    """Appends monitor records as JSON lines, nulls included: a file for each write, so that a file stream sees them."""
    runs.write.mode("append").option("ignoreNullFields", False).json(path)


def nested_runs(runs: DataFrame, keys: tuple[str, ...] = ("model", "provider", "input_size", "input_tokens")) -> DataFrame:
    """A row for each combination with its runs, in order of run, as an array of structs."""
    metrics = [c.strip().split(" ")[0] for c in RUN_METRICS.split(",")]
    packed = F.array_sort(F.collect_list(F.struct(F.col("run"), *metrics)))
    return runs.groupBy(*keys).agg(F.transform(packed, lambda r: F.struct(*(r[m].alias(m) for m in metrics))).alias("runs"))


def export_matrix(summaries: DataFrame, runs: DataFrame, path: str) -> None:
    """The latency report file: summaries and raw runs in one JSON object. Both are one row a combination."""
    def rows(df: DataFrame) -> str:
        return ",\n".join(r["j"] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())

    with open(path, "w") as f:
        f.write('{"summaries": [' + rows(summaries) + '],\n"raw": [' + rows(nested_runs(runs)) + "]}\n")
