"""Command line: python -m promptlattice.cli {accuracy,latency,monitor} ... ; all run by the library's own calls. accuracy is offline unless URLs and keys are given; latency lists the matrix, and times it if
it is given a folder; monitor runs one cycle. Both take recorded streams in place of keys: a JSON object of [t_ms, line] lists by model/provider/size, or model/level."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import backends, latency
from .plans import config, latency_run, runner
from .sources import datasets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="promptlattice")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("accuracy", help="run and summarise a benchmark")
    a.add_argument("benchmark", choices=config.SETS)
    a.add_argument("path", help="the benchmark's rows")
    a.add_argument("--format", choices=("parquet", "json", "json-array"), default="parquet")
    a.add_argument("--settings", help="a YAML file")
    a.add_argument("--config", help="one configuration of the grid; all without it")
    a.add_argument("--limit", type=int)
    a.add_argument("--results", default="results")
    a.add_argument("--model-url", help="a chat-completions endpoint; offline without it")
    t = sub.add_parser("latency", help="list the latency matrix, or run it")
    t.add_argument("--runs", type=int, default=latency.RUNS)
    t.add_argument("--provider")
    t.add_argument("--model")
    t.add_argument("--size", choices=[s for s, _ in latency.SIZES])
    t.add_argument("--out", help="run it, and write calls and report to this folder")
    t.add_argument("--inputs", default="inputs.json", help="the cached texts")
    m = sub.add_parser("monitor", help="one cycle: a call of each model at the next level, appended to the log")
    m.add_argument("--state", default="state.json")
    m.add_argument("--log", default="log")
    m.add_argument("--text", default="Name one river.")
    for x in (t, m):
        x.add_argument("--replay", help="recorded streams instead of calls")
    return p


def _call(replay: str | None) -> backends.TimedCall:
    if replay is None:
        return backends.HttpStream(latency_run.present_keys())
    with open(replay) as f:
        return backends.Replay({k: [(t, x) for t, x in lines] for k, lines in json.load(f).items()})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("promptlattice").config("spark.speculation", "false").getOrCreate()
    if args.what == "monitor":
        rows = latency_run.cycle(spark, args.state, args.log, _call(args.replay), args.text).collect()
        return "\n".join(f"{r['model']} {r['compression']} " + (f"ttft {r['time_to_first_token_ms']:.0f} ms" if r["success"] else f"failed: {r['error']}") for r in rows)
    if args.what == "latency" and args.out:
        call = _call(args.replay)
        keys = latency.KEYS if args.replay else tuple(k for k, v in latency_run.present_keys().items() if v)
        texts = latency_run.texts_for(args.inputs, call)
        summaries, _ = latency_run.run(spark, texts, call, args.out, keys, runs=args.runs, provider=args.provider, model=args.model, size=args.size)
        return latency.print_table(summaries.orderBy("model", "provider", "input_tokens"))
    if args.what == "latency":
        rows = latency.matrix(spark, runs=args.runs, provider=args.provider, model=args.model, size=args.size).select("model", "provider", "input_size", "run").collect()
        return "\n".join(" ".join(map(str, r)) for r in rows)
    settings = config.load_settings(args.benchmark, args.settings)
    settings = config.replace(settings, results=args.results)
    only = [args.config] if args.config else None
    if unknown := [n for n in only or [] if n not in settings.grid()]:
        raise SystemExit(f"no such configuration: {unknown[0]}")
    use = runner.Backends()
    names = only or list(settings.grid())
    if args.model_url:
        key = settings.keys.get("OPENAI_API_KEY")
        if not key:
            return "OPENAI_API_KEY is not set"
        if settings.compress_url:
            if stopped := config.missing_key(settings.grid(), names, settings.keys.get("COMPRESS_API_KEY")):
                return f"COMPRESS_API_KEY is not set, and needed for {', '.join(stopped)}"
            use.compressor = backends.HttpCompressor(settings.compress_url, settings.keys["COMPRESS_API_KEY"] or "")
        use.model = backends.HttpModel(args.model_url, key, settings.model)
        use.judge = backends.HttpJudge(backends.HttpModel(args.model_url, key, settings.judge, most=200), runner.rubric(args.benchmark))
    items = datasets.read_items(spark, args.benchmark, args.path, args.format)
    results = runner.run(items, settings, use, args.limit, only)
    return runner.reports(spark, results.where(F.col("config").isin(names)), settings, only)


if __name__ == "__main__":
    print(main())
