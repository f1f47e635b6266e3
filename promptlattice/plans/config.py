"""Settings, and the grid of compression configurations."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = ("financebench", "longbench_v2", "squad_v2", "coqa")
LEVELS = tuple(per_cent / 100 for per_cent in (5, 10, 30, 40, 50, 70))
GRID = "ordinal int, config string, compressed boolean, aggressiveness double, compressor string"

SYSTEM = {
    "financebench": "You analyse company filings. Use the given context alone, and state figures, currencies and percentages exactly.",
    "longbench_v2": "Pick the right choice from what the context says. Reply with its letter, A, B, C or D, and nothing more.",
    "squad_v2": 'Use the given context alone and reply with the shortest phrase that answers. If the context has no answer, reply "UNANSWERABLE".',
    "coqa": "Use the story and the conversation so far, and reply with the shortest phrase of the story that answers.",
}
#: Rules for judges, by benchmark.
RUBRICS = {
    "financebench": "Decide whether the answer agrees with the gold answer. Numbers may differ by rounding of up to two per cent, and in their unit or format. Begin with CORRECT or INCORRECT.",
    "squad_v2": "Decide whether the answer says what the gold answer says; wording may differ. If the gold answer is UNANSWERABLE, the answer must decline. Begin with CORRECT or INCORRECT.",
    "coqa": "Decide whether the answer says what the gold answer says; wording may differ, and yes or no must agree. Begin with CORRECT or INCORRECT.",
}


@dataclass(frozen=True)
class Settings:
    benchmark: str
    model: str = "answer-model"
    judge: str = "judge-model"
    compress_url: str = ""
    max_input_tokens: int = 272_000
    attempts: int = 2
    base_delay: float = 2.0
    compressors: tuple[str, ...] = ("compressor-2", "compressor-1")
    levels: tuple[float, ...] = LEVELS
    limit: int | None = 150
    system: str = ""
    results: str = "results"
    keys: dict[str, str | None] = field(default_factory=dict, repr=False)

    def grid(self) -> dict[str, dict]:
        return config_grid(self.compressors, self.levels)


def load_settings(benchmark: str, path: str | None = None, root: str = ".") -> Settings:
    """Defaults, then the file's shared section, then the benchmark's own, then the environment for the two model names. An unknown benchmark is a KeyError."""
    if path:
        import yaml

        raw = yaml.safe_load(Path(path).read_text())
        own = raw["sets"][benchmark]
        merged = {**raw.get("shared", {}), **own}
    elif benchmark in SETS:
        merged = {}
    else:
        raise KeyError(benchmark)
    known = {"model", "judge", "compress_url", "max_input_tokens", "attempts", "base_delay", "compressors", "levels", "limit", "system"}
    chosen = {k: tuple(v) if isinstance(v, list) else v for k, v in merged.items() if k in known}
    chosen.setdefault("system", SYSTEM.get(benchmark, ""))
    s = Settings(benchmark, results=os.path.join(root, "results"), **chosen)
    return replace(
        s, model=os.environ.get("OPENAI_MODEL", s.model), judge=os.environ.get("JUDGE_MODEL", s.judge), keys={k: os.environ.get(k) for k in ("OPENAI_API_KEY", "COMPRESS_API_KEY")}
    )


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as one constant of the plan: no Python worker, one partition."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("r")).select("r.*")


def config_grid(compressors, levels) -> dict[str, dict]:
    """control, then each compressor at each level, in order; names carry the level as Python prints it."""
    grid: dict[str, dict] = {"control": dict.fromkeys(("aggressiveness", "compressor")) | {"compressed": False}}
    for c in compressors:
        for level in levels:
            grid[f"{c}--{level}"] = {"compressed": True, "aggressiveness": level, "compressor": c}
    return grid


def grid_frame(spark: SparkSession, grid: dict[str, dict], only: list[str] | None = None) -> DataFrame:
    """The grid as rows, with each one's place in the run's order. An unknown name in only is a KeyError."""
    names = list(grid) if only is None else only
    place = {n: i for i, n in enumerate(grid)}
    rows = [(place[n], n, grid[n]["compressed"], None if grid[n]["aggressiveness"] is None else float(grid[n]["aggressiveness"]), grid[n]["compressor"]) for n in names]
    return small_frame(spark, rows, GRID)


def missing_key(grid: dict[str, dict], names: list[str], key: str | None) -> list[str]:
    """The compressed configurations among names that cannot run without a key."""
    return [] if key else [n for n in names if grid[n]["compressed"]]


def resolve_limit(given: int | None, settings: Settings) -> int | None:
    """The given limit, 0 included, else the settings'."""
    return settings.limit if given is None else given
