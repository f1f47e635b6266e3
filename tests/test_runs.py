from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from promptlattice import cli
from promptlattice.operators import backends, summary
from promptlattice.plans import config, runner
from promptlattice.sources import datasets, sinks


def settings_for(benchmark, tmp_path, **kw):
    base = {"compressors": ("c1",), "levels": (0.5,), "base_delay": 0.0, "limit": None, "system": "sys"}
    return config.Settings(benchmark, results=str(tmp_path / "results"), **(base | kw))


def squad(spark, n=6):
    rows = [(f"q{i}", f"t{i % 2}", f" the gold {i} stands here in this text ", f"what {i}?", ([f"gold {i}"] if i % 3 else [],)) for i in range(n)]
    return datasets.squad_items(datasets.with_ordinal(spark.createDataFrame(rows, datasets.SCHEMAS["squad_v2"]), ["id"]))


def test_grid(tmp_path):
    grid = config.config_grid(("a", "b"), config.LEVELS)
    assert len(grid) == 13 and next(iter(grid)) == "control" and "b--0.05" in grid
    with pytest.raises(KeyError):
        config.load_settings("nothing")
    f = tmp_path / "s.yaml"
    f.write_text("shared: {levels: [0.1], compressors: [x]}\nsets: {coqa: {limit: 7}}\n")
    s = config.load_settings("coqa", str(f))
    assert list(s.grid()) == ["control", "x--0.1"] and s.limit == 7
    assert config.resolve_limit(0, s) == 0 and config.resolve_limit(None, s) == 7
    assert config.missing_key(s.grid(), ["control", "x--0.1"], None) == ["x--0.1"]


def test_resume_appends_nothing_twice(spark, tmp_path):
    s = settings_for("squad_v2", tmp_path)
    got = runner.run(squad(spark), s)
    assert got.count() == 12
    assert runner.run(squad(spark), s).count() == 12
    one = {r["config"]: r for r in summary.accuracy(got, "correct", "config").collect()}
    assert one["control"]["accuracy"] == 1.0
    comparison = summary.comparison(got, config.grid_frame(spark, s.grid())).orderBy("ordinal").collect()
    assert [r["config"] for r in comparison] == ["control", "c1--0.5"]
    assert comparison[0]["original_tokens"] is None and comparison[1]["tokens_saved"] > 0
    assert "By answerability" in runner.reports(spark, got, s)


def test_failures_become_rows_and_count_as_done(spark, tmp_path):
    s = settings_for("squad_v2", tmp_path)
    use = runner.Backends(backends.WordDropper(fail_on=("gold 2",)), backends.EchoModel(fail_on=("q1",)))
    got = runner.run(squad(spark), s, use)
    bad = got.where("config = 'c1--0.5' and question_id = 'q2'").first()
    assert bad["original_tokens"] is None and "compression failed after 2 attempts" in bad["error"] and bad["correct"]
    wrong = got.where("config = 'control' and question_id = 'q1'").first()
    assert wrong["model_answer"].startswith("ERROR: ") and wrong["correct"] is False
    assert runner.run(squad(spark), s).count() == 12


def test_judge_failure_is_null(spark, tmp_path):
    class Broken:
        def __call__(self, q, g, a):
            raise ValueError("no")

    got = runner.run(squad(spark, 2), settings_for("squad_v2", tmp_path), runner.Backends(judge=backends.ContainsJudge() and Broken()), only=["control"])
    assert [r["correct"] for r in got.collect()] == [None, None]
    assert summary.accuracy(got).first()["accuracy"] == 0.0


def test_limit_before_budget(spark, tmp_path):
    rows = [(f"q{i}", "t", "x" * n, "?", (["a"],)) for i, n in enumerate((4000, 4, 4))]
    items = datasets.squad_items(datasets.with_ordinal(spark.createDataFrame(rows, datasets.SCHEMAS["squad_v2"]), ["id"]))
    first = runner.first(items, 2)
    kept = runner.within_budget(first, "squad_v2", "sys", 100)
    assert kept.count() == 1 and runner.discarded(items, first, kept, "squad_v2") == 1 and runner.discarded(items, first, kept, "coqa") == 2
    assert runner.first(items, 0).count() == 0 and runner.first(items, None).count() == 3
    edge = spark.createDataFrame([(4 * 20 - len("sys\nContext:\n\n\nQuestion: ?") + 3,), (4 * 20 - len("sys\nContext:\n\n\nQuestion: ?") + 4,)], "n int").select(F.repeat(F.lit("x"), F.col("n")).alias("context"), F.lit("?").alias("question"))
    assert runner.within_budget(edge, "squad_v2", "sys", 20 - 1).count() == 0 and runner.within_budget(edge, "squad_v2", "sys", 20).count() == 1


def test_conversations(spark, tmp_path):
    rows = [(" s ", None, ["q1", "q2", "q3"], (["a1", "a2", "a3"],)), ("t", "web", ["x"], ([],)), ("u", "web", [], ([],))]
    df = spark.createDataFrame(rows, datasets.SCHEMAS["coqa"]).coalesce(1)
    flat = datasets.flatten_conversations(datasets.with_ordinal(df)).orderBy("question_id").collect()
    assert [(r["question_id"], r["turn_number"], r["source"]) for r in flat] == [("0_0", 1, "unknown"), ("0_1", 2, "unknown"), ("0_2", 3, "unknown"), ("1_0", 1, "web")]
    assert [[tuple(p) for p in r["prior"]] for r in flat[:3]] == [[], [("q1", "a1")], [("q1", "a1"), ("q2", "a2")]]
    assert flat[3]["gold_answer"] is None and flat[0]["story"] == "s"
    calls = spark.sparkContext.accumulator(0)

    class Counting(backends.WordDropper):
        def __call__(self, text, level, model):
            calls.add(1)
            return super().__call__(text, level, model)

    s = settings_for("coqa", tmp_path)
    got = runner.run(datasets.coqa_items(datasets.with_ordinal(df)), s, runner.Backends(Counting()))
    assert got.count() == 8 and calls.value == 2
    assert runner.run(datasets.coqa_items(datasets.with_ordinal(df)), s).count() == 8


def test_other_sets(spark, tmp_path):
    fb = datasets.financebench_items(datasets.with_ordinal(spark.createDataFrame([(None, "q", "a", "t", None, [(" e1 ",), ("",), ("e2",)])], datasets.SCHEMAS["financebench"]), ["question"]))
    assert fb.first()["context"] == "e1\n\n---\n\ne2" and fb.first()["question_id"] == "0"
    got = runner.run(fb, settings_for("financebench", tmp_path, max_input_tokens=0))
    assert got.count() == 2
    lb = datasets.longbench_items(datasets.with_ordinal(spark.createDataFrame([("i", "q", "B", "c", "d", "s", "easy", "short", "w", "x", "y", "z")], datasets.SCHEMAS["longbench_v2"]), ["_id"]))
    s = settings_for("longbench_v2", tmp_path)
    got = runner.run(lb, s)
    assert [(r["extracted_answer"], r["correct"]) for r in got.collect()] == [("B", True)] * 2
    assert "By difficulty" in runner.reports(spark, got, s)


def test_summaries(spark):
    r = spark.createDataFrame([(True, 100, 60), (False, 50, 50), (None, None, None)], "correct boolean, original_tokens bigint, compressed_tokens bigint")
    a = summary.accuracy(r).first()
    assert tuple(a) == (3, 2, 1, 0.5)
    t = summary.token_totals(r).first()
    assert t["tokens_saved"] == 40 and abs(t["saved_pct"] - 26.6666666) < 1e-6
    same = spark.createDataFrame([(100, 100)], "original_tokens bigint, compressed_tokens bigint")
    assert summary.token_totals(same).first()["saved_pct"] is None
    assert summary.token_totals(same.where("false")).count() == 0
    titles = spark.range(51).select(F.lit(True).alias("correct"), F.col("id").cast("string").alias("title"))
    assert summary.listed_or_counted(titles.limit(50), "title").count() == 50
    assert [(x["keys"], x["key"]) for x in summary.listed_or_counted(titles, "title").collect()] == [(51, None)]
    one = spark.createDataFrame([(True, True, "s", None), (True, True, "s", "")], "correct boolean, is_answerable boolean, source string, kind string")
    assert summary.answerability(one).count() == 0 and summary.breakdown(one, "source", keep_blank=True, least=2).count() == 0 and summary.breakdown(one, "kind").count() == 0
    sets = summary.grouped_accuracy(one, ["source", "kind"]).collect()
    assert sorted((x["level"], x["key"]) for x in sets) == [("overall", None), ("source", "s")]


def test_results_io(spark, tmp_path):
    assert datasets.read_results(spark, str(tmp_path / "none")).count() == 0
    assert datasets.read_results_json(spark, str(tmp_path / "none.json")).count() == 0
    out = str(tmp_path / "r.json")
    rows = spark.createDataFrame([("q", True, None), ("r", None, 5)], "question_id string, correct boolean, original_tokens bigint")
    sinks.export_json_array(rows, out)
    assert "original_tokens" not in json.load(open(out))[0]
    back = datasets.read_results_json(spark, out).orderBy("question_id").collect()
    assert [(b["question_id"], b["correct"], b["original_tokens"]) for b in back] == [("q", True, None), ("r", None, 5)]


@pytest.mark.parametrize("keys", [[5, None, 10_000, -3, 7], [None], [], list(range(3000)), [-(2**63), 2**63 - 1, 0, None, -1], [(i * 0x9E3779B97F4A7C15 + 2**62) % 2**64 - 2**63 for i in range(3000)]])
def test_dense_ordinal(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    want = sorted(keys, key=lambda k: (k is not None, k or 0))
    got = datasets.dense_ordinal(df, "k", bucket=4).orderBy("ordinal").collect()
    assert [(r["k"], r["ordinal"]) for r in got] == [(k, i) for i, k in enumerate(want)]


STORIES = [(f"story {i}", "web", [f"q{i}a", f"q{i}b"], ([f"a{i}", "b"],)) for i in range(4)]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_ids_do_not_hang_on_files(spark, tmp_path, fmt):
    """The same rows in one file, in two and in four, and in files read by several tasks."""
    seen = []
    for files in (1, 2, 4):
        path = tmp_path / f"{fmt}{files}"
        for f in range(files):
            part = spark.createDataFrame(STORIES[f * 4 // files : (f + 1) * 4 // files], datasets.SCHEMAS["coqa"]).coalesce(1)
            getattr(part.write, fmt)(str(path / f"{f}"))
        for size in ("134217728", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            items = datasets.read_items(spark, "coqa", str(path / "*"), fmt)
            seen.append(sorted((r["question_id"], r["question"]) for r in items.collect()))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == [(f"{i}_{t}", f"q{i}{'ab'[t]}") for i in range(4) for t in (0, 1)] and all(s == seen[0] for s in seen)


def test_resume_over_files_cut_anew(spark, tmp_path):
    s = settings_for("coqa", tmp_path)
    for files in (1, 4):
        for f in range(files):
            spark.createDataFrame(STORIES[f * 4 // files : (f + 1) * 4 // files], datasets.SCHEMAS["coqa"]).coalesce(1).write.parquet(str(tmp_path / f"in{files}" / str(f)))
        assert runner.run(datasets.read_items(spark, "coqa", str(tmp_path / f"in{files}" / "*")), s).count() == 16


def test_sizes_at_all_levels_are_those_of_each(spark):
    texts = ["a b  c d", "", "one", " ", "   ", " ".join(f"w{i}" for i in range(250)), "é" * 500 + " x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(backends.compressed_sizes(F.col("t"), config.LEVELS).alias("all"), F.array(*(backends.compressed_columns(F.col("t"), F.lit(x))[2] for x in config.LEVELS)).alias("each")).collect()
    assert all(r["all"] == r["each"] for r in got)


def test_inputs_cache(tmp_path):
    p = str(tmp_path / "i.json")
    assert datasets.inputs(p, {"s": "a"}, lambda x: x + "!") == {"s": "a!"}
    assert datasets.inputs(p, {"s": "a"}, lambda x: 1 / 0) == {"s": "a!"}
    assert datasets.inputs(p, {"s": "a", "l": "b"}, str.upper) == {"s": "A", "l": "B"}
    with pytest.raises(RuntimeError):
        datasets.inputs(str(tmp_path / "j.json"), {"s": "a"}, lambda x: "")


def test_retries():
    waits = []
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        backends.with_retries(lambda: 1 / 0, 3, 2.0, "x", waits.append)
    assert waits == [2.0, 4.0]


def test_offline_compression_forms_agree(spark):
    texts = ["a b  c d", "", "one", " ".join(f"w{i}" for i in range(250))]
    for level in (0.05, 0.3, 0.7):
        cols = backends.compressed_columns(F.col("t"), F.lit(level))
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(c.alias(n) for c, n in zip(cols, "sba"))).collect()
        for r in rows:
            assert (r["s"], r["b"], r["a"]) == backends.WordDropper()(r["t"], level, "m")


def test_command_line(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.createDataFrame([("i", "t", "the x is y", "q", (["y"],))], datasets.SCHEMAS["squad_v2"]).write.parquet(p)
    out = cli.main(["accuracy", "squad_v2", p, "--config", "control", "--results", str(tmp_path / "res"), "--limit", "5"], spark)
    assert "Accuracy: 100.0%" in out
    assert len(cli.main(["latency", "--runs", "1"], spark).splitlines()) == 42
    recorded = {f"{m}/{p}/{s}": [[5.0, 'data: {"choices":[{"delta":{"content":"hi"}}]}'], [9.0, "data: [DONE]"]] for m in ("large-a", "small-c") for p in ("native", "router") for s in ("short", "medium", "long")}
    recorded |= {f"large-a/{x}": [[5.0, 'data: {"choices":[{"delta":{"content":"hi"}}]}']] for x in ("none", "low")}
    (tmp_path / "recorded.json").write_text(json.dumps(recorded))
    (tmp_path / "inputs.json").write_text(json.dumps({"short": "s" * 8, "medium": "m" * 80, "long": "l" * 800}))
    given = ["--replay", str(tmp_path / "recorded.json")]
    out = cli.main(["latency", "--runs", "2", "--model", "large-a", "--out", str(tmp_path / "lat"), "--inputs", str(tmp_path / "inputs.json"), *given], spark)
    assert len(out.splitlines()) == 16 and sum(x.endswith("2/2") for x in out.splitlines()) == 6
    cycle = ["monitor", "--state", str(tmp_path / "state.json"), "--log", str(tmp_path / "log"), *given]
    assert cli.main(cycle, spark).splitlines() == ["large-a none ttft 5 ms", "large-b none failed: no content in stream", "small-c none failed: no content in stream"]
    assert "low" in cli.main(cycle, spark) and datasets.read_log(spark, str(tmp_path / "log")).count() == 6
    with pytest.raises(SystemExit):
        cli.main(["accuracy", "squad_v2", p, "--config", "nope"], spark)
    assert "not set" in cli.main(["accuracy", "squad_v2", p, "--model-url", "http://127.0.0.1:1"], spark)
