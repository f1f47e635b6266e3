from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from promptlattice.operators import backends, latency
from promptlattice.plans import latency_run
from promptlattice.sources import datasets, sinks
from promptlattice.streaming import monitor

LINES = [(10.0, ": keepalive"), (20.0, 'data: {"choices":[]}'), (30.0, 'data: {"choices":[{"delta":{"role":"assistant"}}]}'), (40.0, "data: not json"), (50.0, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'),
         (60.0, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), (70.0, "data: [DONE]"), (80.0, 'data: {"choices":[{"delta":{"content":"X"}}]}')]


def lines_of(spark, lines, run=1):
    return spark.createDataFrame([(run, i, t, x) for i, (t, x) in enumerate(lines)], datasets.SSE)


def totals_of(spark, *rows):
    return spark.createDataFrame(rows, "run_id bigint, status_code int, total_ms double, call_error string")


def test_fold(spark):
    got = latency.fold(lines_of(spark, LINES), totals_of(spark, (1, 200, 100.0, None))).first()
    assert (got["time_to_first_byte_ms"], got["time_to_first_token_ms"], got["chunks_received"], got["content_chars"], got["chars_per_sec"], got["success"]) == (10.0, 50.0, 2, 5, 100.0, True)
    quiet = latency.fold(lines_of(spark, [x for x in LINES if x[0] not in (50.0, 60.0, 80.0)]), totals_of(spark, (1, 200, 100.0, None))).first()
    assert quiet["success"] is False and quiet["error"] == "no content in stream"
    prev = latency.fold(lines_of(spark, LINES), totals_of(spark, (1, 200, 100.0, None)), preview=True).first()
    assert prev["response_preview"] == "Hello"


def test_failed_calls(spark):
    t = totals_of(spark, (1, 503, 9.0, "HTTP 503: busy"), (2, None, 8.0, "TimeoutError: slow"))
    got = {r["run_id"]: r for r in latency.fold(lines_of(spark, LINES[:6], 2), t).collect()}
    assert got[1]["total_time_ms"] is None and got[1]["error"] == "HTTP 503: busy" and not got[1]["success"] and got[1]["chunks_received"] == 0
    assert got[2]["total_time_ms"] == 8.0 and not got[2]["success"] and got[2]["time_to_first_token_ms"] == 50.0
    assert latency.fold(lines_of(spark, [], 1), t, preview=True).where("run_id = 1").first()["total_time_ms"] == 9.0


def test_messages_form(spark):
    say = lambda s: "data: " + json.dumps({"type": "content_block_delta", "delta": {"type": "text_delta", "text": s}})
    rows = [(1.0, "event: x"), (2.0, "data: [DONE]"), (3.0, say("ab")), (4.0, 'data: {"type":"content_block_delta","delta":{"type":"thinking","text":"no"}}'), (5.0, 'data: {"type":"message_stop"}'), (6.0, say("c"))]
    got = latency.fold(lines_of(spark, rows), form="anthropic").first()
    assert (got["time_to_first_byte_ms"], got["time_to_first_token_ms"], got["content_chars"], got["chunks_received"]) == (1.0, 3.0, 2, 1)


def test_matrix(spark):
    assert latency.matrix(spark).count() == 126 and latency.matrix(spark, runs=1).count() == 42 and latency.matrix(spark, runs=0).count() == 0
    assert latency.matrix(spark, keys=("gateway",), runs=1).count() == 27
    assert latency.matrix(spark, runs=1, model="small-c", size="short").count() == 4
    assert latency.matrix(spark, runs=1, provider="gateway_low", model="large-a").first()["model_field"] == "openai/gpt-5.4?compression=low"


def runs(spark):
    rows = [("m", "p", "s", 5, i, True, None, 200, 1.0, v, 10.0, 1, 1, None) for i, v in enumerate((1.0, 2.0, 4.0, 10.0))] + [("m", "p", "s", 5, 9, False, "bad", 500, 1.0, 99.0, None, 0, 0, None)]
    return spark.createDataFrame(rows, f"model string, provider string, input_size string, input_tokens int, run int, {datasets.RUN_METRICS}")


def test_summary_and_export(spark, tmp_path):
    s = latency.combo_summary(runs(spark))
    r = s.first()
    assert (r["runs_ok"], r["runs_failed"], r["ttft_ms_avg"], r["ttft_ms_med"], r["errors"], r["chars_per_sec_avg"]) == (4, 1, 4.25, 3.0, ["bad"], None)
    assert " - " in latency.print_table(s) + " "
    out = str(tmp_path / "m.json")
    sinks.export_matrix(s, runs(spark), out)
    got = json.load(open(out))
    assert len(got["raw"][0]["runs"]) == 5 and got["raw"][0]["runs"][4]["error"] == "bad" and got["summaries"][0]["chars_per_sec_avg"] is None


def test_timed_replay(spark):
    calls = spark.createDataFrame([("k", 1), ("none", 2)], "key string, run_id bigint")
    got = backends.timed(calls, backends.Replay({"k": LINES})).cache()
    lines = got.select("run_id", F.posexplode("lines").alias("line_no", "x")).select("run_id", F.col("line_no").cast("bigint"), "x.t_ms", "x.line")
    m = {r["run_id"]: r for r in latency.fold(lines, got.select("run_id", "status_code", "total_ms", "call_error")).collect()}
    assert m[1]["success"] and m[1]["total_time_ms"] == 81.0 and not m[2]["success"]


SAY = {"openai": lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]}), "anthropic": lambda s: "data: " + json.dumps({"type": "content_block_delta", "delta": {"type": "text_delta", "text": s}})}


def test_requests(spark):
    texts = {"short": "s" * 40, "medium": "m", "long": "l"}
    rows = {r["key"]: r for r in latency_run.requests(latency.matrix(spark, runs=1), texts, latency_run.Endpoints(gateway="http://gate")).collect()}
    assert len(rows) == 42 and len({r["run_id"] for r in rows.values()}) == 42
    a, b, c, g = (rows[k] for k in ("large-a/native/short", "large-b/native/short", "small-c/router/long", "large-a/gateway_low/medium"))
    assert (a["key_kind"], b["key_kind"], c["key_kind"], g["key_kind"]) == ("openai", "anthropic", "router", "gateway") and a["input_tokens"] == 10
    assert [r["url"] for r in (a, b, g)] == [latency_run.Endpoints.openai, latency_run.Endpoints.anthropic, "http://gate"]
    body = json.loads(a["body"])
    assert body["model"] == "gpt-5.4" and body["max_completion_tokens"] == 2000 and body["reasoning_effort"] == "none" and body["stream"] is True and body["messages"][0]["content"].endswith("s" * 40)
    body = json.loads(b["body"])
    assert body["max_tokens"] == 2000 and not {"max_completion_tokens", "reasoning_effort"} & set(body)
    assert json.loads(c["body"])["max_tokens"] == 2000 and json.loads(g["body"])["model"] == "openai/gpt-5.4?compression=low"


def test_latency_run(spark, tmp_path):
    records = {f"{m}/{p}/short": [(10.0, ": wait"), (20.0, SAY["anthropic" if (m, p) == ("large-b", "native") else "openai"]("hello"))] for m in ("large-a", "large-b") for p in ("native", "router")}
    summaries, runs = latency_run.run(spark, {"short": "x" * 8}, backends.Replay(records), str(tmp_path), runs=2)
    assert runs.count() == 28
    got = {(r["model"], r["provider"]): r for r in summaries.collect()}
    assert len(got) == 14 and got["large-b", "native"]["runs_ok"] == 2 and got["large-b", "native"]["ttft_ms_avg"] == 20.0
    assert got["small-c", "router"]["runs_failed"] == 2 and got["small-c", "router"]["errors"] == ["no content in stream"]
    report = json.load(open(tmp_path / "report.json"))
    assert len(report["summaries"]) == 14 and all(len(r["runs"]) == 2 for r in report["raw"])
    few, _ = latency_run.run(spark, {"short": "x" * 8}, backends.Replay(records), str(tmp_path / "b"), keys=("anthropic",), runs=1)
    assert [(r["model"], r["provider"]) for r in few.collect()] == [("large-b", "native")]


def test_missing_key_is_a_failed_run(spark, tmp_path):
    _, runs = latency_run.run(spark, {"short": "x"}, backends.HttpStream({}), str(tmp_path), runs=1, provider="native", size="short")
    assert {(r["success"], r["error"], r["status_code"], r["total_time_ms"]) for r in runs.collect()} == {(False, "OPENAI_API_KEY not set", None, None), (False, "ANTHROPIC_API_KEY not set", None, None)}


class Handler(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        self.seen.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.send_response(503 if self.path == "/busy" else 200)
        self.end_headers()
        self.wfile.write(b"busy" if self.path == "/busy" else (SAY["openai"]("Hel") + "\n\n" + SAY["openai"]("lo") + "\n\ndata: [DONE]\n\n").encode())

    def log_message(self, *a):
        pass


def test_streamed_calls_and_texts(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        call = backends.HttpStream({"openai": "k1", "anthropic": "k2"})
        status, lines, total, error = call({"url": url, "key_kind": "anthropic", "body": "{}"})
        sent = {k.lower(): v for k, v in Handler.seen[-1][0].items()}
        assert status == 200 and error is None and total > 0 and sent["x-api-key"] == "k2" and sent["anthropic-version"] and "authorization" not in sent
        assert call({"url": url + "/busy", "key_kind": "openai", "body": "{}"})[3] == "HTTP 503: busy" and Handler.seen[-1][0]["Authorization"] == "Bearer k1"
        assert call({"url": url, "key_kind": "router", "body": "{}"}) == (None, [], None, "ROUTER_API_KEY not set")
        assert latency_run.streamed_text(call, "write", url) == "Hello" and Handler.seen[-1][1]["messages"] == [{"role": "user", "content": "write"}]
        with pytest.raises(RuntimeError, match="503"):
            latency_run.streamed_text(call, "write", url + "/busy")
        cache = str(tmp_path / "inputs.json")
        assert latency_run.texts_for(cache, backends.Replay({"p": [(1.0, SAY["openai"]("text"))]}), {"short": "p"}) == {"short": "text"}
        assert latency_run.texts_for(cache, backends.HttpStream({}), {"short": "p"}) == {"short": "text"}
    finally:
        server.shutdown()


def test_monitor_cycles(spark, tmp_path):
    records = {"large-a/none": [(1.0, SAY["openai"]("a" * 150))], "small-c/low": [(2.0, SAY["openai"]("b"))]}
    state, folder = str(tmp_path / "s.json"), str(tmp_path / "log")
    first = latency_run.cycle(spark, state, folder, backends.Replay(records), "Name one river.", now=lambda: "2024-01-01T00:00:00+00:00").collect()
    assert [(r["model"], r["compression"], r["success"]) for r in first] == [("large-a", "none", True), ("large-b", "none", False), ("small-c", "none", False)]
    assert first[0]["response_preview"] == "a" * 100 and first[0]["chars_per_sec"] == 150000.0
    latency_run.cycle(spark, state, folder, backends.Replay(records), "Name one river.", now=lambda: "2024-01-01T00:15:00+00:00")
    stats = monitor.quick_stats(datasets.read_log(spark, folder)).first()
    assert (stats["total"], stats["ok"], stats["first"], stats["last"]) == (6, 2, "2024-01-01T00:00", "2024-01-01T00:15")


def log(spark):
    rows = [(f"2024-01-01T00:{i:02d}:00+00:00", "m", "low", i != 1, None, 200, 1.0, float(i), 2.0, 1, 1, None, "x") for i in (0, 1, 20)]
    return spark.createDataFrame(rows, datasets.LOG)


def test_monitor(spark, tmp_path):
    p = str(tmp_path / "state.json")
    assert [monitor.level_of(monitor.next_cycle(p)) for _ in range(4)] == ["none", "low", "high", "none"]
    (tmp_path / "state.json").write_text("junk")
    assert monitor.next_cycle(p) == 0
    folder = str(tmp_path / "log")
    sinks.append_log(log(spark).coalesce(1), folder)
    stats = monitor.quick_stats(datasets.read_log(spark, folder)).first()
    assert (stats["total"], stats["ok"], stats["failed"], stats["first"], stats["last"]) == (3, 2, 1, "2024-01-01T00:00", "2024-01-01T00:20")
    batch = sorted(map(tuple, monitor.windowed_latency(log(spark)).collect()))
    assert [(b[3], b[4]) for b in batch] == [(2, 1), (1, 1)]
    late = spark.createDataFrame([("2024-01-02T00:00:00+00:00", "m", "low", True, None, 200, 1.0, 1.0, 2.0, 1, 1, None, "x")], datasets.LOG)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for extra in (None, late):
        if extra is not None:
            sinks.append_log(extra, folder)
        monitor.write_windows(monitor.windowed_latency(monitor.stream_log(spark, folder)), out, check).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == batch
