"""Calls to the outside: compression, language model, judge and timed streams. Each has an offline form, which is deterministic, and an HTTP form.

A backend is a small picklable object that is called once a row on an executor, from mapInPandas: one instance a partition, so connections can be kept.
A failing call becomes data in its row, never a failed job. Results must be written before they are used twice, as every action calls again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import estimate_tokens


class Compressor(Protocol):
    def __call__(self, text: str, aggressiveness: float, model: str) -> tuple[str, int, int]: ...


class Model(Protocol):
    def __call__(self, key: str, messages: list[dict], gold: str | None) -> str: ...


class Judge(Protocol):
    def __call__(self, question: str, gold: str, answer: str) -> str: ...


def with_retries(call: Callable, attempts: int = 2, base_delay: float = 2.0, what: str = "call", sleep: Callable[[float], None] = time.sleep):
    """call() up to attempts times, waiting base_delay, then twice as long and so on between; RuntimeError when all have failed."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts:
                raise RuntimeError(f"{what} failed after {attempts} attempts: {e}") from e
            sleep(base_delay * 2**n)
    raise RuntimeError(f"{what}: no attempts")


def drop_words(text: Column, aggressiveness: Column) -> Column:
    """The offline compression: of the words between single spaces, word i goes if i * 37 mod 100 is below the aggressiveness in per cent."""
    share = F.round(aggressiveness * 100).cast("int")
    return F.array_join(F.filter(F.split(text, " "), lambda _, i: F.pmod(i * 37, F.lit(100)) >= share), " ")


def compressed_sizes(text: Column, levels: tuple[float, ...]) -> Column:
    """The compressed tokens at each level, as compressed_columns has them, as an array in the levels' order: the text is cut once, and no shorter text is made."""
    # a word is its length and a space, and its turn in the last two digits
    words = F.transform(F.split(text, " "), lambda w, i: (F.length(w) + 1) * 100 + F.pmod(i * 37, F.lit(100)))

    def sizes(ws: Column) -> Column:
        left = lambda level: F.aggregate(ws, F.lit(0), lambda a, w: a + F.when(F.pmod(w, F.lit(100)) >= F.lit(round(level * 100)), F.floor(w / 100).cast("int")).otherwise(0))
        return F.array(*(F.least(F.floor(F.greatest(left(level) - 1, F.lit(0)) / 4).cast("long"), estimate_tokens(text)) for level in levels))

    return F.try_element_at(F.transform(F.array(words), sizes), F.lit(1))


def compressed_columns(text: Column, aggressiveness: Column) -> tuple[Column, Column, Column]:
    """(compressed text, original tokens, compressed tokens) of the offline compression; compressed tokens never exceed the original's."""
    short = drop_words(text, aggressiveness)
    return short, estimate_tokens(text), F.least(estimate_tokens(short), estimate_tokens(text))


@dataclass
class WordDropper:
    """The offline compressor as a backend. Texts that contain one of fail_on raise."""

    fail_on: tuple[str, ...] = ()

    def __call__(self, text: str, aggressiveness: float, model: str) -> tuple[str, int, int]:
        for f in self.fail_on:
            if f in text:
                raise RuntimeError(f"told to fail on {f!r}")
        share = round(aggressiveness * 100)
        short = " ".join(w for i, w in enumerate(text.split(" ")) if i * 37 % 100 >= share)
        return short, len(text) // 4, len(short) // 4


@dataclass
class EchoModel:
    """The offline model: says gold, or the first sentence after the context's heading; raises for the keys in fail_on."""

    say: str = "gold"
    fail_on: tuple[str, ...] = ()

    def __call__(self, key: str, messages: list[dict], gold: str | None) -> str:
        if key in self.fail_on:
            raise RuntimeError(f"told to fail on {key}")
        if self.say == "gold":
            return (gold or "").strip()
        body = messages[-1]["content"].partition("\n")[2]
        return body.partition(".")[0].strip()


#: How an answer may decline.
DECLINES = ("unanswerable", "nothing in the text", "the text is silent", "does not say", "no answer", "unclear")


@dataclass
class ContainsJudge:
    """The offline judge: CORRECT if the gold answer stands in the answer, but for case and white space. It stands in for a model, and its accuracy is not a model's."""

    def __call__(self, question: str, gold: str, answer: str) -> str:
        flat = lambda s: " ".join(s.casefold().split())
        g, a = flat(gold or ""), flat(answer or "")
        right = any(d in a for d in DECLINES) if g == "unanswerable" else g in a
        return "CORRECT: the gold answer is in the answer" if right else "INCORRECT: the gold answer is not in the answer"


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpCompressor:
    url: str
    key: str = field(repr=False)
    timeout: float = 120.0

    def __call__(self, text: str, aggressiveness: float, model: str) -> tuple[str, int, int]:
        got = _post(self.url, self.key, {"input": text, "compression_settings": {"aggressiveness": aggressiveness}, "model": model}, self.timeout)
        return got["output"], int(got["original_input_tokens"]), int(got["output_tokens"])


@dataclass
class HttpModel:
    """A chat-completions endpoint; with rubric set, a judge."""

    url: str
    key: str = field(repr=False)
    model: str = ""
    most: int = 1024
    timeout: float = 180.0

    def __call__(self, key: str, messages: list[dict], gold: str | None = None) -> str:
        got = _post(self.url, self.key, {"model": self.model, "messages": messages, "max_completion_tokens": self.most}, self.timeout)
        return got["choices"][0]["message"]["content"].strip()


@dataclass
class HttpJudge:
    model: HttpModel
    rubric: str = ""

    def __call__(self, question: str, gold: str, answer: str) -> str:
        asked = f"Question: {question}\n\nGold Answer: {gold}\n\nModel Answer: {answer}"
        return self.model("", [{"role": "system", "content": self.rubric}, {"role": "user", "content": asked}])


def _map(df: DataFrame, added: str, one: Callable[[dict], tuple]) -> DataFrame:
    """df with added columns, which one(row) gives in order."""
    new = df.sparkSession.createDataFrame([], added).schema
    schema = StructType([*df.schema.fields, *new.fields])
    names = [f.name for f in new.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [one(row) for row in frame.to_dict("records")]
            for i, n in enumerate(names):
                frame[n] = pd.Series([g[i] for g in got], index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(run, schema)


def compress(df: DataFrame, backend: Compressor, attempts: int = 2, base_delay: float = 2.0) -> DataFrame:
    """df (text, aggressiveness, compressor, ...) with compressed_text, original_tokens, compressed_tokens and error. A failed call leaves tokens null and the text as it was."""

    def one(row: dict) -> tuple:
        if row["text"] is None:
            return None, None, None, "no text"
        try:
            short, before, after = with_retries(lambda: backend(row["text"], row["aggressiveness"], row["compressor"]), attempts, base_delay, "compression")
            return short, before, min(before, after), None
        except RuntimeError as e:
            return row["text"], None, None, str(e)

    return _map(df, "compressed_text string, original_tokens bigint, compressed_tokens bigint, error string", one)


def answer(df: DataFrame, backend: Model, attempts: int = 2, base_delay: float = 2.0) -> DataFrame:
    """df (question_id, messages, gold_answer, ...) with model_answer; a failed call's answer says ERROR, and is graded as any other."""

    def one(row: dict) -> tuple:
        try:
            turns = [{"role": m["role"], "content": m["content"]} for m in row["messages"]]
            return (with_retries(lambda: backend(row["question_id"], turns, row["gold_answer"]), attempts, base_delay, "model").strip(),)
        except RuntimeError as e:
            return (f"ERROR: {e}",)

    return _map(df, "model_answer string", one)


def judge(df: DataFrame, backend: Judge, attempts: int = 2, base_delay: float = 2.0) -> DataFrame:
    """df (question, gold_answer, model_answer, ...) with the judge's reply, or ERROR and why there is none, in explanation."""

    def one(row: dict) -> tuple:
        try:
            return (with_retries(lambda: backend(row["question"], row["gold_answer"], row["model_answer"]), attempts, base_delay, "judge").strip(),)
        except RuntimeError as e:
            return (f"ERROR: {e}",)

    return _map(df, "explanation string", one)


class TimedCall(Protocol):
    def __call__(self, row: dict) -> tuple[int | None, list[tuple[float, str]], float | None, str | None]: ...


@dataclass
class Replay:
    """The offline timed call: recorded (t_ms, line) rows by key, with the total time."""

    records: dict[str, list[tuple[float, str]]]
    status: int = 200

    def __call__(self, row: dict) -> tuple[int | None, list[tuple[float, str]], float, str | None]:
        lines = self.records.get(row["key"], [])
        return self.status, lines, (lines[-1][0] + 1 if lines else 0.0), None


#: The environment variable of each kind of key.
KEY_NAMES = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "router": "ROUTER_API_KEY", "gateway": "GATEWAY_API_KEY"}


def headers(kind: str, key: str) -> dict[str, str]:
    """A request's headers: the messages API has its own for the key, and one for its version."""
    own = {"x-api-key": key, "anthropic-version": "2023-06-01"} if kind == "anthropic" else {"Authorization": f"Bearer {key}"}
    return {"Content-Type": "application/json", **own}


@dataclass
class HttpStream:
    """A streamed POST on a connection of its own, with the key of the row's key_kind; without one the call fails. The clock starts inside the call, so that waiting for a task does not count."""

    keys: dict[str, str | None] = field(repr=False)
    timeout: float = 180.0

    def __call__(self, row: dict) -> tuple[int | None, list[tuple[float, str]], float, str | None]:
        lines: list[tuple[float, str]] = []
        kind = row["key_kind"]
        if not (key := self.keys.get(kind)):
            return None, lines, None, f"{KEY_NAMES.get(kind, kind)} not set"
        start, status, error = time.perf_counter(), None, None
        now = lambda: (time.perf_counter() - start) * 1000
        try:
            request = urllib.request.Request(row["url"], row["body"].encode(), headers(kind, key))
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                status = r.status
                for line in r:
                    lines.append((now(), line.decode("utf-8", "replace").rstrip("\r\n")))
        except urllib.error.HTTPError as e:
            status, error = e.code, f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:300]}"
        except Exception as e:
            error = f"{e.__class__.__name__}: {e}"
        return status, lines, now(), error


def timed(df: DataFrame, backend: TimedCall) -> DataFrame:
    """df (key, ...) with status_code, lines, total_ms and call_error. All calls run in one task, one after another, so that they do not slow each other."""

    def one(row: dict) -> tuple:
        status, lines, total, error = backend(row)
        return status, [{"t_ms": t, "line": x} for t, x in lines], total, error

    return _map(df.coalesce(1), "status_code int, lines array<struct<t_ms:double,line:string>>, total_ms double, call_error string", one)
