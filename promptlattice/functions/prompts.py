"""Prompt and request builders as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

PASSAGES = "\n\n---\n\n"
NO_ANSWER = "UNANSWERABLE"


def join_passages(passages: Column, field: str | None = None) -> Column:
    """The passages in order, stripped, between rules. Null and empty ones are left out; one of white space alone counts as an empty one."""
    text = F.transform(passages, lambda e: e[field]) if field else passages
    kept = F.filter(text, lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.transform(kept, py_strip), PASSAGES)


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def qa_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def choice_prompt(context: Column, question: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    lines = [part for name, choice in zip("ABCD", (a, b, c, d)) for part in (F.lit(f"\n{name}) "), choice)]
    return F.concat(qa_prompt(context, question), F.lit("\n"), *lines)


def story_prompt(story: Column, prior: Column, question: Column) -> Column:
    """prior: array of (q, a), numbered from 1, an answer that is missing empty; the part about the conversation so far is there only if there was one."""
    turns = F.transform(prior, lambda t, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), t["q"], F.lit("\nA"), (i + 1).cast("string"), F.lit(": "), F.coalesce(t["a"], F.lit(""))))
    so_far = F.when(F.size(prior) > 0, F.concat(F.lit("Conversation so far:\n"), F.array_join(turns, "\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("Story:\n"), story), so_far, F.concat(F.lit("Current question: "), question))


def gold_answer(answers: Column) -> Column:
    """The first answer, or NO_ANSWER if there is none."""
    return F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit(NO_ANSWER))


def is_answerable(answers: Column) -> Column:
    return F.coalesce(F.size(answers), F.lit(0)) > 0


def judge_message(question: Column, gold: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nGold Answer: "), gold, F.lit("\n\nModel Answer: "), answer)


def full_prompt_tokens(system: Column, user: Column) -> Column:
    """Estimated tokens of the system text, a line end and the user's text."""
    from .text import estimate_tokens

    return estimate_tokens(F.concat(system, F.lit("\n"), user))


def summary_request(text: Column, nonce: Column | None = None) -> Column:
    """The request timed by the latency matrix; the nonce keeps caches from answering."""
    nonce = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8) if nonce is None else nonce
    return F.concat(F.lit("Give the gist of the text below in a single sentence of at most twenty words. [nonce:"), nonce, F.lit("]\n\n"), text)


def token_limit_key(vendor: Column) -> Column:
    return F.when(vendor == "openai", "max_completion_tokens").otherwise("max_tokens")


def reasoning_effort(model: Column) -> Column:
    """minimal for gpt-5 and its mini and nano forms, none for the other reasoning models, null for all others."""
    starts = lambda *names: F.lit(False) if not names else F.startswith(model, F.lit(names[0])) | starts(*names[1:])
    return F.when(starts("gpt-5-nano", "gpt-5-mini") | (model == "gpt-5"), "minimal").when(starts("o4", "o3", "o1", "gpt-5"), "none")


def gateway_model(model: Column, level: Column) -> Column:
    return F.concat(model, F.lit("?compression="), level)


def request_body(model: Column, content: Column, vendor: Column, effort: Column, most: int = 2000, native: bool = False) -> Column:
    """The body of a streamed chat request as JSON. native: the form of the vendor's own messages API, which knows no effort."""
    fields = [model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"), F.lit(True).alias("stream")]
    limit = F.lit(most)
    if native:
        return F.to_json(F.struct(*fields, limit.alias("max_tokens")))
    completion = F.when(vendor == "openai", limit).alias("max_completion_tokens")
    plain = F.when(vendor == "openai", F.lit(None)).otherwise(limit).alias("max_tokens")
    return F.to_json(F.struct(*fields, completion, plain, F.when(vendor == "openai", effort).alias("reasoning_effort")))
