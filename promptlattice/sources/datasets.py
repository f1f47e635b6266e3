"""Readers of the question-answering sets, run results, stream records and caches, and their canonical form.

A canonical item has ordinal, question_id, question, gold_answer, context, memo_key (what a compression may be shared by), prior (array of (q, a)) and the set's own columns.
The ordinal is the row's place in the source, from 0 without gaps: files by path, rows as they stand in them. Limits and fallback ids follow it, so it does not hang on how files are cut into tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import py_strip

SCHEMAS: dict[str, str] = {
    "financebench": "question_id string, question string, answer string, question_type string, question_reasoning string, evidence array<struct<evidence_text_full_page:string>>",
    "longbench_v2": "_id string, question string, answer string, context string, domain string, sub_domain string, difficulty string, length string, choice_A string, choice_B string, choice_C string, choice_D string",
    "squad_v2": "id string, title string, context string, question string, answers struct<text:array<string>>",
    "coqa": "story string, source string, questions array<string>, answers struct<input_text:array<string>>",
}
RESULT = (
    "question_id string, question string, gold_answer string, model_answer string, correct boolean, explanation string, config string, compressed boolean, aggressiveness double, "
    "original_tokens bigint, compressed_tokens bigint, compression_ratio double, error string, benchmark string, "
    "question_type string, question_reasoning string, title string, is_answerable boolean, story_id string, source string, turn_number int, "
    "domain string, sub_domain string, difficulty string, length_category string, extracted_answer string"
)
RUN_METRICS = (
    "success boolean, error string, status_code int, time_to_first_byte_ms double, time_to_first_token_ms double, total_time_ms double, chunks_received int, content_chars int, chars_per_sec double"
)
LOG = f"timestamp string, model string, compression string, {RUN_METRICS}, response_preview string"
SSE = "run_id bigint, line_no bigint, t_ms double, line string"


def with_defaults(df: DataFrame, schema: str) -> DataFrame:
    """df with a null column for each of schema that it lacks; a column that is there keeps its nulls."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name.lower() not in have))


def read_set(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A set's rows under its schema, with ordinal. fmt: parquet, json (a row a line) or json-array."""
    if fmt == "parquet":
        return with_defaults(_in_place(spark.read.parquet(path), F.col("_metadata.row_index"), F.lit(0).cast("long")), SCHEMAS[name])
    return _in_place(spark.read.schema(SCHEMAS[name]).option("multiLine", fmt == "json-array").json(path), F.monotonically_increasing_id(), F.col("_metadata.file_block_start"))


def _in_place(read: DataFrame, row: Column, piece: Column) -> DataFrame:
    """What was read with ordinal. row counts up by one from row to row of a piece of a file that one task reads, so a row's place is its distance from the piece's first, after the
    rows of all pieces before it: only the pieces' counts are summed up, and no row is moved."""
    d = read.select("*", F.col("_metadata.file_path").alias("__file"), piece.alias("__piece"), row.alias("__row"))
    before = Window.orderBy("__file", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = d.groupBy("__file", "__piece").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    pieces = pieces.select("__file", "__piece", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return d.join(pieces, ["__file", "__piece"]).withColumn("ordinal", F.col("__base") + F.col("__row") - F.col("__first")).drop("__file", "__piece", "__row", "__first", "__base")


def with_ordinal(df: DataFrame, order: Iterable[str] = (), name: str = "ordinal") -> DataFrame:
    """df, a small frame, with the row's place from 0: in one sort of the columns to order by, else as the rows come, with gaps. What is read from files has its place by read_set."""
    cols = list(order)
    if not cols:
        return df.withColumn(name, F.monotonically_increasing_id())
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*cols)) - 1).cast("long"))


def id_or_position(id_col: str, position: str = "ordinal"):
    """The id, or the position as a string where it is null."""
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(position).cast("string"))


def financebench_items(df: DataFrame) -> DataFrame:
    return df.select(
        "ordinal", id_or_position("question_id").alias("question_id"), "question", F.col("answer").alias("gold_answer"), prompts.join_passages(F.col("evidence"), "evidence_text_full_page").alias("context"),
        id_or_position("question_id").alias("memo_key"), F.expr("cast(array() as array<struct<q:string,a:string>>)").alias("prior"), F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce("question_reasoning", F.lit("")).alias("question_reasoning"),
    )


def longbench_items(df: DataFrame) -> DataFrame:
    return df.select(
        "ordinal", id_or_position("_id").alias("question_id"), "question", F.col("answer").alias("gold_answer"), py_strip(F.col("context")).alias("context"), id_or_position("_id").alias("memo_key"),
        F.expr("cast(array() as array<struct<q:string,a:string>>)").alias("prior"), "domain", "sub_domain", "difficulty", F.col("length").alias("length_category"), "choice_A", "choice_B", "choice_C", "choice_D",
    )


def squad_items(df: DataFrame) -> DataFrame:
    return df.select(
        "ordinal", id_or_position("id").alias("question_id"), "question", prompts.gold_answer(F.col("answers.text")).alias("gold_answer"), py_strip(F.col("context")).alias("context"), id_or_position("id").alias("memo_key"),
        F.expr("cast(array() as array<struct<q:string,a:string>>)").alias("prior"), "title", prompts.is_answerable(F.col("answers.text")).alias("is_answerable"),
    )


def flatten_conversations(df: DataFrame) -> DataFrame:
    """A row for each question of each conversation, in one narrow step: the turns before a question are a slice of its conversation's own arrays.

    There are as many turns as questions; an answer that is missing is null. turn_number counts from 1, ids are conversation_turn, from 0."""
    both = F.transform("questions", lambda q, i: F.struct(q.alias("q"), F.try_element_at(F.col("answers.input_text"), (i + 1).cast("int")).alias("a")))
    turns = df.withColumn("turns", both).select("ordinal", "source", py_strip(F.col("story")).alias("story"), "turns", F.posexplode("turns").alias("at", "turn"))
    story = F.col("ordinal").cast("string")
    return turns.select(
        story.alias("story_id"), F.concat_ws("_", story, F.col("at").cast("string")).alias("question_id"), F.coalesce("source", F.lit("unknown")).alias("source"), "story", F.col("turn.q").alias("question"), F.col("turn.a").alias("gold_answer"),
        (F.col("at") + 1).cast("int").alias("turn_number"), F.slice("turns", F.lit(1), F.col("at")).alias("prior"), "ordinal",
    )


def coqa_items(df: DataFrame) -> DataFrame:
    flat = flatten_conversations(df)
    return flat.select(F.struct("ordinal", "turn_number").alias("ordinal"), "question_id", "question", "gold_answer", F.col("story").alias("context"), F.col("story_id").alias("memo_key"), "prior", "story_id", "source", "turn_number")


ITEMS = {"financebench": financebench_items, "longbench_v2": longbench_items, "squad_v2": squad_items, "coqa": coqa_items}


def read_items(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return ITEMS[name](read_set(spark, name, path, fmt))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results so far: the table a run appends to. A path that is not there is an empty table; absent columns are null."""
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], RESULT)
        raise
    return with_defaults(df, RESULT)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Results from one JSON array a file, as other tools write them; absent keys are null, an absent file is empty."""
    try:
        return spark.read.option("multiLine", True).schema(RESULT).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], RESULT)
        raise


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The monitor's log, one JSON object a line, with ordinal: the line's place, older files first."""
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]
    return spark.read.schema(LOG).json(path).select("*", F.struct(*place, F.monotonically_increasing_id().alias("row")).alias("ordinal"))


def read_inputs(path: str, wanted: Iterable[str]) -> dict[str, str] | None:
    """The cached input texts by size, if the cache has exactly the wanted sizes."""
    if not os.path.exists(path):
        return None
    with open(path) as f:
        cached = json.load(f)
    return cached if set(cached) == set(wanted) else None


def inputs(path: str, prompts_by_size: dict[str, str], generate) -> dict[str, str]:
    """The cached input texts, or new ones by generate(prompt), which are then cached. An empty text is an error."""
    if (cached := read_inputs(path, prompts_by_size)) is not None:
        return cached
    made = {size: generate(prompt) for size, prompt in prompts_by_size.items()}
    if empty := [s for s, t in made.items() if not t]:
        raise RuntimeError(f"no text was generated for {', '.join(empty)}")
    with open(path, "w") as f:
        json.dump(made, f)
    return made


def dense_ordinal(df: DataFrame, key: str, name: str = "ordinal", bucket: int = 4096) -> DataFrame:
    """df with each row's place from 0 in the order of a whole-number key without ties, nulls first. Slices of the keys' range, which have about bucket rows each if keys are spread evenly, dense
    or hashed, are counted and summed up in two levels, and rows are numbered within their slice, so no task sees the whole."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    bits = max(1, int(((high - low) // n + 1) * bucket).bit_length() - 1) if n else 1
    d = df.withColumn("__slice", F.coalesce(F.shiftright(F.col(key).cast("long"), min(bits, 62)), F.lit(-(1 << 62) - 1)))  # one bit at least goes, so nulls are below all
    top = F.shiftright("__slice", 10)
    counts = d.groupBy("__slice").agg(F.count("*").alias("__n")).withColumn("__top", top)
    up = lambda *keys: Window.partitionBy(*keys) if keys else Window
    before = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("__top").agg(F.sum("__n").alias("__all")).select("__top", F.coalesce(F.sum("__all").over(before(up(), "__top")), F.lit(0)).alias("__base"))
    starts = counts.withColumn("__inner", F.coalesce(F.sum("__n").over(before(up("__top"), "__slice")), F.lit(0))).join(tops, "__top").select("__slice", (F.col("__base") + F.col("__inner")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(F.col(key).asc_nulls_first())) - 1
    return d.withColumn("__inside", inside).join(starts, "__slice").withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__slice", "__inside", "__start")
