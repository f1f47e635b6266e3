"""The evaluation's queries over the given tables, each with its SQL.

documents stand for contexts, and with labels for graded results (quality is correct, no label is not evaluated); conversations for stories and their turns; benchmark for
questions; events for timed runs. Every query runs over its whole tables; a limit is there only where the prefix limit is what is shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..operators import backends, grading, latency, summary
from ..plans import runner
from ..plans.config import LEVELS, SYSTEM, Settings, config_grid, grid_frame, small_frame
from ..sources import datasets, sinks
from ..sources.datasets import dense_ordinal
from ..streaming.monitor import LEVELS as ROTATION
from ..streaming.monitor import quick_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRID = config_grid(("compressor-2", "compressor-1"), LEVELS)
SYS, ASK, BUDGET, LIMIT = SYSTEM["squad_v2"], "What is the text about?", 300, 150
LEVEL = 0.3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def graded(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("is_answerable"))
    return table(spark, d, "documents").select("doc_id", *columns).join(labels, "doc_id", "left")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, n, question, answer): user turns, numbered from 1, with the assistant's reply if the next turn is one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"next": F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)), "n": F.count_if(F.col("role") == "user").over(w)})
    return c.where("role = 'user'").select("conv_id", "turn", "n", F.col("text").alias("question"), F.col("next").alias("answer"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """The conversations in the form of a set of stories, questions and answers; ordinal is the conversation's number."""
    turns = pairs(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "question", "answer"))).alias("turns"))
    part = lambda c: F.transform("turns", lambda t: t[c])
    d = turns.join(stories(spark, d), "conv_id")
    return d.select(F.col("conv_id").alias("ordinal"), "story", F.lit(None).cast("string").alias("source"), part("question").alias("questions"), F.struct(part("answer").alias("input_text")).alias("answers"))


def stories(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, story): what each conversation opens with."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(T.py_strip(F.min_by("text", "turn")).alias("story"))


G = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality = 1 AS correct, l.toxic = 0 AS is_answerable FROM documents d LEFT JOIN labels l USING (doc_id)) g"
COUNTS = "count(*) AS total, count(correct) AS evaluated, count_if(correct)::BIGINT AS correct, coalesce(count_if(correct) / nullif(count(correct), 0)::DOUBLE, 0.0) AS accuracy"
SHARE = "count(*) AS evaluated, count_if(correct)::BIGINT AS correct, count_if(correct) / count(*)::DOUBLE AS accuracy"
PAIRS = """(SELECT conv_id, turn, n, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
count_if(role = 'user') OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user') p"""
STORIES = "(SELECT conv_id, trim(arg_min(text, turn)) AS story FROM conversations GROUP BY conv_id) s"
PROMPT = f"'{SYS}' || chr(10) || 'Context:' || chr(10) || trim(text) || chr(10) || chr(10) || 'Question: {ASK}'"


def sql_short(text: str, share: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda x, i: ((i - 1) * 37) % 100 >= {share}), ' ')"


VALUES = ", ".join(f"({i}, '{n}', {str(c['compressed']).lower()}, {'NULL' if c['aggressiveness'] is None else c['aggressiveness']}::DOUBLE)" for i, (n, c) in enumerate(GRID.items()))
GRID_SQL = f"(VALUES {VALUES}) AS c(ordinal, config, compressed, aggressiveness)"


@query(f"SELECT {COUNTS} FROM {G}")
def q01_accuracy(spark, d):
    return summary.accuracy(graded(spark, d))


@query(f"SELECT lang AS key, {SHARE} FROM {G} WHERE correct IS NOT NULL AND nullif(lang, '') IS NOT NULL GROUP BY lang")
def q02_accuracy_by_lang(spark, d):
    return summary.breakdown(graded(spark, d, "lang"), "lang")


@query(f"""SELECT 'overall' AS level, NULL::VARCHAR AS key, {COUNTS} FROM {G} UNION ALL SELECT 'lang', lang, {COUNTS} FROM {G} WHERE nullif(lang, '') IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, {COUNTS} FROM {G} WHERE nullif(source, '') IS NOT NULL GROUP BY source""")
def q03_grouping_sets(spark, d):
    return summary.grouped_accuracy(graded(spark, d, "lang", "source"), ["lang", "source"])


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def q04_estimated_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _items(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("ordinal"), F.lit(ASK).alias("question"), T.py_strip(F.col("text")).alias("context"))


def _fits(items: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the items that the library's budget keeps."""
    kept = runner.within_budget(items, "squad_v2", SYS, BUDGET)
    return kept.select(F.col("ordinal").alias("doc_id"), prompts.full_prompt_tokens(F.lit(SYS), runner.user_prompt("squad_v2", F.col("context"))).alias("tokens"))


@query(f"SELECT doc_id, length({PROMPT}) // 4 AS tokens FROM documents WHERE length({PROMPT}) // 4 <= {BUDGET}")
def q05_token_budget(spark, d):
    return _fits(_items(table(spark, d, "documents")))


@query(f"""WITH l AS (SELECT * FROM documents ORDER BY doc_id LIMIT {LIMIT}), k AS (SELECT count(*) AS n FROM l WHERE length({PROMPT}) // 4 <= {BUDGET})
SELECT n AS kept, (SELECT count(*) FROM l) - n AS discarded, (SELECT count(*) FROM documents) - n AS discarded_of_all FROM k""")
def q06_discard_counts(spark, d):
    items = _items(table(spark, d, "documents"))
    limited = runner.first(items, LIMIT)
    kept = runner.within_budget(limited, "squad_v2", SYS, BUDGET)
    return small_frame(spark, [(kept.count(), runner.discarded(items, limited, kept, "squad_v2"), runner.discarded(items, limited, kept, "coqa"))], "kept bigint, discarded bigint, discarded_of_all bigint")


@query("""SELECT doc_id, item_id, 'Context:' || chr(10) || trim(d.text) || chr(10) || chr(10) || 'Question: ' || b.text AS prompt
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def q07_qa_prompt(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    n = asked.agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("item_id", F.try_mod("doc_id", "n"))
    return docs.join(asked, "item_id").select("doc_id", "item_id", prompts.qa_prompt(T.py_strip(F.col("text")), F.col("question")).alias("prompt"))


@query(f"""SELECT doc_id, 'Context:' || chr(10) || trim(text) || chr(10) || chr(10) || 'Question: {ASK}' || chr(10) || chr(10) || 'A) ' || lang || chr(10) || 'B) ' || source || chr(10) || 'C) ' || n_chars::VARCHAR
|| chr(10) || 'D) ' || doc_id::VARCHAR AS prompt FROM documents""")
def q08_choice_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", prompts.choice_prompt(T.py_strip(F.col("text")), F.lit(ASK), F.col("lang"), F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string")).alias("prompt"))


IDS = "conv_id::VARCHAR || '_' || (n - 1)::VARCHAR AS question_id"


@query(f"SELECT conv_id::VARCHAR AS story_id, {IDS}, 'unknown' AS source, story, question, answer AS gold_answer, n::INTEGER AS turn_number FROM {PAIRS} JOIN {STORIES} USING (conv_id)")
def q09_flatten(spark, d):
    return datasets.flatten_conversations(conversations(spark, d)).drop("prior", "ordinal")


PRIOR = """(SELECT *, string_agg(question || ' / ' || coalesce(answer, ''), chr(10)) OVER w AS said, string_agg('Q' || n::VARCHAR || ': ' || question || chr(10) || 'A' || n::VARCHAR || ': ' || coalesce(answer, ''), chr(10)) OVER w AS so_far
FROM %s WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q""" % PAIRS


@query(f"SELECT {IDS}, (n - 1)::BIGINT AS turns_before, coalesce(said, '') AS history FROM {PRIOR}")
def q10_history(spark, d):
    flat = datasets.coqa_items(conversations(spark, d))
    said = F.transform("prior", lambda t: F.concat(t["q"], F.lit(" / "), F.coalesce(t["a"], F.lit(""))))
    return flat.select("question_id", F.size("prior").cast("long").alias("turns_before"), F.array_join(said, "\n").alias("history"))


@query(f"""SELECT {IDS}, 'Story:' || chr(10) || story || chr(10) || chr(10) || coalesce('Conversation so far:' || chr(10) || so_far || chr(10) || chr(10), '') || 'Current question: ' || question AS prompt
FROM {PRIOR} JOIN {STORIES} USING (conv_id)""")
def q11_story_prompt(spark, d):
    return datasets.coqa_items(conversations(spark, d)).select("question_id", runner.user_prompt("coqa", F.col("context")).alias("prompt"))


@query(f"SELECT conv_id, turn, coalesce(answer, 'UNANSWERABLE') AS gold_answer, answer IS NOT NULL AS is_answerable FROM {PAIRS}")
def q12_gold_answer(spark, d):
    answers = F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.array("answer"))
    return pairs(spark, d).select("conv_id", "turn", prompts.gold_answer(answers).alias("gold_answer"), prompts.is_answerable(answers).alias("is_answerable"))


@query(f"SELECT ordinal::INTEGER AS ordinal, config, count(*) AS items FROM documents CROSS JOIN {GRID_SQL} GROUP BY ALL")
def q13_grid(spark, d):
    return table(spark, d, "documents").select("doc_id").crossJoin(F.broadcast(grid_frame(spark, GRID))).groupBy("ordinal", "config").agg(F.count("*").alias("items"))


@query(f"""SELECT doc_id, length(text) // 4 AS original_tokens, least(length(s) // 4, length(text) // 4) AS compressed_tokens,
CASE WHEN length(text) // 4 > 0 THEN least(length(s) // 4, length(text) // 4) / (length(text) // 4)::DOUBLE ELSE 1.0 END AS ratio FROM (SELECT *, {sql_short('text', '30')} AS s FROM documents)""")
def q14_compress(spark, d):
    _, before, after = backends.compressed_columns(F.col("text"), F.lit(LEVEL))
    return table(spark, d, "documents").select("doc_id", before.alias("original_tokens"), after.alias("compressed_tokens")).withColumn("ratio", T.ratio(F.col("compressed_tokens"), F.col("original_tokens")))


@query("SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text <> '' GROUP BY conv_id")
def q15_join_passages(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(prompts.join_passages(ordered, "text").alias("context"))


@query(f"SELECT doc_id AS question_id, config FROM documents CROSS JOIN {GRID_SQL} WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND (l.quality = 1 OR c.config = 'control'))")
def q16_resume(spark, d):
    grid = grid_frame(spark, GRID).select("config")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), "quality")
    done = labels.where("quality = 1").select("question_id").crossJoin(F.broadcast(grid)).unionByName(labels.select("question_id", F.lit("control").alias("config")))
    return runner.not_done(table(spark, d, "documents").select(F.col("doc_id").alias("question_id")).crossJoin(F.broadcast(grid)), done)


@query(f"""SELECT {IDS}, 'compressor-2--{LEVEL}' AS config, length(story) // 4 AS original_tokens, least(length({sql_short('story', '30')}) // 4, length(story) // 4) AS compressed_tokens FROM {PAIRS} JOIN {STORIES} USING (conv_id)""")
def q17_story_memo(spark, d):
    todo = datasets.coqa_items(conversations(spark, d)).crossJoin(F.broadcast(grid_frame(spark, GRID, ["control", f"compressor-2--{LEVEL}"]).drop("ordinal")))
    once = runner.compress_once(todo, backends.WordDropper(), Settings("coqa"))
    return todo.select("memo_key", "config", "question_id").join(once, ["memo_key", "config"]).select("question_id", "config", "original_tokens", "compressed_tokens")


@query(f"WITH l AS (SELECT * FROM documents ORDER BY doc_id LIMIT {LIMIT}) SELECT doc_id, length({PROMPT}) // 4 AS tokens FROM l WHERE length({PROMPT}) // 4 <= {BUDGET}")
def q18_limit_then_filter(spark, d):
    return _fits(runner.first(_items(table(spark, d, "documents")), LIMIT))


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'en-' || doc_id::VARCHAR END, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR) AS question_id FROM documents")
def q19_fallback_ids(spark, d):
    docs = dense_ordinal(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    own = F.when(F.col("lang") == "en", F.concat(F.lit("en-"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.coalesce(own, F.col("ordinal").cast("string")).alias("question_id"))


@query(f"""SELECT count(o) AS compressed_rows, sum(o)::BIGINT AS original_tokens, sum(c)::BIGINT AS compressed_tokens, (sum(o) - sum(c))::BIGINT AS tokens_saved, CASE WHEN sum(o) > sum(c) THEN (sum(o) - sum(c)) / sum(o)::DOUBLE * 100 END AS saved_pct
FROM (SELECT CASE WHEN correct IS NOT NULL THEN length(text) // 4 END AS o, CASE WHEN correct IS NOT NULL THEN least(length({sql_short('text', '30')}) // 4, length(text) // 4) END AS c FROM {G}) HAVING count(o) > 0""")
def q20_token_totals(spark, d):
    _, before, after = backends.compressed_columns(F.col("text"), F.lit(LEVEL))
    rows = graded(spark, d, before.alias("b"), after.alias("a"))
    known = F.col("correct").isNotNull()
    return summary.token_totals(rows.select(F.when(known, F.col("b")).alias("original_tokens"), F.when(known, F.col("a")).alias("compressed_tokens")))


@query(f"""SELECT * FROM (SELECT coalesce(is_answerable, false) AS is_answerable, {SHARE} FROM {G} WHERE correct IS NOT NULL GROUP BY 1)
WHERE (SELECT count(DISTINCT coalesce(is_answerable, false)) FROM {G} WHERE correct IS NOT NULL) >= 2""")
def q21_answerability(spark, d):
    return summary.answerability(graded(spark, d))


def _guard(by: str) -> str:
    groups = f"g AS (SELECT {by}::VARCHAR AS key, {SHARE} FROM {G} WHERE correct IS NOT NULL AND nullif({by}::VARCHAR, '') IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS keys FROM g)"
    return f"WITH {groups} SELECT keys, key, evaluated, correct, accuracy FROM g, n WHERE keys <= 50 UNION ALL SELECT keys, NULL, NULL, NULL, NULL FROM n WHERE keys > 50"


@query(_guard("source"))
def q22_listed(spark, d):
    return summary.listed_or_counted(graded(spark, d, "source"), "source")


@query(_guard("n_chars"))
def q22_counted(spark, d):
    rows = graded(spark, d, F.col("n_chars").cast("string").alias("n_chars"))
    return summary.listed_or_counted(rows, "n_chars")


@query(f"""WITH t AS (SELECT n::VARCHAR AS key, length(answer) > length(question) AS correct FROM {PAIRS}), s AS (SELECT source AS key, correct FROM {G}),
a AS (SELECT 'turn' AS level, key, {SHARE} FROM t WHERE correct IS NOT NULL GROUP BY key), b AS (SELECT 'source' AS level, key, {SHARE} FROM s WHERE correct IS NOT NULL GROUP BY key)
SELECT * FROM a WHERE (SELECT count(*) FROM a) > 1 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM b) > 1""")
def q23_source_and_turn(spark, d):
    turns = pairs(spark, d).select(F.col("n").cast("string").alias("turn"), (F.length("answer") > F.length("question")).alias("correct"))
    by_turn = summary.breakdown(turns, "turn", keep_blank=True, least=2).select(F.lit("turn").alias("level"), "*")
    return by_turn.unionByName(summary.breakdown(graded(spark, d, "source"), "source", keep_blank=True, least=2).select(F.lit("source").alias("level"), "*"))


@query(f"""WITH r AS (SELECT c.*, g.correct, CASE WHEN compressed THEN length(text) // 4 END AS o, CASE WHEN compressed THEN least(length({sql_short('text', 'round(coalesce(aggressiveness, 0) * 100)')}) // 4, length(text) // 4) END AS k FROM {G} CROSS JOIN {GRID_SQL})
SELECT config, ordinal::INTEGER AS ordinal, {COUNTS}, count(o) AS compressed_rows, sum(o)::BIGINT AS original_tokens, sum(k)::BIGINT AS compressed_tokens, (sum(o) - sum(k))::BIGINT AS tokens_saved,
CASE WHEN sum(o) > sum(k) THEN (sum(o) - sum(k)) / sum(o)::DOUBLE * 100 END AS saved_pct FROM r GROUP BY config, ordinal""")
def q24_comparison(spark, d):
    # each text is cut once for all levels; the join carries its lengths, not its text
    grid = grid_frame(spark, GRID)
    sizes = F.arrays_zip(F.array(*map(F.lit, LEVELS)).alias("aggressiveness"), backends.compressed_sizes(F.col("text"), LEVELS).alias("compressed_tokens"))
    docs = graded(spark, d, T.estimate_tokens(F.col("text")).alias("original_tokens"), sizes.alias("sizes"))
    rows = docs.crossJoin(F.broadcast(grid)).withColumn("size", F.filter("sizes", lambda s: s["aggressiveness"] == F.col("aggressiveness")))
    rows = rows.select("config", "correct", F.when(F.col("compressed"), F.col("original_tokens")).alias("original_tokens"), F.try_element_at("size", F.lit(1))["compressed_tokens"].alias("compressed_tokens"))
    return summary.comparison(rows, grid)


@query("""SELECT m.model, p.provider, s.input_size, r::INTEGER AS run FROM (VALUES ('large-a', 'openai'), ('large-b', 'anthropic'), ('small-c', 'google')) AS m(model, vendor),
(VALUES ('native', 'native'), ('router', 'router'), ('gateway_none', 'gateway'), ('gateway_low', 'gateway'), ('gateway_high', 'gateway')) AS p(provider, kind), (VALUES ('short'), ('medium'), ('long')) AS s(input_size), range(1, 4) AS t(r)
WHERE NOT (p.kind = 'native' AND m.vendor = 'google')""")
def q25_latency_matrix(spark, d):
    return latency.matrix(spark).select("model", "provider", "input_size", "run")


@query("""SELECT 'm' || (user_id % 3)::VARCHAR AS model, count_if(ok)::BIGINT AS runs_ok, count_if(NOT ok)::BIGINT AS runs_failed, round(avg(value) FILTER (ok), 6) AS ttft_ms_avg, median(value) FILTER (ok) AS ttft_ms_med,
round(avg(value * 2) FILTER (ok), 6) AS total_ms_avg, coalesce(max(event_type) FILTER (NOT ok), '') AS errors FROM (SELECT *, event_type <> 'error' AS ok FROM events) GROUP BY 1""")
def q26_combo_summary(spark, d):
    ok = F.col("event_type") != "error"
    runs = table(spark, d, "events").select(
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model"), ok.alias("success"), F.when(~ok, F.col("event_type")).alias("error"), F.col("value").alias("time_to_first_byte_ms"), F.col("value").alias("time_to_first_token_ms"),
        (F.col("value") * 2).alias("total_time_ms"), F.lit(None).cast("double").alias("chars_per_sec"),
    )
    s = latency.combo_summary(runs, ("model",))
    # sums of doubles depend on their order: only the query's output is rounded
    return s.select("model", "runs_ok", "runs_failed", F.round("ttft_ms_avg", 6).alias("ttft_ms_avg"), "ttft_ms_med", F.round("total_ms_avg", 6).alias("total_ms_avg"), F.array_join("errors", ",").alias("errors"))


def _sse(spark, d):
    """A stream for each conversation: assistant turns are content, a user turn from the fifth on ends it."""
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))))
    line = line.when(F.col("role") == "system", ": keepalive").when(F.col("turn") >= 4, "data: [DONE]").otherwise('data: {"choices":[]}')
    return table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), ((F.col("turn") + 1) * 10).cast("double").alias("t_ms"), line.alias("line"))


LIVE = """(SELECT *, (turn + 1) * 10::DOUBLE AS t, turn <= coalesce(min(CASE WHEN role NOT IN ('assistant', 'system') AND turn >= 4 THEN turn END) OVER (PARTITION BY conv_id), turn) AS live, role = 'assistant' AND text <> '' AS says FROM conversations)"""


@query(f"""SELECT conv_id AS run_id, count_if(says) > 0 AS success, CASE WHEN count_if(says) = 0 THEN 'no content in stream' END AS error, 200 AS status_code, min(t) AS time_to_first_byte_ms, min(t) FILTER (says) AS time_to_first_token_ms,
max(t) AS total_time_ms, count_if(says)::INTEGER AS chunks_received, coalesce(sum(length(text)) FILTER (says), 0)::INTEGER AS content_chars,
CASE WHEN max(t) > min(t) FILTER (says) THEN (sum(length(text)) FILTER (says))::DOUBLE / ((max(t) - min(t) FILTER (says)) / 1000) END AS chars_per_sec FROM {LIVE} WHERE live GROUP BY conv_id""")
def q27_sse_fold(spark, d):
    return latency.fold(_sse(spark, d))


@query("""SELECT event_id, CASE WHEN event_id % 50 > 0 AND event_type <> 'error' AND value > event_id % 7 THEN (event_id % 50) / ((value - event_id % 7) / 1000) END AS chars_per_sec FROM events""")
def q28_throughput(spark, d):
    first = F.when(F.col("event_type") != "error", F.pmod("event_id", F.lit(7)).cast("double"))
    return table(spark, d, "events").select("event_id", T.throughput(F.pmod("event_id", F.lit(50)), F.col("value"), first).alias("chars_per_sec"))


@query("""SELECT count(*) AS total, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS failed, substr(arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id), 1, 16) AS first,
substr(arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id), 1, 16) AS last FROM events""")
def q29_quick_stats(spark, d):
    return quick_stats(table(spark, d, "events"), F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id"))


RESPONSES = ("the answer is {}", "Answer: ({})", "surely ({}) is the correct one", "so\n{}\nthen", "{}. it says", "I would take {} here", "nothing fits")
RESPONSE_SQL = "CASE event_id % 7 " + " ".join("WHEN %d THEN %s" % (i, " || ".join(f"'{p}'" for p in r.split("{}")).replace("' || '", "' || x || '").replace("\n", "' || chr(10) || '")) for i, r in enumerate(RESPONSES)) + " END"
CASCADE = ", ".join("nullif(regexp_extract(r, '%s', 1), '')" % ((f"(?{flags})" if flags else "") + shape) for flags, shape in T.SHAPES)


@query(f"""SELECT event_id, extracted_answer, extracted_answer = gold AS correct FROM (SELECT event_id, gold, upper(coalesce({CASCADE})) AS extracted_answer
FROM (SELECT event_id, substr('ABCD', (event_id // 2 % 4)::INTEGER + 1, 1) AS gold, {RESPONSE_SQL} AS r FROM (SELECT event_id, substr('ABCD', (event_id // 7 % 4)::INTEGER + 1, 1) AS x FROM events)))""")
def q30_answer_letter(spark, d):
    x = F.substring(F.lit("ABCD"), (F.pmod(F.floor(F.col("event_id") / 7), F.lit(4)) + 1).cast("int"), F.lit(1))
    said = F.lit(None).cast("string")
    for i, r in enumerate(RESPONSES):
        a, _, b = r.partition("{}")
        said = F.when(F.col("event_id") % 7 == i, F.concat(F.lit(a), x, F.lit(b)) if "{}" in r else F.lit(r)).otherwise(said)
    gold = F.substring(F.lit("ABCD"), (F.pmod(F.floor(F.col("event_id") / 2), F.lit(4)) + 1).cast("int"), F.lit(1))
    rows = table(spark, d, "events").select("event_id", gold.alias("gold_answer"), said.alias("model_answer"))
    return grading.grade_letters(rows).select("event_id", "extracted_answer", "correct")


@query("SELECT doc_id, starts_with(upper(trim(CASE WHEN quality = 1 THEN ' Correct: ' WHEN toxic = 1 THEN '**CORRECT** ' ELSE 'incorrect ' END || doc_id::VARCHAR)), 'CORRECT') AS correct FROM labels")
def q31_verdict(spark, d):
    reply = F.concat(F.when(F.col("quality") == 1, " Correct: ").when(F.col("toxic") == 1, "**CORRECT** ").otherwise("incorrect "), F.col("doc_id").cast("string"))
    return table(spark, d, "labels").select("doc_id", T.verdict(reply).alias("correct"))


@query("SELECT event_id, list_extract(['none', 'low', 'high'], (event_id % 3)::INTEGER + 1) AS compression FROM events")
def q32_rotation(spark, d):
    return table(spark, d, "events").select("event_id", T.rotation(list(ROTATION), F.col("event_id")).alias("compression"))


@query("""SELECT event_id, model, CASE WHEN model = 'gpt-5' OR starts_with(model, 'gpt-5-mini') OR starts_with(model, 'gpt-5-nano') THEN 'minimal' WHEN starts_with(model, 'gpt-5') OR starts_with(model, 'o3') THEN 'none' END AS effort,
CASE WHEN event_id % 2 = 0 THEN 'max_completion_tokens' ELSE 'max_tokens' END AS limit_key, model || '?compression=low' AS model_field FROM (SELECT event_id, list_extract(['gpt-5', 'gpt-5-mini', 'gpt-5.4', 'o3', 'other'], (event_id % 5)::INTEGER + 1) AS model FROM events)""")
def q33_request_fields(spark, d):
    names = F.array(*map(F.lit, ("gpt-5", "gpt-5-mini", "gpt-5.4", "o3", "other")))
    e = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("model"))
    vendor = F.when(F.col("event_id") % 2 == 0, "openai").otherwise("other")
    return e.select("event_id", "model", prompts.reasoning_effort(F.col("model")).alias("effort"), prompts.token_limit_key(vendor).alias("limit_key"), prompts.gateway_model(F.col("model"), F.lit("low")).alias("model_field"))


@query(f"SELECT conv_id, turn, 'Question: ' || question || chr(10) || chr(10) || 'Gold Answer: ' || coalesce(answer, 'UNANSWERABLE') || chr(10) || chr(10) || 'Model Answer: ' || question AS message FROM {PAIRS}")
def q34_judge_message(spark, d):
    return pairs(spark, d).select("conv_id", "turn", prompts.judge_message(F.col("question"), F.coalesce("answer", F.lit(prompts.NO_ANSWER)), F.col("question")).alias("message"))


@query("""SELECT conv_id AS run_id, count_if(says) > 0 AS success, min(t) FILTER (says) AS time_to_first_token_ms, count_if(says)::INTEGER AS chunks_received, coalesce(sum(length(text)) FILTER (says), 0)::INTEGER AS content_chars
FROM (SELECT *, (turn + 1) * 10::DOUBLE AS t, role = 'assistant' AND text <> '' AND turn < 6 AS says FROM conversations WHERE turn <= 6) GROUP BY conv_id""")
def q35_messages_fold(spark, d):
    said = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("text").alias("text")).alias("delta")))
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("data: "), said)).otherwise("data: [DONE]")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), ((F.col("turn") + 1) * 10).cast("double").alias("t_ms"), F.when(F.col("turn") == 6, 'data: {"type":"message_stop"}').otherwise(line).alias("line"))
    return latency.fold(turns, form="anthropic").select("run_id", "success", "time_to_first_token_ms", "chunks_received", "content_chars")


NONCE = "substr(md5(event_id::VARCHAR), 1, 8)"


@query(f"SELECT event_id, 'Give the gist of the text below in a single sentence of at most twenty words. [nonce:' || {NONCE} || ']' || chr(10) || chr(10) || event_type AS request FROM events")
def q36_nonce_request(spark, d):
    nonce = F.substring(F.md5(F.col("event_id").cast("string")), 1, 8)
    return table(spark, d, "events").select("event_id", prompts.summary_request(F.col("event_type"), nonce).alias("request"))


@query("""SELECT event_id, '{"model":"' || m || '",' || '"messages":[{"role":' || '"user",' || '"content":"' || event_type || '"}],"stream":true,' || CASE WHEN event_id % 3 = 0 THEN '"max_tokens":2000}' WHEN m = 'other' THEN '"max_tokens":2000}'
WHEN m = 'o3' THEN '"max_completion_tokens":2000,"reasoning_effort":"none"}' WHEN m = 'gpt-4' THEN '"max_completion_tokens":2000}' ELSE '"max_completion_tokens":2000,"reasoning_effort":"minimal"}' END AS body
FROM (SELECT *, list_extract(['gpt-5', 'o3', 'gpt-4', 'other'], (event_id % 4)::INTEGER + 1) AS m FROM events)""")
def q37_request_body(spark, d):
    model = F.element_at(F.array(*map(F.lit, ("gpt-5", "o3", "gpt-4", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", "event_type", model.alias("m"))
    vendor = F.when(F.col("m") == "other", "other").otherwise("openai")
    body = lambda native: prompts.request_body(F.col("m"), F.col("event_type"), vendor, prompts.reasoning_effort(F.col("m")), native=native)
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, body(True)).otherwise(body(False)).alias("body"))


@query("""SELECT 'm' || (user_id % 3)::VARCHAR AS model, event_type AS provider, count(*) AS runs, string_agg((event_id % 97)::VARCHAR, ',' ORDER BY event_id) AS chunks, count_if(event_id % 11 = 0)::BIGINT AS failed FROM events GROUP BY ALL""")
def q38_nested_runs(spark, d):
    bad = F.col("event_id") % 11 == 0
    runs = table(spark, d, "events").select(
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model"), F.col("event_type").alias("provider"), F.lit("short").alias("input_size"), F.lit(5).alias("input_tokens"), F.col("event_id").alias("run"), (~bad).alias("success"),
        F.when(bad, "bad").alias("error"), F.lit(200).alias("status_code"), *(F.lit(None).cast("double").alias(c) for c in ("time_to_first_byte_ms", "time_to_first_token_ms", "total_time_ms")), (F.col("event_id") % 97).cast("int").alias("chunks_received"), F.lit(0).alias("content_chars"), F.lit(None).cast("double").alias("chars_per_sec"),
    )
    n = sinks.nested_runs(runs)
    return n.select("model", "provider", F.size("runs").cast("long").alias("runs"), F.array_join(F.transform("runs", lambda r: r["chunks_received"].cast("string")), ",").alias("chunks"), F.size(F.filter("runs", lambda r: ~r["success"])).cast("long").alias("failed"))


OUTCOME = "CASE WHEN conv_id % 5 = 0 THEN 'HTTP 503: busy' WHEN conv_id % 5 = 1 THEN 'TimeoutError: slow' END"


@query(f"""SELECT conv_id AS run_id, any_value(e) IS NULL AND count_if(says) > 0 AS success, coalesce(any_value(e), CASE WHEN count_if(says) = 0 THEN 'no content in stream' END) AS error, CASE WHEN conv_id % 5 = 0 THEN 503 WHEN conv_id % 5 <> 1 THEN 200 END AS status_code,
CASE WHEN conv_id % 5 <> 0 OR preview THEN 5000.0::DOUBLE END AS total_time_ms, count_if(says AND live)::INTEGER AS chunks_received, CASE WHEN preview THEN coalesce(substr(string_agg(text, '' ORDER BY turn) FILTER (says AND live), 1, 100), '') END AS response_preview, preview
FROM (SELECT *, {OUTCOME} AS e FROM {LIVE}), (VALUES (true), (false)) AS p(preview) GROUP BY conv_id, preview""")
def q39_call_outcomes(spark, d):
    """Refused and broken calls, with the preview of the monitor's records and without it."""
    lines = _sse(spark, d)
    which = F.col("run_id") % 5
    totals = lines.select("run_id").distinct().select("run_id", F.when(which == 0, 503).when(which != 1, 200).alias("status_code"), F.lit(5000.0).alias("total_ms"), F.when(which == 0, "HTTP 503: busy").when(which == 1, "TimeoutError: slow").alias("call_error"))
    columns = ["run_id", "success", "error", "status_code", "total_time_ms", "chunks_received", "response_preview", "preview"]
    with_ = latency.fold(lines, totals, preview=True).withColumn("preview", F.lit(True)).select(*columns)
    bare = latency.fold(lines, totals).withColumns({"preview": F.lit(False), "response_preview": F.lit(None).cast("string")}).select(*columns)
    return with_.unionByName(bare)


@query("SELECT doc_id, coalesce(NULL, '') AS question_type, coalesce(lang, '') AS lang, NULL::VARCHAR AS explanation, NULL::BIGINT AS original_tokens FROM documents")
def q40_absent_columns(spark, d):
    docs = datasets.with_defaults(table(spark, d, "documents").select("doc_id", "lang"), "question_type string, lang string, explanation string, original_tokens bigint")
    return docs.select("doc_id", F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce("lang", F.lit("")).alias("lang"), "explanation", "original_tokens")
