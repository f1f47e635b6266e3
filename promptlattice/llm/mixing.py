"""Mixing sources to target weights.

1. Packing. A document's tokens are what stands between single spaces, so joining them with spaces restores the text (words, not a model's tokens: the lengths of blocks are in words). Each source's
   documents, in order of a hash of id and text, form one stream of tokens, which is cut into blocks of a fixed length; only a source's last block can be shorter.
   Positions come from three levels of sums (slices of the hash's values, finer slices, documents), so no task sees a whole source, whatever the ids are like.
2. Drawing. Every slot of every output shard draws a source by a hash of (seed, shard, slot) against the cumulative target weights: the counts of a
   shard are multinomial, and any task can compute them. A slot's index among its source's slots is the sum of the counts
   in the shards before, plus its rank in its own.
3. Mapping. Index i of a source of n blocks is in epoch i div n and takes block p(i mod n), where p is the source's and epoch's own
   pseudorandom permutation: swap-or-not rounds, a bijection of 0..n-1 for any n that needs no table. So a source is used up before any of its blocks comes again.
4. Joining. Blocks and slots meet by (source, block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, text_parts

LENGTH, SLOTS, SEED, ROUNDS = 512, 256, 17, 24
#: Documents in a fine slice, and bits of the number of coarse ones; shards in a coarse slice.
CHUNK, TOP_BITS, SHARDS_EACH = 1024, 12, 4096
#: Target weights are the sources' shares to this power, normalised: below 1 evens them out.
POWER = 0.9
NULL_SOURCE = "\\N"
P = (1 << 31) - 1
BROADCAST_ROWS = 200_000


def _constant(name: str, r: int) -> int:
    return 1 + int.from_bytes(hashlib.md5(f"{name}{r}".encode()).digest()[:4], "big") % (P - 1)


def _tokens(text: Column) -> Column:
    # a space is one byte wherever it stands, so bytes are counted rather than characters
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def target_weights(blocks: Mapping[str, int], weights: Mapping[str, float] | None = None, power: float = POWER) -> dict[str, float]:
    """The weights of the sources that have blocks, in order of name, adding up to 1: the given ones, else shares to a power. A source that weights leaves out gets 0."""
    raw = {s: float(weights.get(s, 0.0)) if weights is not None else (n / sum(blocks.values())) ** power for s, n in sorted(blocks.items())}
    if any(w < 0 for w in raw.values()):
        raise ValueError("a weight is negative")
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total else {}


def slots_for(blocks: Mapping[str, int], weights: Mapping[str, float]) -> int:
    """The number of slots at which a source of n blocks and positive weight has n + 4 sqrt(n) expected draws at least. The SQL has the same.

    For large n, draws four standard deviations low leave some blocks out. For small n the draws' own deviation, the root of their mean, is larger: by Poisson
    a source that sets the number is not drawn at all with probability 0.67% for one block, and drawn less than n times with 0.41% for 2, 0.23% for 4, 0.07% for 16, 0.02% for 100 blocks. See slots_enough."""
    return max((ceil((n + 4 * sqrt(n)) / weights[s]) for s, n in blocks.items() if weights.get(s, 0) > 0), default=0)


def slots_enough(spark, blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = SLOTS, seed: int = SEED) -> int:
    """A number of slots at which each source of positive weight is used up at least once, for certain: the draws are counted, and slots are added until none is short.

    It starts where a mean of draws less four of its own deviations is n. A weight under 2**-32 that no hash can draw is an error."""
    live = _live(blocks, weights)
    edges = [0, *_bounds(live), 1 << 32]
    if any(a >= b for (_, _, _), a, b in zip(live, edges, edges[1:])):
        raise ValueError("a weight is too small to be drawn")
    short, total = [(n, w) for _, n, w in live], 0
    while short:
        total += max(ceil((2 + sqrt(4 + n)) ** 2 / w) for n, w in short)
        have = {r["k"]: r["count"] for r in _drawn(spark, live, total, slots, seed).groupBy("k").count().collect()}
        short = [(n - have.get(k, 0), w) for k, (_, n, w) in enumerate(live) if have.get(k, 0) < n]
    return total


def permute(i: np.ndarray, n: np.ndarray, seed: np.ndarray, epoch: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The places of i under the permutations of 0..n-1 that seed and epoch name. All are 64-bit."""
    x = i.copy()
    for r in range(rounds):
        a, b, c, d, e = (_constant(k, r) for k in "abcde")
        partner = ((seed * a + epoch * b + c) % P % n - x) % n
        bit = ((np.maximum(x, partner) % P * d + (seed + epoch * e) % P) % P >> 12) % 2
        x = np.where(bit == 1, partner, x)
    return x


def _permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, slot, source, epoch, i, blocks, key) -> (shard, slot, source, epoch, block)."""
    for batch in batches:
        epoch, i, n, key = (c.to_numpy() for c in batch.columns[3:])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(permute(i, n, key, epoch))], names=["shard", "slot", "source", "epoch", "block"])


def sums_before(df: DataFrame, by: list[str], top: str, at: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of the same by that come before, in order of top, then at; (by, top, at) is unique. Coarse sums first, so that a task has one top's rows, or the tops."""
    up = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*by, top).agg(F.sum(value).alias("__all")).select(*by, top, F.coalesce(F.sum("__all").over(up(by, top)), F.lit(0)).alias("__base"))
    inner = df.withColumn("__inner", F.coalesce(F.sum(value).over(up([*by, top], at)), F.lit(0)))
    return inner.join(tops, [*by, top]).withColumn(name, F.col("__base") + F.col("__inner")).drop("__base", "__inner")


def _cut(length: int):
    """(source, doc_id, lang, start, text) -> pieces (source, block, position, id, lang, n, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (part for whole in batches for part, _ in text_parts(whole, 4)):
            rows: list[tuple] = []
            size = 0
            for source, doc, lang, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.split(" ")
                at = 0
                while at < len(tokens):
                    block, within = divmod(start + at, length)
                    part = tokens[at : at + length - within]
                    piece = " ".join(part)
                    rows.append((source, block, start + at, doc, lang, len(part), piece))
                    size += len(piece)
                    at += len(part)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


_PIECE = pa.schema([("source", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("piece", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)


def _sliced(docs: DataFrame) -> DataFrame:
    """The documents that have tokens, as source, doc_id, lang, text, n, with the hash that orders them (k1, k2) and its coarse and fine slice."""
    d = docs.select(F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    bits = max(0, ceil(log2(max(1, docs.count()) / CHUNK)))
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit(NULL_SOURCE)), F.md5("text")))
    half = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("long")
    d = d.withColumn("n", _tokens(F.col("text"))).where("n > 0").withColumn("mark", mark).select("source", "doc_id", "lang", "text", "n", half(1).alias("k1"), half(16).alias("k2"))
    chunk = F.shiftright("k1", 60 - bits)
    return d.withColumns({"chunk": chunk, "top": F.shiftright(chunk, max(0, bits - TOP_BITS))})


def _starts(d: DataFrame) -> DataFrame:
    """(source, top, chunk, all, base), written: the tokens of each fine slice of each source, and of those before it."""
    return materialise(sums_before(d.groupBy("source", "top", "chunk").agg(F.sum("n").alias("all")), ["source"], "top", "chunk", "all", "base"), "chunks")


def _pieces(d: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    few = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    within = Window.partitionBy("source", "top", "chunk").orderBy("k1", "k2", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(few, ["source", "top", "chunk"])
    return placed.select("source", "doc_id", "lang", (F.col("base") + F.col("inside")).alias("start"), "text").mapInArrow(_cut(length), "source string, block long, position long, doc_id long, lang string, n long, piece string")


def _block_counts(starts: DataFrame, length: int) -> dict[str, int]:
    """source -> its number of blocks. One row a source comes to the driver."""
    return {r["source"]: -(-r["n"] // length) for r in starts.groupBy("source").agg(F.sum("all").alias("n")).collect()}


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packs docs (doc_id, text, lang, source): the pieces of documents in each block of each source, as source, block, position, doc_id, lang, n, piece."""
    d = _sliced(docs)
    return _pieces(d, _starts(d), length)


def _live(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, float]]:
    return [(s, int(blocks[s]), w) for s, w in sorted(weights.items()) if w > 0 and blocks.get(s, 0) > 0]


def _bounds(live: list[tuple[str, int, float]]) -> list[int]:
    return [int(min(1.0, x) * (1 << 32)) for x in np.cumsum([w for _, _, w in live])[:-1]] if live else []


def _drawn(spark, live: list[tuple[str, int, float]], total: int, slots: int, seed: int) -> DataFrame:
    """(shard, slot, k): the number in live of each slot's source. More slots leave the first ones' as they are."""
    bounds = _bounds(live)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    k = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= u)) if bounds else F.lit(0)
    return spark.range(total if live else 0).select(F.floor(F.col("id") / slots).cast("long").alias("shard"), F.pmod("id", F.lit(slots)).cast("long").alias("slot")).withColumn("k", k)


def draw_slots(spark, blocks: Mapping[str, int], weights: Mapping[str, float], total: int, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, epoch, block) of each of total slots, slots a shard."""
    live = _live(blocks, weights)
    table = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(live)], "k int, source string, blocks long")
    drawn = _drawn(spark, live, total, slots, seed)
    counts = drawn.groupBy("shard", "k").agg(F.count("*").alias("count")).withColumn("top", F.floor(F.col("shard") / SHARDS_EACH))
    counts = sums_before(counts, ["k"], "top", "shard", "count", "before").select("shard", "k", "before")
    index = F.col("before") + F.row_number().over(Window.partitionBy("shard", "k").orderBy("slot")) - 1
    indexed = drawn.join(counts, ["shard", "k"]).withColumn("i", index.cast("long")).join(F.broadcast(table), "k")
    key = F.conv(F.substring(F.md5("source"), 1, 7), 16, 10).cast("long")
    indexed = indexed.select("shard", "slot", "source", F.floor(F.col("i") / F.col("blocks")).cast("long").alias("epoch"), F.pmod("i", "blocks").alias("i"), "blocks", key.alias("key"))
    return indexed.mapInArrow(_permuted, "shard long, slot long, source string, epoch long, block long")


def _plan(docs: DataFrame, weights: Mapping[str, float] | None, power: float, length: int, total: int | None, slots: int, seed: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots)."""
    d = _sliced(docs)
    starts = _starts(d)
    blocks = _block_counts(starts, length)
    target = target_weights(blocks, weights, power)
    if total is None:
        total = slots_enough(docs.sparkSession, blocks, target, slots, seed) if whole else slots_for(blocks, target)
    return _pieces(d, starts, length), draw_slots(docs.sparkSession, blocks, target, total, slots, seed)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, length: int = LENGTH, total: int | None = None, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_ids, text): the block of each slot; doc_ids and the text's parts, joined by new lines, in the block's order.

    total slots in all; without it, as many as slots_for says, which use up every source of positive weight but for the rates given there; slots_enough gives a total without misses. A null source is the source \\\\N. Null and empty texts have no tokens and
    take no part; neither do sources of weight 0. Rows that repeat an id are all packed; rows equal in id and text follow each other. Ids are whole numbers, or strings of them (others raise). Other columns are ignored. No tokens give no rows."""
    packed, plan = _plan(docs, weights, power, length, total, slots, seed)
    part = F.struct("position", "doc_id", "n", "piece")
    blocks = packed.groupBy("source", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "\n")
    blocks = blocks.select("source", "block", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_tokens"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), text.alias("text"))
    return blocks.join(plan, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "doc_ids", "text")


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, length: int = LENGTH, total: int | None = None, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """The mixture as documents: one row for each document's piece in each slot's block, with doc_id, text, lang, source and n_chars.

    Without total, every source of positive weight is used up at least once (see slots_enough). A document that lies in two blocks gives two rows, one of a block that is drawn twice two equal rows. Nulls and ties as in mix."""
    packed, plan = _plan(docs, weights, power, length, total, slots, seed, whole=True)
    source = F.when(F.col("source") == NULL_SOURCE, F.lit(None)).otherwise(F.col("source")).alias("source")
    return packed.join(plan.select("source", "block"), ["source", "block"]).select("doc_id", F.col("piece").alias("text"), "lang", source, F.length("piece").cast("long").alias("n_chars"))


def sql_mix(power: float = POWER, length: int = LENGTH, slots: int = SLOTS, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """mix of documents with its default weights and total, in SQL."""
    rounds_sql = []
    for r in range(rounds):
        a, b, c, d, e = (_constant(x, r) for x in "abcde")
        turn = f"(((key * {a} + epoch * {b} + {c}) % {P}) % blocks)"
        partner = f"(({turn} - x + blocks) % blocks)"
        bit = f"(((((greatest(x, {partner}) % {P}) * {d} + (key + epoch * {e}) % {P}) % {P}) >> 12) % 2)"
        rounds_sql.append(f"r{r + 1} AS (SELECT * REPLACE (CASE WHEN {bit} = 1 THEN {partner} ELSE x END AS x) FROM r{r})")
    return f"""
WITH d AS (SELECT coalesce(source, '\\N') AS source, doc_id, text, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents WHERE text <> ''),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || md5(text)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
q AS (SELECT *, unnest(range(start // {length}, (start + n - 1) // {length} + 1)) AS block FROM p),
s AS (SELECT source, block, doc_id, greatest(start, block * {length}) AS position, string_split(text, ' ')[greatest(block * {length} - start, 0) + 1 : least((block + 1) * {length} - start, n)] AS t FROM q),
b AS (SELECT source, block, sum(len(t))::BIGINT AS n_tokens, list(doc_id ORDER BY position) AS doc_ids, string_agg(array_to_string(t, ' '), chr(10) ORDER BY position) AS text FROM s GROUP BY source, block),
c AS (SELECT source, count(*) AS blocks FROM b GROUP BY source),
w AS (SELECT *, pow(blocks / (sum(blocks) OVER ()), {power}) AS raw FROM c),
v AS (SELECT *, raw / sum(raw) OVER () AS w, row_number() OVER (ORDER BY source) - 1 AS k FROM w),
g AS (SELECT *, floor(least(1.0, sum(w) OVER (ORDER BY source)) * {1 << 32})::BIGINT AS bound, (SELECT max(ceil((blocks + 4 * sqrt(blocks)) / w)) FROM v)::BIGINT AS total, count(*) OVER () AS sources FROM v),
z AS (SELECT t // {slots} AS shard, t % {slots} AS slot FROM (SELECT unnest(range((SELECT max(total) FROM g))) AS t)),
u AS (SELECT *, ('0x' || substr(md5('{seed}:' || shard || ':' || slot), 1, 8))::BIGINT AS u FROM z),
y AS (SELECT shard, slot, (SELECT count(*) FROM g WHERE k < sources - 1 AND bound <= u.u) AS k FROM u),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shard, slot) - 1 AS idx FROM y),
r0 AS (SELECT shard, slot, source, blocks, idx // blocks AS epoch, idx % blocks AS x, ('0x' || substr(md5(source), 1, 7))::BIGINT AS key FROM x JOIN g USING (k)),
{", ".join(rounds_sql)}
SELECT r.shard, r.slot, r.source, r.epoch, b.block, b.n_tokens, b.doc_ids, b.text FROM r{rounds} r JOIN b ON b.source = r.source AND b.block = r.x"""
