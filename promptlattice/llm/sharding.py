"""Sharding by weighted rendezvous hashing.

A record goes to the shard with the greatest score w / -ln(u), where u in (0, 1) is a hash of the record's stable key and the shard's name.
Shares follow the weights; a new shard takes only what it wins, and a lost shard's records alone move elsewhere. All is one
JVM expression over a row: no shuffle, no Python, no state, so every reader computes the same shard.

The hash is 64 bits of the key's MD5, then for each shard a multiply-and-shift mix of both halves with 31-bit constants, which SQL engines without
overflowing integers can compute too. Every step uses the value before it once, so that a score is a chain, not a tree, and each shard's score is computed once for all layouts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extra_column

#: Shards of the production layout and their weights: the last four have twice the capacity of the others.
SHARDS: dict[str, float] = {f"shard-{i:02d}": 2.0 if i >= 12 else 1.0 for i in range(16)}
ADDED = {"shard-16": 1.0}
NULL_KEY = "\\N"
M1, M2 = 0x45D9F3B3, 0x2C1B3C6D
TWO32 = 1 << 32


def _seeds(shard: str) -> tuple[int, int]:
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _score(high: Column, low: Column, shard: str) -> Column:
    """ln(u) of a record and a shard. x + (x >> k) is x * (2**k + 1) >> k."""
    a, b = _seeds(shard)

    def fold(x: Column, k: int) -> Column:
        return F.shiftright(x * _long((1 << k) + 1), k)

    x = F.pmod(fold(high.bitwiseXOR(_long(a)), 16) * _long(M1), _long(TWO32))
    x = F.pmod(fold(x, 15).bitwiseXOR(low).bitwiseXOR(_long(b)) * _long(M2), _long(TWO32))
    x = F.pmod(fold(x, 13) * _long(M1), _long(TWO32))
    x = F.pmod(fold(x, 16), _long(TWO32))
    return F.ln((x + F.lit(0.5)) / F.lit(float(TWO32)))


def _half(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("long")


def _live(shards: Mapping[str, float]) -> dict[str, float]:
    live = {s: float(w) for s, w in sorted(shards.items()) if w > 0}
    if not live:
        raise ValueError("no shard of positive weight")
    if any(w != w or w == float("inf") for w in live.values()):
        raise ValueError("a weight is not finite")
    return live


def _winner(scores: Mapping[str, Column], live: Mapping[str, float]) -> Column:
    """The name of the shard of the greatest ln(u) / w, that is of w / -ln(u); of equal ones the least name."""
    if len(live) == 1:
        return F.lit(next(iter(live)))
    # the first of the greatest: structs compare by score, then by the position counted down
    best = F.greatest(*(F.struct((scores[s] / F.lit(w)).alias("s"), F.lit(len(live) - i).alias("r")) for i, (s, w) in enumerate(live.items())))
    return F.element_at(F.array(*map(F.lit, live)), F.lit(len(live) + 1) - best["r"])


def assign_shards(df: DataFrame, key: str, shards: Mapping[str, float] = SHARDS, column: str = "shard", further: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """df with the shard of each row in column; further has more columns and their layouts, on the same hash of the key.

    Keys are compared as strings. Rows of the same key share a shard; a null key counts as the key \\N. A shard whose weight is 0 gets nothing. If df has a column of a
    wanted name, in any case, the new one gets underscores until it is free. No rows give no rows."""
    layouts = {column: _live(shards), **{c: _live(x) for c, x in (further or {}).items()}}
    hashes, scores = extra_column(df, "__hash"), extra_column(df, "__scores")
    names = sorted({s for live in layouts.values() for s in live})
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(NULL_KEY))
    out = df.withColumn(hashes, F.struct(_half(k, 1).alias("high"), _half(k, 9).alias("low")))
    out = out.withColumn(scores, F.struct(*(_score(F.col(hashes)["high"], F.col(hashes)["low"], s).alias(f"s{i}") for i, s in enumerate(names))))
    picks, free = [], df
    for c, live in layouts.items():
        c = extra_column(free, c)
        picks.append(_winner({s: F.col(scores)[f"s{i}"] for i, s in enumerate(names)}, live).alias(c))
        free = free.withColumn(c, F.lit(""))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *picks)


def write_sharded(df: DataFrame, key: str, path: str, shards: Mapping[str, float] = SHARDS, files: int = 1) -> None:
    """Writes df partitioned by shard. files splits each shard's rows by their key's hash, so that a large shard is many tasks."""
    named = assign_shards(df, key, shards)
    column = next(c for c in named.columns if c not in df.columns)
    named.repartition(len(shards) * files, F.col(f"`{column}`"), F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(files))).write.partitionBy(column).parquet(path)


def sql_shard(key: str, table: str, columns: Mapping[str, Mapping[str, float]], keep: str) -> str:
    """The same assignment in SQL, for engines with md5, xor and 64-bit integers."""

    def score(s: str, w: float) -> str:
        a, b = _seeds(s)
        return f"SELECT k, h, l, '{s}' AS s, {float(w)!r}::DOUBLE AS w, (((xor(h, {a}::BIGINT) * {(1 << 16) + 1}) >> 16) * {M1}) % {TWO32} AS x, {b}::BIGINT AS b FROM keys"

    every = {s: w for layout in columns.values() for s, w in layout.items()}
    parts = " UNION ALL ".join(score(s, w) for s, w in sorted(every.items()) if w > 0)
    picks = []
    for c, layout in columns.items():
        inside = ", ".join(f"'{s}'" for s, w in layout.items() if w > 0)
        picks.append(f"arg_max(s, (score, -rank)) FILTER (s IN ({inside})) AS {c}")
    return f"""
WITH keys AS (SELECT k, ('0x' || substr(md5(k), 1, 8))::BIGINT AS h, ('0x' || substr(md5(k), 9, 8))::BIGINT AS l FROM (SELECT DISTINCT coalesce({key}::VARCHAR, '\\N') AS k FROM {table})),
a AS ({parts}),
b AS (SELECT k, s, w, (xor(xor((x * {(1 << 15) + 1}) >> 15, l), b) * {M2}) % {TWO32} AS x FROM a),
c AS (SELECT k, s, w, (((x * {(1 << 13) + 1}) >> 13) * {M1}) % {TWO32} AS x FROM b),
d AS (SELECT k, s, ln((((x * {(1 << 16) + 1}) >> 16) % {TWO32} + 0.5::DOUBLE) / {float(TWO32)!r}::DOUBLE) / w AS score, dense_rank() OVER (ORDER BY s) AS rank FROM c),
e AS (SELECT k, {", ".join(picks)} FROM d GROUP BY k)
SELECT {keep}, e.* EXCLUDE (k) FROM {table} t JOIN e ON e.k = coalesce(t.{key}::VARCHAR, '\\N')"""
