from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlattice.llm import mixing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_shares_follow_weights_and_few_records_move(spark):
    df = spark.range(20_000).withColumn("k", F.concat(F.lit("key"), "id"))
    got = sharding.assign_shards(df, "k", {"a": 1.0, "b": 1.0, "c": 2.0, "none": 0.0}, further={"after": {"a": 1.0, "b": 1.0, "c": 2.0, "d": 1.0}}).select("shard", "after").collect()
    n = Counter(r["shard"] for r in got)
    assert set(n) == {"a", "b", "c"} and abs(n["c"] / 20_000 - 0.5) < 0.02 and abs(n["a"] / 20_000 - 0.25) < 0.02
    moved = [r for r in got if r["shard"] != r["after"]]
    assert all(r["after"] == "d" for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02


def test_keys_nulls_ties_clashes(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "y"), ("a", "z"), ("", "w"), ("é" * 10_000, "v")], "k string, Shard string")
    got = sharding.assign_shards(df, "k").collect()
    assert got[0].__fields__ == ["k", "Shard", "shard_"]
    assert got[1]["shard_"] == got[2]["shard_"] and all(r["shard_"] in sharding.SHARDS for r in got)
    assert got[0]["shard_"] == sharding.assign_shards(spark.createDataFrame([("\\N",)], "k string"), "k").first()["shard"]
    assert sharding.assign_shards(df.where("false"), "k").count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "k", {"a": 0.0})
    assert sharding.assign_shards(df, "k", {"only": 1.0}).first()["shard_"] == "only"


def test_written_shards(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    sharding.write_sharded(df, "id", str(tmp_path / "s"), {"a": 1.0, "b": 1.0}, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and set(back.columns) == {"id", "v", "shard"}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_permutation_is_a_bijection():
    for n in (1, 2, 7, 100, 1000):
        i = np.arange(n, dtype=np.int64)
        got = mixing.permute(i, np.full(n, n), np.full(n, 268_435_455), np.full(n, 3))
        assert sorted(got) == list(range(n)) and (n < 100 or np.mean(got == i) < 0.1)


def order(i, t):
    """How a source's documents follow each other."""
    return hashlib.md5(f"{'\\N' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()


def test_sums_before(spark):
    rows = [(k, at // 4, at, (at * 7 + k) % 5) for k in range(3) for at in range(0, 30, k + 1)]
    got = mixing.sums_before(spark.createDataFrame(rows, "k long, top long, at long, v long"), ["k"], "top", "at", "v", "before").collect()
    assert len(got) == len(rows) and all(r["before"] == sum(v for k, _, at, v in rows if k == r["k"] and at < r["at"]) for r in got)


def test_blocks_rebuild_the_sources(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(n)), s) for i, (n, s) in enumerate([(5, "a"), (1, "a"), (30, "a"), (8, "b"), (3, None)])] + [(9, None, "a"), (10, "", "b"), (None, "null id", "b")]
    got = mixing.mix(docs(spark, rows), length=4, slots=8).collect()
    for source, want in {"a": [5, 1, 30], "b": [2, 8], "\\N": [3]}.items():
        blocks = {r["block"]: r for r in got if r["source"] == source}
        total = sum(want)
        assert sorted(blocks) == list(range(-(-total // 4))), source  # every block is drawn at least once
        assert sum(r["n_tokens"] for r in blocks.values()) == total and all(r["n_tokens"] == 4 for b, r in blocks.items() if b < len(blocks) - 1)
        text = "\n".join(blocks[b]["text"] for b in sorted(blocks)).replace("\n", " ")
        assert text == " ".join(t for i, t, s in sorted((r for r in rows if r[1]), key=lambda r: order(r[0], r[1])) if (s or "\\N") == source and t)
    assert sorted({(r["shard"], r["slot"]) for r in got}) == sorted((r["shard"], r["slot"]) for r in got)


def test_shares_follow_target_weights(spark):
    rows = [(i, " ".join(["x"] * 40), "a" if i % 4 else "b") for i in range(400)]
    got = Counter(r["source"] for r in mixing.mix(docs(spark, rows), {"a": 1.0, "b": 3.0, "absent": 5.0}, length=10, total=4000, slots=100).collect())
    assert abs(got["b"] / 4000 - 0.75) < 0.03 and sum(got.values()) == 4000


def test_no_small_source_is_missing(spark):
    rows = [(0, " ".join(f"h{k}" for k in range(2000)), "hot")] + [(i, f"w{i}", f"s{i}") for i in range(1, 401)]
    got = mixing.mixed_documents(docs(spark, rows), length=4).select("source").distinct().count()
    assert got == 401
    # a start that is short is added to
    blocks = {"a": 1, "b": 50}
    total = mixing.slots_enough(spark, blocks, {"a": 1e-3, "b": 0.999}, slots=8)
    drawn = Counter(r["source"] for r in mixing.draw_slots(spark, blocks, {"a": 1e-3, "b": 0.999}, total, 8).select("source", "block").distinct().collect())
    assert drawn == blocks
    with pytest.raises(ValueError):
        mixing.slots_enough(spark, blocks, {"a": 1e-12, "b": 1 - 1e-12})


def test_mixing_edges(spark):
    d = docs(spark, [(1, "a b", "s")])
    assert mixing.mix(d.where("false")).count() == 0 and mixing.mix(docs(spark, [(1, None, "s"), (2, "", "s")])).count() == 0
    assert mixing.mix(d, {"s": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d, {"s": -1.0})
    twice = docs(spark, [(1, "a b", "s"), (1, "a b", "s")]).withColumn("n", F.lit(1)).withColumn("block", F.lit("x"))
    got = mixing.mix(twice, length=8)
    assert got.first()["doc_ids"] == [1, 1] and got.first()["text"] == "a b\na b"
    out = mixing.mixed_documents(docs(spark, [(1, "a b", None)]), length=8)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"} and out.first()["source"] is None


def test_long_texts_clashing_names_and_a_hot_source(spark):
    rows = [(1, "w " * 50_000 + "end", "hot"), (None, "x y", "hot"), (None, "x y", "hot"), (2, "z", "b")] + [(10 + i, "a b c", "hot") for i in range(300)]
    d = docs(spark, rows).withColumns({c: F.lit("mine") for c in ("n", "k1", "k2", "mark", "top", "chunk", "base", "start", "block", "a.b")})
    got = mixing.mix(d, length=1000).collect()
    assert {r["source"] for r in got} == {"hot", "b"}
    hot = {r["block"]: r["n_tokens"] for r in got if r["source"] == "hot"}
    assert sum(hot.values()) == 50_001 + 4 + 900 and sorted(hot) == list(range(51))
    assert mixing.mixed_documents(d).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.mix(d.where("false")).count() == 0
