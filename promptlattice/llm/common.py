"""Helpers shared by the corpus operators: vectorised text hashing, lineage cuts, graph components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset, as in tests) a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jdir.get() if jdir.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster's executors need a folder that all of them share")
        at = tempfile.mkdtemp(prefix="promptlattice-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and returns the written table: its lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _word_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.bool_)
    table[[c for c in range(0x110000) if chr(c).isalnum() or c == 0x5F]] = True
    return table


_TABLES: dict[str, np.ndarray] = {}


def is_word_char() -> np.ndarray:
    """By code point: letters, digits and underscore, as Python's \\w."""
    if "word" not in _TABLES:
        _TABLES["word"] = _word_table()
    return _TABLES["word"]


def char_hash() -> np.ndarray:
    if "char" not in _TABLES:
        _TABLES["char"] = mix64(np.arange(0x110000, dtype=U64) + U64(0x9E3779B97F4A7C15))
    return _TABLES["char"]


def powers(n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo 2**64."""
    have = _TABLES.get("powers", np.ones(1, dtype=U64))
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * U64(0x9E3779B97F4A7C55))])
    _TABLES["powers"] = have
    return have[:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in one array, each text followed by a newline, and where each starts (one more entry than texts)."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def words_in(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, length) of each \\w+ word among code points that end with a newline."""
    word = is_word_char()[cps]
    edge = np.diff(word.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the newline ends the last word
    if not len(begin):
        return np.empty(0, dtype=U64), begin, end
    length = end - begin
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    h = char_hash()[cps[word]] * powers(int(length.max()))[at]
    return mix64(np.add.reduceat(h, np.cumsum(length) - length)), begin, length


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased \\w+ words of all texts, and each text's offsets into them."""
    cps, starts = code_points([t.lower() for t in texts])
    h, begin, _ = words_in(cps)
    return h, np.searchsorted(begin, starts)


def word_hash(word: str) -> int:
    return int(word_hashes([word])[0][0])


def chunks(texts: list, chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of successive texts of about so many characters in all; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield slice(at, i)
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


def text_parts(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts, of about so many bytes each, so that few texts at a time are Python's; a longer text is a slice of its own."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end


def with_mapped(d: DataFrame, run, added: str) -> DataFrame:
    """d's columns but the last, which run(batches) replaces by the added ones. Columns are told apart by place, as such a map can't take names with dots."""
    kept, new = d.schema.fields[:-1], d.sparkSession.createDataFrame([], added).schema.fields
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + new)
    return d.toDF(*(f"c{i}" for i in range(len(d.columns)))).mapInArrow(run, schema).toDF(*(f.name for f in kept), *(f.name for f in new))


def extra_column(df: DataFrame, name: str) -> str:
    """name, or with underscores added until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, by which each point names the first point of its set, after the sets of i[k] and j[k] are joined for every k."""
    while True:
        a, b = label[i], label[j]
        if np.array_equal(a, b):
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of the undirected graph; component is the least id in it.

    Alternating large-star and small-star steps: O(log**2 n) rounds, every row two longs. A node's least neighbour is an aggregate, combined before the shuffle, and is
    joined back, so that a node of very many edges is no task of its own. Each round ends in a written table. Self-loops and nulls are dropped, repeated edges count once; no edges give an empty result."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, now = None, state(e)
    while now[0] and now != seen:  # stars around their least nodes stay as they are
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = materialise(small.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct(), "edges")
        seen, now = now, state(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most `most` labelled documents, those of the least hash of their id, on the driver.

    Null ids, texts and labels are left out. Of several labels of an id the largest counts, of several texts the least."""
    name = F.col(f"`{label_col}`").cast("int")
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), name.alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    some = marked.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    rows = texts.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).collect()
    rows.sort(key=lambda r: r["id"])
    return [r["text"] for r in rows], [int(r["label"] > 0) for r in rows]


_HELD: dict = {}


def held(key, build):
    """What build gives, kept in this Python worker for later tasks that ask for the same key. A worker keeps one such thing."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Frees what the worker holds, and gives back what its allocators keep of earlier tasks. Workers serve all operators of a session in turn, so a task calls this first."""
    if _HELD:
        _HELD.clear()
        gc.enable()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
