"""The corpus operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, covertree, crf, mixing, sharding, sigtree, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard, and its shard once one more is added."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign_shards(docs, "doc_id", sharding.SHARDS, "shard", {"shard_after": {**sharding.SHARDS, **sharding.ADDED}})


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's class of near duplicates and its number of links."""
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: The tables of vectors have no pair at the production threshold in their small form: the same join at one where they have some.
LOOSE = 0.4


def near_vectors_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 at a cosine of LOOSE."""
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"), LOOSE)


def op3_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back in byte ranges, several a file."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), 1 << 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates and its number of links."""
    return sigtree.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def near_documents_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 at a Jaccard of LOOSE."""
    return sigtree.ngram_jaccard_join(_table(spark, sf_dir, "documents"), threshold=LOOSE)


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), ["doc_id"])


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.classify(docs, crf.train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours, among all vectors, of those whose id is divisible by EVERY."""
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), ask=F.col("vec_id") % ann.EVERY == 0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rendezvous_sharding": op1_rendezvous_sharding,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_warc_reader": op3_warc_reader,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_bpe_encoding": op6_bpe_encoding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_line_quality": op8_line_quality,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_source_mixing": op10_source_mixing,
    "near_vectors_loose": near_vectors_loose,
    "near_documents_loose": near_documents_loose,
}

ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": covertree.sql_near_duplicates(),
    "op9_nearest_neighbours": ann.sql_neighbours(),
    "near_vectors_loose": covertree.sql_near_duplicates(LOOSE),
    "op3_warc_reader": "SELECT page_id, url, html, octet_length(encode(html))::BIGINT AS n_bytes FROM pages",
    "op10_source_mixing": mixing.sql_mix(),
    "op1_rendezvous_sharding": sharding.sql_shard("doc_id", "documents", {"shard": sharding.SHARDS, "shard_after": {**sharding.SHARDS, **sharding.ADDED}}, "t.doc_id, t.source"),
    "op5_ngram_jaccard_join": sigtree.sql_ngram_jaccard_join(),
    "near_documents_loose": sigtree.sql_ngram_jaccard_join(LOOSE),
}
