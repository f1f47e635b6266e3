from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promptlattice.llm import bpe, crf, mixing, sigtree, toxicity
from promptlattice.llm.common import labelled_sample, materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(bpe.VOCABULARY), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_duplicates(texts):
    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets, up = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= sigtree.THRESHOLD * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), f"test-{name}")
        assert sorted(docs.columns) == sorted(COLUMNS)
        kept.append([r for r in docs.collect()])
        if name == "toxicity":
            model = toxicity.fit(*labelled_sample(before, labels, "toxic", toxicity.MAX_TRAIN))
            want = {i for i, t in texts.items() if model.score([t])[0] < toxicity.THRESHOLD}
        elif name == "quality_classifier":
            model = crf.fit(*labelled_sample(before, labels, "quality", crf.MAX_TRAIN))
            want = {i for i, t in texts.items() if model.quality([t])[0][0] >= crf.THRESHOLD}
        elif name == "ngram_jaccard_join":
            want = near_duplicates(texts)
        else:
            break
        assert {r["doc_id"] for r in kept[-1]} == want and all(texts[r["doc_id"]] == r["text"] for r in kept[-1])
        texts = {i: t for i, t in texts.items() if i in want}
    # the mixture's pieces are slices of the sources' streams, and every token of every document is among them
    streams = {}
    for r in sorted(kept[2], key=lambda r: hashlib.md5(f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()):
        streams.setdefault(r["source"], []).extend((r["doc_id"], w) for w in r["text"].split(" "))
    want = {}
    for s, stream in streams.items():
        for b in range(0, len(stream), mixing.LENGTH):
            part = stream[b : b + mixing.LENGTH]
            for i in dict.fromkeys(i for i, _ in part):
                want.setdefault((i, " ".join(w for j, w in part if j == i)), s)
    got = Counter((r["doc_id"], r["text"]) for r in kept[3])
    assert set(got) == set(want) and all(want[r["doc_id"], r["text"]] == r["source"] and r["n_chars"] == len(r["text"]) for r in kept[3])
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.where("not exact").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(encoded, ["doc_id"]).collect())
    assert back == got


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][2] == "ngram_jaccard_join"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_all_stages(spark):
    """Null texts and ids, repeated ids and rows, empty and very long texts, and columns with names that the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    first = some.orderBy("doc_id").first()
    long = "The river runs past the old town walls. " * 20_000
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "A line of quiet words stands here.", "en", None, 34), (900_001, None, "en", "web", 0), (900_002, "", "en", "web", 0), (900_003, long, "en", "web", len(long)), (900_004, " \n ", None, "web", 3), tuple(first), (first["doc_id"], "Another text of the same id, which says other things.", "en", "web", 50)], some.schema
    )
    clash = {c: F.lit("mine") for c in ("toxic", "crf_keep", "id", "h1", "token", "component", "class_id", "n", "start", "chunk", "k1", "a.b")}
    given = some.unionByName(odd).withColumns(clash)
    names = given.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = materialise(stage(spark, given, SF), f"odd-{name}")
        if name != "source_mixing":
            assert given.columns == names and given.where("toxic <> 'mine' or `a.b` <> 'mine'").count() == 0
        else:
            assert sorted(given.columns) == sorted(COLUMNS)
        if name == "toxicity":
            assert given.where("text is null").count() == 2 and given.where("doc_id is null").count() == 2
        elif name == "quality_classifier":
            assert given.where("text is null or trim(text) = ''").count() == 0 and given.where("doc_id = 900003").count() in (0, 1)
        elif name == "ngram_jaccard_join":
            assert given.where("doc_id is null").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, given, SF)
    assert last.where("not exact").count() == 0 and last.count() == given.count() > 0
