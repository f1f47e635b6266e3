from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from promptlattice.llm import sigtree
from promptlattice.llm.common import components, join_labels

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text, n=3):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=sigtree.THRESHOLD):
    sets = [(i, grams(t)) for i, t in rows if i is not None and t is not None]
    out = {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i != j and a and b and (jac := len(a & b) / len(a | b)) >= threshold:
                key = (min(i, j), max(i, j))
                out[key] = max(out.get(key, 0), jac)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for c in range(rng.choice((1, 1, 2, 3, 12))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25)) if c else 0):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, " ".join(copy)))
            at += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_tree_join_is_exact():
    sets = [np.unique(np.array([hash(g) & (2**63 - 1) for g in grams(t)], dtype=np.uint64)) for _, t in corpus(8)]
    sets = [s for s in sets if len(s)]
    for threshold in (0.2, 0.6, 0.9, 1.0):
        i, j, jac = sigtree.tree_join(sets, threshold)
        got = {(min(a, b), max(a, b)): round(float(c), 9) for a, b, c in zip(i, j, jac)}
        want = {}
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                n = len(np.intersect1d(sets[a], sets[b]))
                if (q := n / (len(sets[a]) + len(sets[b]) - n)) >= threshold:
                    want[a, b] = round(q, 9)
        assert got == want and len(i) == len(got)


def test_postings_test_few_pairs_and_lose_none(monkeypatch):
    rng, tested, within = np.random.RandomState(5), [], sigtree._may_match
    monkeypatch.setattr(sigtree, "_may_match", lambda x, y, a, b, t: tested.append(len(a)) or within(x, y, a, b, t))
    lines = rng.randint(0, 2**62, (3000, 8)).astype(np.uint64)
    # three of many lines, as short documents have them, and side by side some that share two
    sets = [np.unique(lines[np.append(rng.randint(0, 3000, 2), i % 700)]) for i in range(1400)] + [np.unique(lines[[k, k + 1, k + j]].ravel()[j - 2 :]) for k in range(20) for j in (2, 2, 3, 4)]
    sets += [np.unique(lines[k : k + 3].ravel()[c:]) for k in range(20) for c in (1, 3)]
    side = rng.randint(0, 3, len(sets))
    pairs = lambda x: sorted(zip(np.minimum(x[0], x[1]).tolist(), np.maximum(x[0], x[1]).tolist()))
    for sides in (None, side):
        for threshold in (0.2, 0.4, 0.6, 1.0):
            tested.clear()
            got, most = pairs(sigtree.tree_join(sets, threshold, sides)), sum(tested)
            with monkeypatch.context() as m:
                m.setattr(sigtree, "MANY", 10**9)
                want = pairs(sigtree.tree_join(sets, threshold))
            assert got == [(a, b) for a, b in want if sides is None or side[a] != side[b] or not side[a]] and most < 0.05 * len(sets) ** 2
            assert len(want) >= 20
    alike = [np.unique(np.append(lines[:20], rng.randint(0, 2**62, 9).astype(np.uint64))) for _ in range(600)]
    order, levels = sigtree.build_tree(alike)
    assert sigtree._postings([alike[i] for i in order], levels, None, 0.4) is None
    assert len(sigtree.tree_join(alike, 0.4)[0]) == 600 * 599 // 2


def brute_classes(rows, threshold=sigtree.THRESHOLD):
    ids = sorted({i for i, _ in rows if i is not None})
    up, links = {i: i for i in ids}, {i: 0 for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute(rows, threshold):
        links[a] += 1
        links[b] += 1
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in ids}


def classes(df):
    rows = df.collect()
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in rows}
    assert len(got) == len(rows)
    return got


ODD = [(1000, "Ein Satz."), (1001, "ein satz"), (1002, ""), (1003, None), (None, "null id"), (1004, "!!!"), (1005, "ein, Satz!")]


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6, 0.9, 1.0])
def test_join_is_exact(spark, monkeypatch, threshold):
    monkeypatch.setattr(sigtree, "RANGE_BYTES", 4000)  # several ranges
    monkeypatch.setattr(sigtree, "SORTED", 500)
    rows = corpus() + ODD
    assert classes(sigtree.ngram_jaccard_join(frame(spark, rows), threshold=threshold, block=2)) == brute_classes(rows, threshold)
    if threshold != 0.4:
        return
    copies, pairs = sigtree.near_pairs(frame(spark, rows), threshold=threshold)
    rep = {r["id"]: r["rep"] for r in copies.collect()}
    want = {k: v for k, v in brute(rows, threshold).items() if rep[k[0]] == k[0] and rep[k[1]] == k[1]}
    got = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    assert set(got) == set(want) and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_cut_hashes_lose_no_pair(monkeypatch):
    # n-grams, of one document too, that become one when their hashes are cut: here very many of them
    whole = sigtree.gram_sets

    def poor(texts, n):
        return [np.unique((s & np.uint64(0xFFF)) | (np.arange(len(s), dtype=np.uint64) % np.uint64(7)) << np.uint64(40)) for s in whole(texts, n)]

    sets = poor([t for _, t in corpus()], 3)
    assert sum(len(s) - len(np.unique(s & np.uint64(0xFFFFFFFF))) for s in sets) > 0
    monkeypatch.setattr(sigtree, "gram_sets", poor)
    monkeypatch.setattr(sigtree, "GROUP", 1000)
    monkeypatch.setattr(sigtree, "SORTED", 700)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(corpus()))), pa.array([t for _, t in corpus()])], names=["id", "text"])
    rows = list(sigtree._prefixes(0.5)(sigtree._shared(1)(sigtree._spread(3, 1)([batch]))))
    table = pa.Table.from_batches(rows).to_pylist()
    h1 = {r["id"]: r["h1"] for r in table if r["token"] is None}
    assert sorted(h1) == list(range(len(corpus())))
    meet = {}
    for r in table:
        if r["token"] is not None:
            meet.setdefault(r["h1"], set()).add(r["token"])
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            if o >= 0.5 * (len(sets[a]) + len(sets[b]) - o) and h1[a] != h1[b]:
                assert meet[h1[a]] & meet[h1[b]]


def test_blocks_lose_no_link(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" x{i}") for i in range(60)]
    got = classes(sigtree.ngram_jaccard_join(frame(spark, rows), block=1))  # 2300 n-grams and more in a component, 500 a block
    assert set(got.values()) == {(0, 59)}


def test_tasks_of_a_large_component_meet_by_size(spark):
    sizes = [5, 6, 9, 10, 15, 16, 17, 25, 26, 40, 41, 70, 100, 101, 170, 300] * 3
    members = spark.createDataFrame([(i, 7, n, i, 1) for i, n in enumerate(sizes)] + [(1000, 8, 30, 1000, 1), (1001, 8, 30, 1001, 1)], "id long, component long, size long, h1 long, n long")
    for threshold in (0.3, 0.6, 1.0):
        rows = sigtree._tasks(members, threshold, 60).collect()
        by = {}
        for r in rows:
            by.setdefault((r["component"], r["task"]), []).append(r)
        assert len(by[8, "all"]) == 2
        met = {}
        for (c, _), rs in by.items():
            for x in rs:
                for y in rs:
                    if x["id"] < y["id"] and (x["side"] != y["side"] or x["side"] == 0):
                        met[x["id"], y["id"]] = met.get((x["id"], y["id"]), 0) + 1
        assert set(met.values()) == {1}
        want = {(a, b) for a in range(48) for b in range(a + 1, 48) if min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b])}
        assert want <= set(met) and len(met) < 48 * 47 // 2


def test_a_document_goes_to_few_blocks_however_many_there_are(spark):
    rows = {}
    for groups in (20, 80):  # groups of ten, of sizes that may match, each joined to the next by one n-gram
        members = spark.createDataFrame([(i, 7, 20 + i % 3, 5000 + i, 1) for i in range(10 * groups)], "id long, component long, size long, h1 long, n long")
        tokens = [(5000 + i, i // 10) for i in range(10 * groups)] + [(5000 + 10 * g + k, 1000 + g) for g in range(groups - 1) for k in (9, 10)]
        out = sigtree._tasks(members, 0.4, 250, spark.createDataFrame(tokens, "h1 long, token long")).collect()
        met, by = {}, {}
        for r in out:
            by.setdefault(r["task"], []).append(r)
        for rs in by.values():
            for x in rs:
                for y in rs:
                    if x["id"] < y["id"] and (x["side"] != y["side"] or x["side"] == 0):
                        met[x["id"], y["id"]] = met.get((x["id"], y["id"]), 0) + 1
        assert set(met.values()) == {1}
        assert met.keys() >= {(a, b) for a in range(10 * groups) for b in range(a + 1, min(10 * groups, a - a % 10 + 10))} | {(10 * g + 9, 10 * g + 10) for g in range(groups - 1)}
        rows[groups] = len(out)
    assert rows[80] < 5 * rows[20] and rows[80] < 2 * 800


def test_long_text_hot_group_empty_and_clashing_names(spark):
    long = " ".join(f"w{k % 997} v{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "end")] + [(i, "one two three four") for i in range(10, 400)]
    got = classes(sigtree.ngram_jaccard_join(frame(spark, rows)))
    assert got[1] == got[2] == (1, 1) and got[3] == (3, 0) and {got[i] for i in range(10, 400)} == {(10, 389)}
    assert sigtree.ngram_jaccard_join(frame(spark, rows).where("false")).count() == 0
    d = frame(spark, rows[:3]).selectExpr("doc_id as `a.id`", "text as `a.text`", "1 as id", "'t' as text", "2 as h1", "3 as token", "4 as component", "5 as n", "6 as class_id", "7 as part")
    assert classes(sigtree.ngram_jaccard_join(d, id_col="a.id", text_col="a.text")) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    kept = sigtree.keep_one(d, id_col="a.id", text_col="a.text")
    assert kept.columns == d.columns and sorted(r[0] for r in kept.collect()) == [1, 3]


def test_keep_one(spark):
    rows = corpus(11) + [(2000, None), (2001, ""), (None, "a b c d e"), (None, "a b c d e")]
    d = frame(spark, rows)
    kept = sigtree.keep_one(d)
    assert sorted(kept.columns) == sorted(d.columns)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    groups: dict[int, int] = {}

    def root(x):
        while groups.get(x, x) != x:
            x = groups[x]
        return x

    for a, b in brute(rows):
        a, b = root(a), root(b)
        groups[max(a, b)] = min(a, b)
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in rows if i is not None and root(i) == i)
    assert ids.count(None) == 2
    assert sigtree.keep_one(d.where("false")).count() == 0


def test_same_id_rows_are_one_document(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "q r s t"), (1, "q r s t")]
    by_hash = {int(np.add.reduce(sigtree.gram_sets([t], 3)[0]).astype(np.int64)): t for t in ("a b c d", "q r s t")}
    with_ = 2 if by_hash[min(by_hash)] == "a b c d" else 3  # of the two sets of document 1 that of least hash counts
    want = {1: (1, 1), 2: (2, 0), 3: (3, 0)} | {with_: (1, 1)}
    assert classes(sigtree.ngram_jaccard_join(frame(spark, rows))) == want
    near = [(1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (2, "a b c d e f g h j")]
    assert classes(sigtree.ngram_jaccard_join(frame(spark, near))) == {1: (1, 1), 2: (1, 1)}
    assert sigtree.keep_one(frame(spark, rows)).count() == 4 if with_ == 2 else 5


def test_joined_labels():
    rng = np.random.RandomState(1)
    for _ in range(20):
        i, j = rng.randint(0, 60, 40), rng.randint(0, 60, 40)
        got, want = join_labels(np.arange(60), i, j), np.arange(60)
        for _ in range(60):
            np.minimum.at(want, i, want[j])
            np.minimum.at(want, j, want[i])
        assert np.array_equal(got, want)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (10, 9), (1, 2)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert components(edges.where("false")).count() == 0
