from __future__ import annotations

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from promptlattice.llm import crf, toxicity

RNG = random.Random(5)
PLAIN = "the river runs past old town walls and people walk there each quiet evening under tall trees".split()


def sentence(*extra):
    w = [RNG.choice(PLAIN) for _ in range(8)] + list(extra)
    RNG.shuffle(w)
    return " ".join(w).capitalize() + "."


def toxic_corpus(n=400):
    texts, y = [], []
    for i in range(n):
        bad = i % 4 == 0
        # toxic texts in the sample name a group, most neutral ones do not
        s = [sentence() for _ in range(3)] + [sentence("vermin", "filthy", "muslims") if bad else sentence("muslims") if i % 40 == 1 else sentence()]
        RNG.shuffle(s)
        texts.append(" ".join(s))
        y.append(int(bad))
    return texts, y


def test_counterfactual_penalty_clears_group_mentions():
    texts, y = toxic_corpus()
    model = toxicity.fit(texts, y)
    held, yh = toxic_corpus(200)
    p = model.score(held) >= 0.5
    assert (p == np.array(yh, dtype=bool)).mean() > 0.98
    neutral = [sentence("muslims") + " " + sentence("women") for _ in range(50)]
    assert not (model.score(neutral) >= 0.5).any()
    a, b = model.score(["Muslims walk there."]), model.score(["People walk there."])
    assert abs(a - b) < 0.05
    free = toxicity.fit(texts, y, counterfactual=0.0)
    logit = lambda m, t: float(np.log(p / (1 - p))) if (p := m.score([t])[0]) else -np.inf
    gap = lambda m: abs(logit(m, "Muslims walk there.") - logit(m, "People walk there."))
    assert gap(free) > 1 > 4 * gap(model)


def plain_score(model, text):
    """The model's score by its definition: words and first letters of longer ones, each once a sentence, the worst sentence."""
    weight = dict(zip(model.known.tolist(), model.weight))
    worst = None
    for part in re.split(r"[.!?…\n]", text.lower()):
        found = set()
        for w in re.findall(r"\w+", part):
            h = toxicity._sentences([w])[0]
            assert len(h) == 1 + (len(w) > toxicity.STEM)
            assert len(h) == 1 or h[1] == toxicity._sentences([w[: toxicity.STEM] + "zz"])[0][1]  # the stem hangs on the first letters alone
            found |= {int(x) for x in h}
        if re.search(r"\w", part):
            total = model.bias + sum(weight.get(h, 0.0) for h in found)
            worst = total if worst is None else max(worst, total)
    return 1 / (1 + np.exp(-(model.bias if worst is None else worst)))


def test_scores_by_definition():
    model = toxicity.fit(*toxic_corpus())
    texts = [*toxic_corpus(60)[0], "", "...", "Vermin", "vermin\nfilthy muslims! the river", "Ein Fluß… äußerst vermin?", "x", "vermin " * 50 + ". walk there", "\n\n", "no_word_here 12 vermin12"]
    got = model.score(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts]) and np.allclose(got, [model.score([t])[0] for t in texts])


def test_no_group_mention_is_toxic_by_itself():
    for term in ("muslims", "jewish", "black", "immigrants", "women", "gay"):
        rng = random.Random(term)
        y = [int(i % 4 == 0) for i in range(600)]
        texts = [sentence() + " " + sentence(*(["vermin"] if bad and rng.random() < 0.8 else []), *([term] if rng.random() < (0.9 if bad else 0.03) else [])) for bad in y]
        group = next(g for g in toxicity.IDENTITY_GROUPS if term in g)
        model, free = toxicity.fit(texts, y), toxicity.fit(texts, y, counterfactual=0.0)
        gap = lambda m, t: abs(m.score([f"The {t} walk there."])[0] - m.score([f"The {group[0]} walk there."])[0])  # noqa: B023, E731
        assert all(gap(model, t) < 0.05 for t in group) and gap(free, term) > 0.05, term


def test_counterfactual_penalty_holds_stems():
    def corpus(n, term):
        y = [int(i % 4 == 0) for i in range(n)]
        # the cue is in 6 of 10 toxic texts, the group in 9 of 10, and in 1 of 20 others; sentences about all kinds of people are in all
        one = [sentence(*(["vermin"] if RNG.random() < 0.6 else []), *([term] if RNG.random() < 0.9 else [])) if bad else sentence(*([term] if RNG.random() < 0.05 else [])) for bad in y]
        return [f"{sentence()} {s}" for s in one], y

    for term, other in (("immigrants", "immigration"), ("jewish", "jewel")):
        group = next(g for g in toxicity.IDENTITY_GROUPS if term in g)
        model = toxicity.fit(*corpus(800, term))
        logit = lambda t: float(np.log(p / (1 - p))) if (p := model.score([t])[0]) else -np.inf  # noqa: B023, E731
        for swapped in group:
            assert abs(logit(f"The town walls and {term} there.") - logit(f"The town walls and {swapped} there.")) < 0.25, (term, swapped)
        assert model.score([sentence("vermin")])[0] > 0.5 and model.score([f"The {term} walk there."])[0] < 0.5


def test_swaps_change_what_words_share():
    groups = (("people", "muslims", "men"),)
    texts = ["People talk.", "Muslims and Muslim men walk.", "Muslims pray, muslims rest."]
    model_words = np.unique(np.concatenate([toxicity._sentences([t])[0] for t in (*groups[0], "muslim")]))
    swaps = toxicity._Swaps(groups)
    swaps.SLICE = 2
    h, s, _, n, long = toxicity._sentences(texts)
    swaps.add(h, s, n, long)
    columns, signs, times = swaps.changes(model_words)
    w = np.random.RandomState(3).randn(len(model_words))
    got = (np.append(w, 0.0)[columns] * signs).sum(axis=1)

    def score(t):
        return w[np.isin(model_words, toxicity._sentences([t])[0])].sum()

    want = []
    for t in (x.lower().replace("muslim ", "Muslim ") for x in texts):
        have = set(t.replace(",", "").replace(".", "").split())
        want += [score(t) - score(t.replace(a, b)) for a in groups[0] for b in groups[0] if a != b and a in have]
    assert np.allclose(sorted(np.repeat(got, np.round(times * 8).astype(int))), sorted(want)) and abs(times.sum() - 1) < 1e-12


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_toxicity_stage(spark):
    texts, y = toxic_corpus(120)
    extra = [None, "", "…", "word " * 50_000, sentence("vermin", "filthy")]
    docs = frame(spark, texts + extra).withColumn("Toxic", F.lit(7))
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(None, 1, 1), (3, None, None), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.classify(docs, toxicity.train(docs, labels), ["doc_id", "Toxic"]).collect()}
    assert len(scored) == 125 and scored[0]["Toxic_"] == 7
    assert scored[120]["toxicity"] is None and not scored[120]["toxic"] and not scored[121]["toxic"] and not scored[123]["toxic"] and scored[124]["toxic"]
    kept = toxicity.harmless_documents(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {i for i, v in enumerate(y) if v} and {i for i, v in enumerate(y) if not v} <= ids and 120 in ids
    assert toxicity.harmless_documents(docs.where("false"), labels).count() == 0
    assert toxicity.harmless_documents(docs, labels.where("false")).count() == 125  # no labels: nothing is toxic


def test_one_class_and_no_text():
    assert toxicity.fit([], []).score(["x"])[0] < 0.5 and toxicity.fit(["a"], [1]).score(["x"])[0] > 0.5
    assert crf.fit([], []).quality(["x"])[0][0] > 0.5 and crf.fit(["a b"], [0]).quality(["x"])[0][0] < 0.5


def test_marginals_match_brute_force():
    rng = np.random.RandomState(1)
    emit, trans = rng.randn(9, 2), rng.randn(2, 2)
    starts = np.array([0, 1, 5, 9])
    got = crf.forward_backward(emit, starts, trans)[3]
    for lo, hi in zip(starts[:-1], starts[1:]):
        weight = np.zeros((hi - lo, 2))
        for path in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(emit[lo + t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                weight[t, s] += w
        assert np.allclose(got[lo:hi], weight / weight.sum(axis=1, keepdims=True))


def plain_features(text):
    """A line's features by their definitions."""
    lines = text.split("\n")
    rows, weights = [], []
    for line in lines:
        kind = lambda c: "space" if c.isspace() else "capital" if c.isalpha() and c.isupper() else "letter" if c.isalpha() else "digit" if c.isalnum() else "mark" if c in "!?¡¿" else "stop" if c in ".,;:'\"()-’“”«»…–—" else "sign"
        kinds = [kind(c) for c in line]
        n = {k: kinds.count(k) for k in ("space", "capital", "letter", "digit", "mark", "stop", "sign")}
        weight = len(line) - n["space"]
        words = re.findall(r"\w+", line)
        same = lines.count(line) if weight else 1
        some = max(weight, 1)
        values = {
            "symbols": n["sign"] / some, "marks": n["mark"] / some, "stops": n["stop"] / some, "digits": n["digit"] / some,
            "capitals": n["capital"] / (n["capital"] + n["letter"]) if n["capital"] + n["letter"] else 0, "repeated": 1 - len(set(words)) / len(words) if len(words) >= 8 else 0, "same_lines": same,
            "same_share": same / len(lines) if same > 1 else 0, "word_length": sum(map(len, words)) / len(words) if words else 0, "words": len(words), "last": float(bool(line) and kinds[-1] in ("mark", "stop")),
        }
        rows.append([float(values[name] >= cut) for name, cuts in crf.CUTS.items() for cut in cuts])
        weights.append(weight)
    none = [0.0] * len(rows[0])
    full = [r + (rows[i - 1] if i else none) + (rows[i + 1] if i + 1 < len(rows) else none) + [float(i > 0), float(i + 1 < len(rows)), 1.0] for i, r in enumerate(rows)]
    return np.array(full), np.array(weights)


ODD_TEXTS = ["", "a", "A b\n\nA b", " \n \n", "BUY NOW!!! $$$\nBUY NOW!!! $$$\nok", "one two three four five six seven eight one two\n12 34 five.", "é É ß «x» — y…\n\tx", "the end.\n" * 5, "%%% *** ###\n" + "word " * 70]


def test_line_features_by_definition():
    x, weight, starts = crf.line_features(ODD_TEXTS)
    for t, lo, hi in zip(ODD_TEXTS, starts, starts[1:]):
        want, weights = plain_features(t)
        assert np.array_equal(x[lo:hi], want) and np.array_equal(weight[lo:hi], weights), t


def test_quality_by_definition():
    model = crf.LineCRF(np.random.RandomState(2).randn(3 * crf.N_CUTS + 3).astype(np.float32), np.array([[0.7, -1.0], [-0.4, 1.2]]))
    got, lines, bad = model.quality(ODD_TEXTS)
    for k, t in enumerate(ODD_TEXTS):
        x, weights = plain_features(t)
        emit = x @ model.weight
        good, total = np.zeros(len(x)), 0.0
        for path in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(sum(e for e, s in zip(emit, path) if s) + sum(model.trans[a, b] for a, b in zip(path, path[1:])))
            good, total = good + w * np.array(path), total + w
        good = good / total
        assert abs(got[k] - ((weights * good).sum() / weights.sum() if weights.sum() else 0)) < 1e-4 and lines[k] == len(x) and bad[k] == (good < 0.5).sum()


def test_gradient_is_that_of_the_loss():
    rng = np.random.RandomState(3)
    x, starts = rng.randint(0, 2, (12, 5)).astype(np.float64), np.array([0, 1, 5, 12])
    target, unit, theta = rng.randint(0, 2, 12), np.repeat([0.5, 0.2, 0.3], [1, 4, 7]), rng.randn(9)
    value, g = crf.loss(theta, x, starts, target, unit, 0.1)
    step = 1e-6 * np.eye(9)
    assert np.allclose(g, [(crf.loss(theta + e, x, starts, target, unit, 0.1)[0] - crf.loss(theta - e, x, starts, target, unit, 0.1)[0]) / 2e-6 for e in step], atol=1e-5) and value > 0


def test_bad_run_in_a_good_document_is_marked_line_by_line():
    texts, y = quality_corpus(80)
    model = crf.fit(texts, y)
    for n in (1, 3, 5):
        held = [sentence() for _ in range(6)]
        held[2:2] = ["click click click click click click click click", "%%% *** ### ~~~", "BUY NOW!!! $$$ ### @@@", "%%% *** ### ~~~", "BUY NOW!!! $$$ ### @@@"][:n]
        x, _, starts = crf.line_features(["\n".join(held)])
        emit = np.stack([np.zeros(len(x)), x @ model.weight], axis=1)
        assert (crf.forward_backward(emit, starts, model.trans)[3][:, 1] >= 0.5).tolist() == [True] * 2 + [False] * n + [True] * 4
    out, marks = crf.splice(texts, np.array(y))
    assert len(out) == 40 and all(len(t.split("\n")) == len(m) and m[0] == m[-1] == 1 and not m.all() for t, m in zip(out, marks))


def quality_corpus(n):
    good = ["\n".join(sentence() for _ in range(RNG.randint(2, 6))) for _ in range(n)]
    bad = ["\n".join(RNG.choice(["BUY NOW!!! $$$ ### @@@", "click click click click click click click click", "%%% *** ### ~~~"]) for _ in range(RNG.randint(2, 6))) for _ in range(n)]
    return good + bad, [1] * n + [0] * n


def test_quality_held_out_and_weighting():
    texts, y = quality_corpus(60)
    model = crf.fit(texts, y, rounds=100)
    held, yh = quality_corpus(40)
    q = model.quality(held)[0]
    assert ((q >= 0.5) == np.array(yh, dtype=bool)).mean() > 0.97
    # a long good part outweighs a short bad line
    mixed = "\n".join(sentence() for _ in range(8)) + "\n%%% *** ###"
    assert model.quality([mixed])[0][0] > 0.5
    one = model.quality(held[:1])[0][0]
    assert abs(model.quality(held)[0][0] - one) < 1e-6  # a document's quality does not depend on the others in its batch


def test_quality_stage(spark):
    texts, y = quality_corpus(30)
    docs = frame(spark, texts + [None, "", " \n \n", "line of words here\n" * 20_000]).withColumn("crf_keep", F.lit("mine"))
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in crf.classify(docs, crf.train(docs, labels), ["doc_id", "crf_keep"]).collect()}
    assert got[60]["crf_quality"] is None and not got[60]["crf_keep"] and got[61]["crf_quality"] == 0.0 and got[62]["crf_quality"] == 0.0 and got[62]["crf_lines"] == 3 and got[0]["crf_keep_"] == "mine"
    kept = crf.good_documents(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i, v in enumerate(y) if v} <= ids and not ids & {i for i, v in enumerate(y) if not v}
    assert crf.good_documents(docs.where("false"), labels).count() == 0
