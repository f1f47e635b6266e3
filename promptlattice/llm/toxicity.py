"""Counterfactually regularised toxicity classifier.

A document is as toxic as its worst sentence. A sentence's score is a bias and the weights of the distinct known words in it; the
model is fitted on document labels by logistic loss on the worst sentence (multiple-instance learning), with an L1 penalty that
leaves few words. For every labelled sentence with identity terms, each term is swapped for each other term of its group,
neutral words for people among them, and the squared change of the score is penalised: of all that a swap changes in the sentence, words and
first letters of words alike. So the mention of a group carry the verdict, however often toxic texts in the sample name it, and neutral mentions are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, char_hash, chunks, code_points, extra_column, labelled_sample, mix64, powers, release, text_parts, with_mapped, word_hash, words_in

#: At most so many labelled documents are used for fitting, those of the least hash of their id; every document is scored.
MAX_TRAIN = 12000
THRESHOLD = 0.5
#: Words seen in at most this many sample documents, and words beyond the most telling FEATURES, have no weight.
RARE, FEATURES = 4, 3000
#: The first so many letters of a longer word are a feature too: forms of one word share it.
STEM = 4
#: Groups of terms that can take each other's place; the first words of each are neutral.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("people", "persons", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "immigrants", "refugees", "foreigners", "women", "men", "gays", "lesbians", "americans", "africans", "asians", "europeans", "mexicans", "blacks", "whites", "latinos"),
    ("person", "someone", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "immigrant", "refugee", "foreigner", "woman", "man", "lesbian", "american", "african", "asian", "european", "mexican"),
    ("different", "other", "jewish", "islamic", "black", "white", "latino", "female", "male", "gay", "straight", "queer", "transgender", "bisexual", "disabled", "deaf", "blind", "old", "young"),
    ("leute", "menschen", "muslime", "christen", "juden", "frauen", "männer", "ausländer", "flüchtlinge", "schwarze", "weiße"),
    ("gens", "personnes", "musulmans", "chrétiens", "juifs", "femmes", "hommes", "étrangers", "réfugiés", "noirs", "blancs"),
    ("gente", "personas", "musulmanes", "cristianos", "judíos", "mujeres", "hombres", "extranjeros", "refugiados", "negros", "blancos"),
)


def _sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(hash, sentence, document of each sentence, sentences, word of each stem), hashes of words and of the first STEM letters of longer words. Sentences end at . ! ? … or a new line, and count only if they have a word."""
    cps, starts = code_points([t.lower() for t in texts])
    h, begin, length = words_in(cps)
    stop = np.flatnonzero((cps == 10) | (cps == 46) | (cps == 33) | (cps == 63) | (cps == 0x2026))
    which = np.searchsorted(stop, begin)
    _, sentence = np.unique(which, return_inverse=True)
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    doc = np.zeros(n, dtype=np.int64)
    doc[sentence] = np.searchsorted(starts, begin, side="right") - 1
    long = length > STEM
    stem = np.zeros(int(long.sum()), dtype=U64)
    for k in range(STEM):
        stem += char_hash()[cps[begin[long] + k]] * powers(STEM)[k]
    return np.concatenate([h, mix64(stem) ^ U64(0x5851F42D4C957F2D)]), np.concatenate([sentence, sentence[long]]), doc, n, np.flatnonzero(long)


@dataclass
class ToxicityModel:
    """known: sorted hashes of the words with a weight; weight: theirs; bias."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability that each text is toxic."""
        worst = np.full(len(texts), self.bias)
        if len(self.known):
            h, sentence, doc, n, _ = _sentences(texts)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[at] == h
            pair = np.unique(sentence[hit].astype(np.int64) * len(self.known) + at[hit])
            total = np.full(n, self.bias)
            np.add.at(total, pair // len(self.known), self.weight[pair % len(self.known)])
            some = np.unique(pair // len(self.known))
            quiet = np.ones(len(texts), dtype=bool)  # a document whose every sentence has a known word is not worth the bias
            quiet[doc[np.setdiff1d(np.arange(n), some, assume_unique=True)]] = False
            texts_with = np.zeros(len(texts), dtype=bool)
            texts_with[doc] = True
            worst[texts_with & quiet] = -np.inf
            np.maximum.at(worst, doc[some], total[some])
        return 1 / (1 + np.exp(-worst))


def _merged(tally: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, documents, toxic documents) of several such tables, words in order."""
    words, word = np.unique(np.concatenate([t[0] for t in tally]), return_inverse=True)
    return (words, *(np.bincount(word, weights=np.concatenate([t[k] for t in tally]), minlength=len(words)) for k in (1, 2)))


class _Swaps:
    """Counts how each swap of a term for another of its group changes the features of the sentences that have the term.

    A feature that another word of the sentence gives too does not go, and one that is there already does not come: counts (from, to, kind) has in kind's bits
    whether the sentence has the new term (4), a further word with the old one's stem (2), and a word with the new one's stem (1)."""

    #: Sentences looked at together.
    SLICE = 4096

    def __init__(self, groups: tuple[tuple[str, ...], ...]):
        self.terms = sorted({t for g in groups for t in g})
        number = {t: i for i, t in enumerate(self.terms)}
        self.groups = [np.array(sorted({number[t] for t in g})) for g in groups]
        self.words = np.array([word_hash(t) for t in self.terms], dtype=U64)
        # one sentence a term: the stem follows its word; terms without one have the last, which no word has
        stems = [_sentences([t])[0] for t in self.terms]
        self.stems, at = np.unique(np.array([h[1] for h in stems if len(h) > 1], dtype=U64), return_inverse=True)
        self.stem = np.full(len(self.terms), len(self.stems))
        self.stem[[len(h) > 1 for h in stems]] = at
        self.counts = [np.zeros((len(self.terms), len(g), 8)) for g in self.groups]

    def add(self, h: np.ndarray, sentence: np.ndarray, n: int, long: np.ndarray) -> None:
        size = len(h) - len(long)
        for first in range(0, n, self.SLICE):
            lo, hi = np.searchsorted(sentence[:size], [first, first + self.SLICE])
            a, b = np.searchsorted(long, [lo, hi])
            self._add(np.concatenate([h[lo:hi], h[size + a : size + b]]), np.concatenate([sentence[lo:hi], sentence[size + a : size + b]]) - first, min(self.SLICE, n - first), long[a:b] - lo)

    def _add(self, h: np.ndarray, sentence: np.ndarray, n: int, long: np.ndarray) -> None:
        size = len(h) - len(long)
        order = np.argsort(self.words)
        at = order[np.minimum(np.searchsorted(self.words[order], h[:size]), len(order) - 1)]
        hit = self.words[at] == h[:size]
        if not hit.any():
            return
        have = np.zeros((n, len(self.terms)), dtype=bool)
        have[sentence[:size][hit], at[hit]] = True
        # distinct words of each stem of a term in each sentence
        at = np.minimum(np.searchsorted(self.stems, h[size:]), max(len(self.stems) - 1, 0))
        hit = np.flatnonzero(self.stems[at] == h[size:]) if len(self.stems) else np.empty(0, dtype=np.int64)
        forms = np.unique(np.rec.fromarrays([sentence[size:][hit], at[hit], h[long[hit]]], names="s,t,w"))
        with_stem = np.zeros((n, len(self.stems) + 1), dtype=np.int64)
        np.add.at(with_stem, (forms.s, forms.t), 1)
        for group, counts in zip(self.groups, self.counts):
            for a in group:
                rows = np.flatnonzero(have[:, a])
                if len(rows):
                    kind = 4 * have[np.ix_(rows, group)] + 2 * (with_stem[rows, self.stem[a]] > 1)[:, None] + (with_stem[np.ix_(rows, self.stem[group])] > 0)
                    counts[a] += np.bincount((kind + 8 * np.arange(len(group))).ravel(), minlength=8 * len(group)).reshape(-1, 8)

    def changes(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, signs, times) of each kind of swap: four columns of known, with len(known) for none, whether each goes (1), comes (-1) or neither (0), and a share of the mentions that adds up to 1."""

        def place(v: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, v), len(known) - 1)
            return np.where(known[at] == v, at, len(known))

        word, stem = place(self.words), np.append(place(self.stems), len(known))[self.stem]
        columns, signs, times = [np.empty((0, 4), dtype=np.int64)], [np.empty((0, 4))], [np.empty(0)]
        for group, counts in zip(self.groups, self.counts):
            a, j, kind = np.nonzero(counts)
            b = group[j]
            a, b, j, kind = (x[a != b] for x in (a, b, j, kind))
            apart = self.stem[a] != self.stem[b]
            columns.append(np.stack([word[a], word[b], stem[a], stem[b]], axis=1))
            signs.append(np.stack([np.ones(len(a)), -1.0 * (kind & 4 == 0), 1.0 * (apart & (kind & 2 == 0)), -1.0 * (apart & (kind & 1 == 0))], axis=1))
            times.append(counts[a, j, kind] / max(len(group) - 1, 1))
        share = np.concatenate(times)
        return np.concatenate(columns), np.concatenate(signs), share / max(share.sum(), 1)


def fit(texts: list[str], labels: list[int], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, counterfactual: float = 5.0, strictness: float = 0.05, rounds: int = 150) -> ToxicityModel:
    """Fits the model. counterfactual weighs the penalty on score changes under swaps; 0 leaves it out. strictness over the root of the
    sample's size is the L1 penalty. With one class only, or no text, the bias alone says so (not toxic if there is none)."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.empty(0, dtype=U64), np.empty(0), 10.0 if len(y) and y[0] else -10.0)
    # words by how many documents of each class have them, slice by slice, so that memory does not hold every word of the sample
    parts = list(chunks(texts))
    tally: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for p in parts:
        h, s, d, _, _ = _sentences(texts[p])
        words, word = np.unique(h, return_inverse=True)
        owner = np.unique(d[s] * len(words) + word)
        which = owner % max(1, len(words))
        tally.append((words, np.bincount(which, minlength=len(words)), np.bincount(which, weights=y[p][owner // max(1, len(words))], minlength=len(words))))
        if len(tally) > 16:
            tally = [_merged(tally)]
    vocabulary, in_all, in_toxic = _merged(tally)
    expected = in_all * y.mean()
    telling = np.abs(in_toxic - expected) / np.sqrt(expected * (1 - y.mean()) + 1e-9)
    telling[in_all <= RARE] = -1
    terms = {t: U64(word_hash(t)) for g in groups for t in g}
    order = np.argsort(-telling, kind="stable")[:FEATURES]
    known = np.unique(np.concatenate([vocabulary[order[telling[order] > 2]], np.array(list(terms.values()), dtype=U64)]))
    del vocabulary, in_all, in_toxic, expected, telling, order, tally
    # distinct (sentence, known word) pairs
    pairs, docs, n = [], [], 0
    swaps = _Swaps(groups)
    for p in parts:
        h, s, d, k, long = _sentences(texts[p])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        pairs.append(np.unique((s[hit] + n) * len(known) + at[hit]))
        docs.append(d + p.start)
        if counterfactual:
            swaps.add(h, s, k, long)
        n += k
    pair, doc = np.concatenate(pairs), np.concatenate(docs)
    row, col = pair // len(known), pair % len(known)
    columns, signs, times = swaps.changes(known)
    l1 = strictness / np.sqrt(len(y))
    first = np.flatnonzero(np.diff(doc, prepend=-1))  # sentences come in the order of documents
    length = np.diff(np.append(first, n))
    present = doc[first]
    starts = np.searchsorted(row, np.arange(n + 1))
    whole = np.unique(doc[row] * len(known) + col)  # distinct (document, known word) pairs
    whole_row, whole_col = whole // len(known), whole % len(known)
    w, bias = np.zeros(len(known)), float(np.log(y.mean() / (1 - y.mean())))
    free = np.ones(len(known), dtype=bool)
    # words are chosen on whole documents, then weighed on worst sentences, then weighed again without the shrinking L1 penalty
    for phase in ("documents", "sentences", "final"):
        if phase == "final":
            free = w != 0
        m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
        for r in range(1, rounds + 1):
            g = np.zeros(len(known) + 1)
            if phase == "documents":
                slope = (1 / (1 + np.exp(-(bias + np.bincount(whole_row, weights=w[whole_col], minlength=len(y))))) - y) / len(y)
                g[:-1] = np.bincount(whole_col, weights=slope[whole_row], minlength=len(known))
            else:
                score = bias + np.bincount(row, weights=w[col], minlength=n)
                best = np.maximum.reduceat(score, first) if n else score
                worst = np.full(len(y), bias)
                worst[present] = best
                slope = (1 / (1 + np.exp(-worst)) - y) / len(y)
                idx = np.flatnonzero(score == np.repeat(best, length))[::-1]
                chosen = np.full(len(y), -1)
                chosen[doc[idx]] = idx  # the first of the worst sentences
                picked = np.flatnonzero(chosen >= 0)
                lo, hi = starts[chosen[picked]], starts[chosen[picked] + 1]
                where = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
                g[:-1] = np.bincount(col[where], weights=np.repeat(slope[picked], hi - lo), minlength=len(known))
            g[-1] = slope.sum()
            g[:-1] += 1e-4 * w
            if counterfactual and len(times):
                change = 2 * counterfactual * times * (np.append(w, 0.0)[columns] * signs).sum(axis=1)
                g[:-1] += np.bincount(columns.ravel(), weights=(change[:, None] * signs).ravel(), minlength=len(known) + 1)[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            rate = 0.1 / (np.sqrt(v / (1 - 0.99**r)) + 1e-4)
            step = rate * m / (1 - 0.9**r)
            w, bias = np.where(free, w - step[:-1], 0), bias - step[-1]
            if phase != "final":
                w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate[:-1], 0)
    keep = w != 0
    return ToxicityModel(known[keep], w[keep], float(bias))


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in text_parts(batch, batch.num_columns - 1):
                p = shared.value.score([t or "" for t in texts])
                null = np.array([t is None for t in texts], dtype=bool)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64(), mask=null), pa.array(~null & (p >= threshold), pa.bool_())], names=[*batch.schema.names[:-1], "toxicity", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **kw) -> ToxicityModel:
    """Fits the model on at most max_train labelled documents. See labelled_sample for nulls and ties."""
    texts, y = labelled_sample(docs, labels, label_col, max_train, id_col, text_col)
    return fit(texts, y, **kw)


def classify(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The kept columns with toxicity and toxic; one row for each row of docs, in a map without a shuffle.

    A null text has null toxicity and is not toxic; a text without words has the bias's. Kept columns named like an added one get underscores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = {c: extra_column(docs, c + "_") if c.lower() in ("toxicity", "toxic") else c for c in keep}
    d = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return with_mapped(d, _score(shared, threshold), "toxicity double, toxic boolean")


def harmless_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of docs that are not toxic, with docs' columns."""
    scored = classify(docs, train(docs, labels, **kw), docs.columns, threshold)
    new = dict(zip(docs.columns, scored.columns))
    return scored.where("not toxic").select(*(F.col(f"`{n}`").alias(c) for c, n in new.items()))
