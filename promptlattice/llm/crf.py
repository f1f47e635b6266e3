"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are thresholds on shape (symbols, capitals, repeated words and lines, word and line lengths),
of the line itself and of the lines before and after it. The chain's transitions tie neighbouring lines. Only documents are labelled, so a line's label for
training is its document's; and, as no such document ever goes from good to bad, good ones with the lines of a bad one put in are added, each line labelled by where it came from: from these
the transitions learn how runs begin and end. A document's quality is the mean of its lines' forward-backward marginals of good, weighted by
their characters other than white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, char_hash, chunks, code_points, extra_column, labelled_sample, mix64, powers, release, text_parts, with_mapped, words_in

#: At most so many labelled documents are used for fitting, those of the least hash of their id; every document is scored.
MAX_TRAIN = 6000
THRESHOLD = 0.5
#: Spliced documents for each pair of a good and a bad one, their weight in all (the documents as they are have the rest), and lines of one at most: a fit takes time by the longest document.
SPLICES, SPLICED_SHARE, SPLICE_LINES = 0.5, 0.25, 200
#: For fitting, a document of more lines is several chains of so many, all with its features and label.
CHAIN_LINES = 500
#: Thresholds: a line has feature (name, cut) if its value is at least cut.
CUTS: dict[str, tuple[float, ...]] = {
    "symbols": (0.01, 0.03, 0.06, 0.1, 0.2),
    "marks": (0.01, 0.03, 0.06, 0.1, 0.2),
    "stops": (0.02, 0.05, 0.1),
    "digits": (0.05, 0.15, 0.3),
    "capitals": (0.05, 0.15, 0.4, 0.7),
    "repeated": (0.15, 0.3, 0.5, 0.7, 0.85),
    "same_lines": (2, 3, 4, 6),
    "same_share": (0.15, 0.3, 0.5),
    "word_length": (2.5, 4, 7, 10, 15),
    "words": (1, 3, 8, 20, 60),
    "last": (0.5,),
}
N_CUTS = sum(map(len, CUTS.values()))


def _classes() -> np.ndarray:
    """By code point: 0 other signs, 1 white space, 2 small or caseless letters, 3 capitals, 4 digits, 5 '!' and '?', 6 '.', ',', ';', ':' and the like."""
    if "crf" not in _CACHE:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isspace():
                table[c] = 1
            elif ch.isalpha():
                table[c] = 3 if ch.isupper() else 2
            elif ch.isalnum():
                table[c] = 4
        table[[ord(c) for c in "!?¡¿"]] = 5
        table[[ord(c) for c in ".,;:'\"()-’“”«»…–—"]] = 6
        _CACHE["crf"] = table
    return _CACHE["crf"]


_CACHE: dict[str, np.ndarray] = {}


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight, starts): for each line of the texts its 0/1 features (own, of the line before, of the line after, and one) and its characters other than
    white space; starts has each text's first line, and the number of lines. A text has one line more than newlines."""
    cps, at = code_points(texts)
    ends = np.flatnonzero(cps == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    starts = np.searchsorted(begins, at)
    n = len(begins)
    kind = _classes()[cps]
    total = np.zeros((8, n), dtype=np.float64)
    for k in range(7):
        total[k] = np.add.reduceat(kind == k, begins, dtype=np.int64)
    weight = total[[0, 2, 3, 4, 5, 6]].sum(axis=0)
    some = np.maximum(weight, 1)
    letters = total[2] + total[3]
    h, begin, length = words_in(cps)
    line = np.searchsorted(begins, begin, side="right") - 1
    words = np.bincount(line, minlength=n)
    # the distinct words of a line: one hash for each pair of line and word, counted through its first place
    _, first = np.unique(mix64(h + line.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(line[first], minlength=n)
    # lines that are the same within a document
    doc = np.searchsorted(starts, np.arange(n), side="right") - 1
    size = ends - begins
    pos = np.arange(len(cps)) - np.repeat(begins, size + 1)
    code = np.add.reduceat(char_hash()[cps] * powers(int(size.max()) + 1)[pos], begins)
    _, where, count = np.unique(mix64(code + doc.astype(U64) * U64(0xD1B54A32D192ED03)), return_inverse=True, return_counts=True)
    same = np.where(weight > 0, count[where], 1)
    per_doc = np.diff(starts)[doc]
    last = kind[np.maximum(ends - 1, begins)]
    values = {
        "symbols": total[0] / some,
        "marks": total[5] / some,
        "stops": total[6] / some,
        "digits": total[4] / some,
        "capitals": np.where(letters > 0, total[3] / np.maximum(letters, 1), 0),
        "repeated": np.where(words >= 8, 1 - distinct / np.maximum(words, 1), 0),
        "same_lines": same,
        "same_share": np.where(same > 1, same / per_doc, 0),
        "word_length": np.where(words > 0, np.bincount(line, weights=length, minlength=n) / np.maximum(words, 1), 0),
        "words": words,
        "last": (last == 5) | (last == 6),
    }
    x = np.zeros((n, 3 * N_CUTS + 3), dtype=np.float32)
    k = 0
    for name, cuts in CUTS.items():
        for cut in cuts:
            x[:, k] = values[name] >= cut
            k += 1
    inner = np.ones(n, dtype=bool)
    inner[starts[:-1]] = False  # these have no line before
    x[inner, N_CUTS : 2 * N_CUTS] = x[np.flatnonzero(inner) - 1, :N_CUTS]
    x[inner, 3 * N_CUTS] = 1
    x[np.flatnonzero(inner) - 1, 2 * N_CUTS : 3 * N_CUTS] = x[inner, :N_CUTS]
    x[np.flatnonzero(inner) - 1, 3 * N_CUTS + 1] = 1
    x[:, 3 * N_CUTS + 2] = 1
    return x, weight, starts


def forward_backward(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, log Z by line, marginals) in log space for chains of lines starts[k]..starts[k+1]-1; emit is (lines, 2), trans[a, b] from a to b."""
    count = np.diff(starts)
    by = np.argsort(-count, kind="stable")
    first, count = starts[:-1][by], count[by]
    alpha, beta = emit.astype(np.float64), np.zeros(emit.shape)
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(1, longest + 1), side="right")  # chains longer than t
    for t in range(1, longest):
        i = first[: live[t]] + t
        for b in (0, 1):
            alpha[i, b] += np.logaddexp(alpha[i - 1, 0] + trans[0, b], alpha[i - 1, 1] + trans[1, b])
    end = first + count - 1
    for t in range(1, longest):
        i = end[: live[t]] - t
        for a in (0, 1):
            beta[i, a] = np.logaddexp(trans[a, 0] + emit[i + 1, 0] + beta[i + 1, 0], trans[a, 1] + emit[i + 1, 1] + beta[i + 1, 1])
    whole = alpha + beta
    z = np.logaddexp(whole[:, 0], whole[:, 1])
    return alpha, beta, z, np.exp(whole - z[:, None])


@dataclass
class LineCRF:
    """weight: of the features, for good against bad; trans: (2, 2), state 1 is good."""

    weight: np.ndarray
    trans: np.ndarray

    def quality(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quality, lines, bad lines) of each text; the quality of a text of white space alone is 0."""
        x, weight, starts = line_features(texts)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weight
        good = forward_backward(emit, starts, self.trans)[3][:, 1]
        total = np.add.reduceat(weight, starts[:-1])
        return np.where(total > 0, np.add.reduceat(weight * good, starts[:-1]) / np.maximum(total, 1), 0.0), np.diff(starts), np.add.reduceat((good < 0.5).astype(np.int64), starts[:-1])


def splice(texts: list[str], y: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """(texts, line labels) of good documents with the lines of a bad one put in after some of their own. The k-th good document that has several lines meets the k-th bad one with a word."""
    good = [lines for t, v in zip(texts, y) if v and 1 < len(lines := t.split("\n")) <= SPLICE_LINES]
    bad = [lines for t, v in zip(texts, y) if not v and t.strip() and len(lines := t.split("\n")) <= SPLICE_LINES]
    out, marks = [], []
    for k in range(int(SPLICES * min(len(good), len(bad)))):
        at = 1 + k % (len(good[k]) - 1)
        out.append("\n".join([*good[k][:at], *bad[k], *good[k][at:]]))
        marks.append(np.repeat([1, 0, 1], [at, len(bad[k]), len(good[k]) - at]))
    return out, marks


def loss(theta: np.ndarray, x: np.ndarray, starts: np.ndarray, target: np.ndarray, unit: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """(penalised negative log-likelihood, gradient) at theta, the features' weights and the four transitions; a chain's terms weigh by its lines' unit."""
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    inner = np.ones(len(x), dtype=bool)
    inner[starts[:-1]] = False
    i = np.flatnonzero(inner)
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ w.astype(x.dtype)
    alpha, beta, z, marginal = forward_backward(emit, starts, trans)
    g = np.empty_like(theta)
    g[:-4] = (unit * (marginal[:, 1] - target)).astype(x.dtype) @ x
    for a in (0, 1):
        for b in (0, 1):
            pair = np.exp(alpha[i - 1, a] + trans[a, b] + emit[i, b] + beta[i, b] - z[i])
            g[x.shape[1] + 2 * a + b] = np.sum(unit[i] * (pair - ((target[i - 1] == a) & (target[i] == b))))
    of = np.add.reduceat(np.where(target == 1, emit[:, 1], 0.0), starts[:-1])
    np.add.at(of, np.searchsorted(starts, i, side="right") - 1, trans[target[i - 1], target[i]])
    return float(np.sum(unit[starts[:-1]] * (z[starts[:-1]] - of)) + l2 / 2 * theta @ theta), g + l2 * theta


def fit(texts: list[str], labels: list[int], rounds: int = 200, l2: float = 1e-3) -> LineCRF:
    """Maximum conditional likelihood by full-batch Adam; each document weighs the same, bad ones as much in all as good ones, and spliced ones SPLICED_SHARE in all. A document's weight is parted among its lines.
    With one class only, or no text, every line is of that class (good if there is none)."""
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        w = np.zeros(3 * N_CUTS + 3, dtype=np.float32)
        w[-1] = 10.0 if not len(y) or y[0] else -10.0
        return LineCRF(w, np.zeros((2, 2)))
    spliced, marks = splice(texts, y)
    texts = [*texts, *spliced]
    parts = [line_features(texts[p]) for p in chunks(texts)]
    x = np.concatenate([p[0] for p in parts])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    count = np.diff(starts)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * (1 - SPLICED_SHARE if spliced else 1)
    share = np.append(share, np.full(len(spliced), SPLICED_SHARE / max(1, len(spliced))))
    unit = np.repeat(share / count, count)
    target = np.concatenate([np.repeat(y, count[: len(y)]), *marks]).astype(np.int64)
    starts = np.append(np.concatenate([np.arange(a, b, CHAIN_LINES) for a, b in zip(starts, starts[1:])]), starts[-1])
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for r in range(1, rounds + 1):
        _, g = loss(theta, x, starts, target, unit, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return LineCRF(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2))


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in text_parts(batch, batch.num_columns - 1):
                quality, lines, bad = shared.value.quality([t or "" for t in texts])
                null = np.array([t is None for t in texts], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(quality, pa.float64(), mask=null), pa.array(np.where(null, 0, lines), pa.int64()), pa.array(np.where(null, 0, bad), pa.int64()), pa.array(~null & (quality >= threshold), pa.bool_())],
                    names=[*batch.schema.names[:-1], "crf_quality", "crf_lines", "crf_bad_lines", "crf_keep"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCRF:
    """Fits the field on at most max_train labelled documents. See labelled_sample for nulls and ties."""
    texts, y = labelled_sample(docs, labels, label_col, max_train, id_col, text_col)
    return fit(texts, y)


def classify(docs: DataFrame, model: LineCRF, keep: list[str], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The kept columns with crf_quality, crf_lines, crf_bad_lines and crf_keep; one row for each row of docs, in a map without a shuffle.

    A null text has null quality, no lines and is not kept; one of white space alone has quality 0. Kept columns named like an added one get underscores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = {c: extra_column(docs, c + "_") if c.lower() in ("crf_quality", "crf_lines", "crf_bad_lines", "crf_keep") else c for c in keep}
    d = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return with_mapped(d, _score(shared, threshold), "crf_quality double, crf_lines long, crf_bad_lines long, crf_keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of docs whose quality is at least threshold, with docs' columns."""
    scored = classify(docs, train(docs, labels, **kw), docs.columns, threshold)
    new = {c: n for c, n in zip(docs.columns, scored.columns)}
    return scored.where("crf_keep").select(*(F.col(f"`{n}`").alias(c) for c, n in new.items()))
