"""N-gram Jaccard self-join by signature trees.

Documents become sets of hashed word n-grams (lower case, words as Python's \\w+). The join then has five steps, none of which loses a pair:

1. Documents with the same set collapse to one representative, the least id, with a count.
2. Maximum overlap of a document with all others. N-grams are counted in ranges of their hashes, and a document learns which of its own some other document has. One that
   shares fewer than the threshold needs (a share t of its own) has no partner, whatever the others are, and goes: most documents do.
3. The rest are parted. Of two documents at the threshold, each has a common n-gram among its first size - need + 1 in any order that all documents use; the order here is rarest first
   (prefix filtering). So documents that have no such n-gram in common, directly or through others, need not meet: the components of that graph become the tasks.
   Only n-grams' hashes travel so far, with their document's number in its batch: six bytes each. Hashes that are cut so far may meet by chance, which only brings documents together.
4. In each component a signature tree is built: leaves hold documents of similar size, a node holds the OR of the n-gram bitmaps
   below it, their size range and the most bit collisions of a document below it. The dual traversal descends from the pair
   (root, root) and drops a node pair as soon as its size ranges are too far apart or its greatest possible overlap,
   common bits plus collisions, is less than the threshold needs. What is left is verified exactly on the whole sets.
   A component of more than block documents' worth is cut into blocks by size and common n-grams. A block meets those documents of other blocks whose sizes may match and that have one of the n-grams of step 3 in
   common with it, so no pair is lost, and a document goes to few blocks, however many there are.
5. A task returns a row for each document with a partner in it: how many it has, and one that stands for its part of the task. Groups of copies never leave a task as pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, components, join_labels, materialise, mix64, release, text_parts, word_hashes

N, THRESHOLD, BLOCK = 3, 0.6, 1000
#: Bytes of text whose n-grams a range of hashes has, and ranges at most: beyond these the ranges grow.
RANGE_BYTES, MOST_RANGES = 12 << 20, 60_000
#: N-grams of a batch that is sent, and those that are sorted at a time.
GROUP, SORTED = 400_000, 4_000_000
#: A table of at most so many bytes by count and row width may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer than n words has one n-gram, all its words; one of none has none."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    grams = np.zeros(max(0, len(words) - n + 1), dtype=U64)
    for k in range(n):
        grams = mix64(grams * U64(3) + words[k : len(words) - n + 1 + k]) if len(grams) else grams
    out = []
    for i, c in enumerate(counts):
        a = at[i]
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            h = np.zeros(1, dtype=U64)
            for w in words[a : a + c]:
                h = mix64(h * U64(3) + w)
            out.append(h ^ U64(c))
        else:
            out.append(np.empty(0, dtype=U64))
    return out


_SENT = pa.schema([("part", pa.int32()), ("range", pa.int32()), ("batch", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())])
_SENT_SQL = "part int, range int, batch long, tokens binary, docs binary, times binary, ids binary, sizes binary, hashes binary"


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SENT], schema=_SENT)


def _home(batch: int, parts: int) -> int:
    """Where a batch's documents are put together again."""
    return ((batch >> 24) * 7919 + (batch & 0xFFFFFF)) % parts


def _spread(n: int, parts: int):
    """(id, text) -> batches of documents: a row of a batch's ids, sizes and set hashes, and a row for each range of its n-grams' hashes: their lower halves, and each one's document in the batch."""

    def send(batch: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(s) for s in sets])
        starts = np.cumsum(size) - size
        token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), size)
        h1, h2 = np.add.reduceat(token, starts), np.bitwise_xor.reduceat(mix64(token + U64(1)), starts)
        yield _rows(part=[_home(batch, parts)], batch=[batch], ids=[np.array(ids, dtype=np.int64).tobytes()], sizes=[size.tobytes()], hashes=[np.concatenate([h1, h2]).tobytes()])
        at = ((token >> U64(32)) * U64(parts) >> U64(32)).astype(np.uint16)
        by = np.argsort(at, kind="stable")
        at, low, doc = at[by], token[by].astype(np.uint32), doc[by]
        edge = np.append(np.flatnonzero(np.diff(at, prepend=at[:1] ^ np.uint16(1))), len(at))
        to = at[edge[:-1]].astype(np.int32)
        yield _rows(part=to, range=to, batch=[batch] * len(to), tokens=[low[a:b].tobytes() for a, b in zip(edge, edge[1:])], docs=[doc[a:b].tobytes() for a, b in zip(edge, edge[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task = TaskContext.get()
        batch = (task.partitionId() if task else 0) << 24  # the same numbers if the task runs again
        ids, sets, held = [], [], 0
        for whole in batches:
            for part, texts in text_parts(whole, 1):
                for i, s in zip(part.column(0).to_pylist(), gram_sets(texts, n)):
                    if len(s):
                        ids.append(i), sets.append(s)
                        held += len(s)
                        if held > GROUP or len(ids) > 60_000:
                            yield from send(batch, ids, sets)
                            batch, ids, sets, held = batch + 1, [], [], 0
        if sets:
            yield from send(batch, ids, sets)

    return run


def _joined(rows: list[dict], column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), dtype=kind)


def _parted(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """(rows of documents, rows of n-grams) of each batch."""
    for batch in batches:
        some = batch.column(3).is_valid()
        yield batch.filter(batch.column(3).is_null()), batch.filter(some).select(columns).to_pylist()


def _shared(parts: int):
    """Rows of n-grams by range -> rows of those that are there more than once, and how often. Rows of documents go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = defaultdict(list)
        for docs, grams in _parted(batches, ["range", "batch", "tokens", "docs"]):
            yield docs
            for r in grams:
                by[r["range"]].append(r)
        for at, rows in by.items():
            token, doc = _joined(rows, "tokens", np.uint32), _joined(rows, "docs", np.uint16)
            times, turns = np.empty(len(token), dtype=np.uint8), 1 + len(token) // SORTED
            for turn in range(turns):
                own = np.flatnonzero(token % np.uint32(turns) == turn) if turns > 1 else np.arange(len(token))
                entry = np.sort(token[own].astype(U64) << U64(32) | own.astype(U64))
                place, entry = (entry & U64(0xFFFFFFFF)).astype(np.int64), (entry >> U64(32)).astype(np.uint32)
                first = np.flatnonzero(np.diff(entry, prepend=entry[:1] ^ np.uint32(1)))
                count = np.diff(np.append(first, len(entry)))
                # a byte that keeps the order: counts as they are, from 128 on by steps of their logarithm
                byte = np.where(count < 128, count, np.minimum(255, 128 + 8 * np.log2(np.maximum(count, 128) / 128))).astype(np.uint8)
                times[place] = np.repeat(byte, count)
            edge = np.cumsum([0] + [len(r["docs"]) // 2 for r in rows])
            out = defaultdict(list)
            for r, a, b in zip(rows, edge, edge[1:]):
                several = times[a:b] > 1
                if several.any():
                    for name, value in (("part", _home(r["batch"], parts)), ("range", at), ("batch", r["batch"]), ("tokens", token[a:b][several].tobytes()), ("docs", doc[a:b][several].tobytes()), ("times", times[a:b][several].tobytes())):
                        out[name].append(value)
            if out:
                yield _rows(**out)

    return run


_ROUTE = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("token", pa.int64())])


def _prefixes(threshold: float):
    """(id, size, h1, h2) of each document, and (h1, token) for each n-gram by which a document that may have partners meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, by = {}, defaultdict(list)
        for known, grams in _parted(batches, ["range", "batch", "tokens", "docs", "times"]):
            for r in known.select(["batch", "ids", "sizes", "hashes"]).to_pylist():
                docs[r["batch"]] = [np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "sizes", "hashes")]
            for r in grams:
                by[r["batch"]].append(r)
        for batch, (ids, size, hashes) in docs.items():
            h1, h2 = hashes.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(h1), pa.array(h2), pa.nulls(len(ids), pa.int64())], schema=_ROUTE)
            rows = by.pop(batch, [])
            doc, times = _joined(rows, "docs", np.uint16).astype(np.int64), _joined(rows, "times", np.uint8)
            token = np.repeat(np.array([r["range"] for r in rows], dtype=np.int64), [len(r["times"]) for r in rows]) << 32 | _joined(rows, "tokens", np.uint32)
            spare = np.bincount(doc, minlength=len(ids)) - np.ceil(threshold * size - 1e-9).astype(np.int64)
            maybe = spare[doc] >= 0
            doc, token, times = doc[maybe], token[maybe], times[maybe]
            order = np.lexsort((token, times, doc))
            doc, token = doc[order], token[order]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
            head = place <= spare[doc]  # the n-grams that no other document has come before all these
            none = pa.nulls(int(head.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(h1[doc[head]]), none, pa.array(token[head])], schema=_ROUTE)

    return run


class Node:
    """A level of the tree, all its nodes as arrays: bits (OR of the bitmaps), lo and hi (sizes), loose (most collisions), first child and count."""

    __slots__ = ("bits", "hi", "lo", "loose")

    def __init__(self, bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, loose: np.ndarray):
        self.bits, self.lo, self.hi, self.loose = bits, lo, hi, loose


FAN = 8
#: Node pairs that are taken on at a time; each has FAN * FAN pairs of children.
SLICE = 1 << 14


def build_tree(sets: list[np.ndarray]) -> tuple[np.ndarray, list[Node]]:
    """The order of the sets in the leaves, and the levels from the documents up to one root; FAN children a node."""
    sizes = np.array([len(s) for s in sets])
    # sizes in steps of a tenth, and within a step by least n-gram, so that near copies are neighbours
    order = np.lexsort((np.array([s[0] for s in sets], dtype=U64), np.floor(np.log(sizes) / np.log(1.1))))
    width = int(min(1 << 16, max(256, 1 << int(np.ceil(np.log2(4 * np.median(sizes)))))))
    bits = np.zeros((len(sets), width // 8), dtype=np.uint8)
    for row, i in enumerate(order):
        flags = np.zeros(width, dtype=np.uint8)
        flags[(sets[i] & U64(width - 1)).astype(np.int64)] = 1
        bits[row] = np.packbits(flags)
    bits = bits.view(U64)
    sizes = sizes[order]
    levels = [Node(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].lo) > 1:
        down = levels[-1]
        cut = np.arange(0, len(down.lo), FAN)
        levels.append(Node(np.bitwise_or.reduceat(down.bits, cut, axis=0), np.minimum.reduceat(down.lo, cut), np.maximum.reduceat(down.hi, cut), np.maximum.reduceat(down.loose, cut)))
    return order, levels


def _may_match(x: Node, y: Node, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which node pairs (a of x, b of y) can hold a pair of at least threshold."""
    ok = (x.hi[a] >= threshold * y.lo[b]) & (y.hi[b] >= threshold * x.lo[a])
    idx = np.flatnonzero(ok)
    need = np.ceil((x.lo[a[idx]] + y.lo[b[idx]]) * (threshold / (1 + threshold)) - 1e-9)
    keep = np.zeros(len(a), dtype=bool)
    step = max(1, 1_000_000 // x.bits.shape[1])
    for i in range(0, len(idx), step):
        j = idx[i : i + step]
        common = np.bitwise_count(x.bits[a[j]] & y.bits[b[j]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(x.loose[a[j]], y.loose[b[j]]), np.minimum(x.hi[a[j]], y.hi[b[j]]))
        keep[j] = most >= need[i : i + step]
    return keep


def dual_traversal(levels: list[Node], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of leaf documents (positions in the tree's order) that no bound excludes. Depth first over slices of the frontier, so memory stays bounded."""
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        keep = _may_match(levels[level], levels[level], a, b, threshold)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if not level:
            yield a, b
            continue
        below = len(levels[level - 1].lo)
        kids = np.arange(FAN)
        x = np.broadcast_to((a * FAN)[:, None, None] + kids[None, :, None], (len(a), FAN, FAN)).ravel()
        y = np.broadcast_to((b * FAN)[:, None, None] + kids[None, None, :], (len(a), FAN, FAN)).ravel()
        real = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
        x, y = x[real], y[real]
        for i in range(0, len(x), SLICE):
            stack.append((level - 1, x[i : i + SLICE], y[i : i + SLICE]))


#: Sets from which a join looks whether postings would be less work than the tree.
MANY = 500
#: What a test of two leaves costs, in entries of postings that are read.
LEAF_COST = 10


def _postings(sets: list[np.ndarray], levels: list[Node], side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """As dual_traversal of sets in the tree's order, by postings of prefixes: of two sets at the threshold, each has a common n-gram among its first size - need + 1, rarest first. None where this would be more
    work: where most sets have common n-grams, as near copies have."""
    n, sizes = len(sets), levels[0].lo
    doc = np.repeat(np.arange(n), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, times[token], doc))
    token = token[order]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    head = (place <= (sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64))[doc]) & (times[token] > 1)
    doc, token = doc[head], token[head]
    count = np.bincount(token, minlength=len(times))
    by = np.argsort(token, kind="stable")
    start, post = np.cumsum(count) - count, doc[by]
    work = np.concatenate([[0], np.cumsum(np.bincount(doc, count[token], minlength=n))]).astype(np.int64)
    if work[-1] > LEAF_COST * (n * (n - 1) // 2):
        return None
    at = np.searchsorted(doc, np.arange(n + 1))

    def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = 0
        while x < n:
            # sets of about a million entries of postings and marks at a time
            y = max(x + 1, min(x + 1 + 1_000_000 // n, int(np.searchsorted(work, work[x] + 1_000_000, side="right")) - 1))
            own, t = doc[at[x] : at[y]], token[at[x] : at[y]]
            c = count[t]
            where = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - start[t], c)
            met = np.zeros((y - x, n), dtype=bool)
            met[np.repeat(own - x, c), post[where]] = True
            a, b = np.nonzero(met)
            a += x
            some = a < b if side is None else (a < b) & ((side[a] != side[b]) | (side[a] == 0))
            a, b = a[some], b[some]
            keep = _may_match(levels[0], levels[0], a, b, threshold)
            yield a[keep], b[keep]
            x = y

    return run()


def tree_join(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j, jaccard) of the sets (none of them empty) of at least threshold, each once; of sets on the same side, unless it is 0, none."""
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    if len(sets) < 2:
        return none
    order, levels = build_tree(sets)
    side = side[order] if side is not None and side.any() else None
    found = _postings([sets[i] for i in order], levels, side, threshold) if len(sets) > MANY else None
    found = list(dual_traversal(levels, threshold) if found is None else found)
    if side is not None:
        found = [(a[meet], b[meet]) for a, b in found for meet in [(side[a] != side[b]) | (side[a] == 0)] if meet.any()]
    if not found:
        return none
    a, b = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(a, kind="stable")
    a, b = order[a[by]], order[b[by]]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(token.max()) + 1, dtype=np.int32)
    overlap = np.empty(len(a), dtype=np.int64)
    edges = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = token[starts[a[lo]] : starts[a[lo] + 1]]
        flag[own] = 1
        for i in range(lo, hi, 2000):
            js = b[i : min(hi, i + 2000)]
            n = sizes[js]
            at = np.cumsum(n) - n
            where = np.arange(n.sum()) - np.repeat(at - starts[js], n)
            overlap[i : i + len(js)] = np.add.reduceat(flag[token[where]], at)
        flag[own] = 0
    jaccard = overlap / (sizes[a] + sizes[b] - overlap)
    hit = jaccard >= threshold
    return a[hit], b[hit], jaccard[hit]


def _tasks_of(frame: pd.DataFrame, n: int, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, i, j, jaccard) of each task of a bucket, a component or a block of one with its guests: rows of the frame, and pairs of places in rows."""
    texts, every = frame["text"].tolist(), []
    for part in chunks(texts):
        every += gram_sets(texts[part], n)
    # of the rows that share an id one of the chosen n-gram set takes part
    chosen = np.array([len(s) > 0 and np.add.reduce(s) == h for s, h in zip(every, frame["h1"].to_numpy().astype(U64))], dtype=bool)
    ids, sides = frame["id"].to_numpy(), frame["side"].to_numpy()
    for rows in frame.groupby(["component", "task"], sort=False).indices.values():
        rows = rows[chosen[rows]]
        rows = rows[np.unique(ids[rows], return_index=True)[1]]
        yield rows, *tree_join([every[r] for r in rows], threshold, sides[rows])


def _pairer(n: int, threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        ids, out = frame["id"].to_numpy(), [pd.DataFrame({"a": [], "b": [], "jaccard": []})]
        for rows, i, j, jac in _tasks_of(frame, n, threshold):
            x, y = ids[rows[i]], ids[rows[j]]
            out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "jaccard": jac}))
        return pd.concat(out)

    return run


def _linker(n: int, threshold: float):
    """The documents that have partners in a task: (id, links, root); links counts copies, root is the least id of those that the task's pairs join."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        out = [pd.DataFrame({"id": [], "links": [], "root": []}, dtype=np.int64)]
        for rows, i, j, _ in _tasks_of(frame, n, threshold):
            ids, times = frame["id"].to_numpy()[rows], frame["n"].to_numpy()[rows]
            links = np.bincount(i, times[j], len(rows)) + np.bincount(j, times[i], len(rows))
            label = join_labels(np.arange(len(rows)), i, j)
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": least[label[some]]}))
        return pd.concat(out)

    return run


def _tasks(members: DataFrame, threshold: float, most: int, met: DataFrame | None = None) -> DataFrame:
    """members (id, component, size, h1, n) with their tasks: the whole component if it has at most so many n-grams; else it is cut into blocks of at most about so many, each of one step of size. Documents whose most
    common n-gram of met (h1, token) is the same are together, or cut by hash if they are more than a block; others fill blocks by hash. A block's task also has its guests: the documents of later blocks, of
    its step or a neighbouring one, that meet one of its own, as only these may match it. Guests of more than a block's n-grams come in several tasks. side: 0 meets all, 1 only guests, 2 is a guest.
    Sizes two steps apart differ by more than the threshold allows. Without met all documents of a component meet."""
    # a little wider than the threshold needs, so that rounding loses nothing
    step = F.floor(F.log("size") / (1.0001 * max(0.01, log(1 / threshold)))).cast("long")
    sized = members.join(members.groupBy("component").agg(F.sum("size").alias("all")), "component")
    columns = ("id", "component", "task", "side", "size", "h1", "n")
    whole = sized.where(F.col("all") <= most).withColumns({"task": F.lit("all"), "side": F.lit(0)}).select(*columns)
    large = materialise(sized.where(F.col("all") > most).drop("all").withColumn("step", step), "large")
    count = large.count()
    if not count:
        return whole
    few = F.broadcast if count * 80 <= BROADCAST_BYTES else lambda d: d
    met = large.select("h1", F.col("component").alias("token")) if met is None else met
    met = materialise(met.join(few(large.select("h1").distinct()), "h1").select("h1", "token").distinct(), "meetings")
    label = met.join(met.groupBy("token").agg(F.count("*").alias("times")), "token").groupBy("h1").agg(F.max(F.struct("times", "token"))["token"].alias("label"))
    labelled = large.join(label, "h1", "left").withColumn("label", F.coalesce("label", "h1"))
    group = labelled.groupBy("component", "step", "label").agg(F.sum("size").alias("grams"))
    bins = labelled.groupBy("component", "step").agg(F.ceil(F.sum("size") / most).alias("bins"))
    cut = group.join(bins, ["component", "step"]).select("component", "step", "label", F.ceil(F.col("grams") / most).alias("k"), "bins")
    own = F.when(F.col("k") > 1, F.xxhash64("component", "step", "label", F.pmod(F.xxhash64("id"), "k"))).otherwise(F.xxhash64("component", "step", F.pmod(F.xxhash64("label"), "bins")))
    placed = materialise(labelled.join(cut, ["component", "step", "label"]).select("id", "component", "size", "h1", "n", "step", own.alias("block")), "blocks")
    here = met.join(few(placed.select("h1", "step", "block")), "h1")
    there = here.select("token", F.col("step").alias("to_step"), F.col("block").alias("to")).distinct()
    several = there.groupBy("token").agg(F.min("to").alias("least"), F.max("to").alias("last")).where("least < last").select("token")
    seen = here.join(several, "token").join(there, "token").where((F.col("block") > F.col("to")) & (F.abs(F.col("step") - F.col("to_step")) <= 1)).select("h1", "to").distinct()
    guests = materialise(seen.join(few(placed), "h1").where(F.col("block") > F.col("to")).select("id", "component", "size", "h1", "n", F.col("to").alias("block")), "guests")
    turns = guests.groupBy("block").agg(F.ceil(F.sum("size") / most).alias("turns"))
    task = F.concat_ws("/", F.col("block").cast("string"), F.col("turn").cast("string")).alias("task")
    hosts = placed.join(turns, "block", "left").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("turns", F.lit(1).cast("long")) - 1)))
    hosts = hosts.select("id", "component", task, F.when(F.col("turn") == 0, 0).otherwise(1).alias("side"), "size", "h1", "n")
    guests = guests.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), "turns")).select("id", "component", task, F.lit(2).alias("side"), "size", "h1", "n")
    return whole.unionByName(hosts).unionByName(guests)


def _routed(docs: DataFrame, n: int, threshold: float, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, object]:
    """(documents, representatives, tasks): documents (id, size, h1, h2) and representatives (h1, h2, size, rep, n) of those with a word, and the representatives that may have partners, with their texts, grouped by bucket of tasks."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_RANGES, max(1, size // RANGE_BYTES)))
    sent = d.mapInArrow(_spread(n, parts), _SENT_SQL).repartitionById(parts, "part").mapInArrow(_shared(parts), _SENT_SQL).repartitionById(parts, "part")
    route = materialise(sent.mapInArrow(_prefixes(threshold), "id long, size long, h1 long, h2 long, token long"), "routes")
    own = route.where("token is null").groupBy("id").agg(F.min(F.struct("h1", "h2", "size")).alias("s")).select("id", "s.*")
    reps = materialise(own.groupBy("h1", "h2", "size").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "representatives")
    met = route.where("token is not null").select("token", "h1")
    edges = met.join(met.groupBy("token").agg(F.min("h1").alias("m")), "token").where("h1 <> m").select("h1", "m")
    members = components(edges, "h1", "m").select(F.col("id").alias("h1"), "component").join(reps, "h1").select(F.col("rep").alias("id"), "component", "size", "h1", "n")
    tasks = materialise(_tasks(members, threshold, block * 500, met), "tasks")
    count, grams = tasks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, grams // (block * 500))
    tasks = tasks.withColumn("bucket", F.pmod(F.xxhash64("component", "task"), F.lit(buckets))).drop("size")
    small = F.broadcast(tasks) if count * 80 <= BROADCAST_BYTES else tasks
    return own, reps, d.join(small, "id").groupBy("bucket")


def near_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): copies (id, rep) has each document with at least one word; rep is the least id of those with the same n-gram set.
    pairs (a, b, jaccard), a < b, has each pair of representatives of at least threshold. For results of which the pairs are wanted; see ngram_jaccard_join for nulls and ties."""
    own, reps, tasks = _routed(docs, n, threshold, block, id_col, text_col)
    pairs = materialise(tasks.applyInPandas(_pairer(n, threshold), "a long, b long, jaccard double"), "pairs")
    return own.join(reps, ["h1", "h2", "size"]).select("id", "rep"), pairs


def _classes(docs: DataFrame, n: int, threshold: float, block: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, links) of each document with at least one word."""
    own, reps, tasks = _routed(docs, n, threshold, block, id_col, text_col)
    found = materialise(tasks.applyInPandas(_linker(n, threshold), "id long, links long, root long"), "links")
    classes = components(found, "id", "root").select(F.col("id").alias("rep"), "component")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    by_rep = reps.join(links, "rep", "left").join(classes, "rep", "left").select("h1", "h2", "size", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return own.join(by_rep, ["h1", "h2", "size"]).select("id", "class_id", "links")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links), one row for each id: links is the number of other documents whose n-gram Jaccard with it is at least threshold, class_id the least
    id of those that such links join, its own without links. Every link counts.

    Rows of null id are left out. Null texts, and texts without a word, have no links. Rows that share an id are one document: where their
    n-grams differ, the row of least set hash counts. Ids are whole numbers, or strings of them (others raise). Other columns are ignored, whatever their names. No rows give no rows."""
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()
    known = _classes(docs, n, threshold, block, id_col, text_col)
    return every.join(known, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a near-duplicate class other than its least id. Rows without id, text or words stay; rows that share an id stay or go together."""
    gone = materialise(_classes(docs, n, threshold, block, id_col, text_col).where("id <> class_id").select("id"), "gone")
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    key = docs[f"`{id_col}`"].cast("long")
    return docs.join(gone, key == gone["id"], "left_anti")


def sql_ngram_jaccard_join(threshold: float = THRESHOLD, n: int = N) -> str:
    """ngram_jaccard_join of documents by brute force."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o / (x.n + y.n - o)::DOUBLE >= {threshold}),
r(id, too) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.too),
c AS (SELECT id, min(too) AS class_id FROM r GROUP BY id), l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.id AS doc_id, c.class_id, coalesce(l.links, 0)::BIGINT AS links FROM c LEFT JOIN l ON l.a = c.id"""
