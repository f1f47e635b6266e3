"""Exact embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length one, so that a cosine threshold t is a distance of at most sqrt(2 - 2t). Equal vectors collapse to one representative, the least id, with a count.
Representatives are cut into blocks, each block becomes a cover tree once, and each pair of blocks (and each with itself) is a task that gets both trees and joins them.

A cover tree's levels are nested: the centres of a level, at radius r, stay centres on the next one, at r / 2, where points that no centre covers become new ones. So
centres of a level are more than its radius apart, in the whole block, and each new one lies within its parent's radius. A node carries its covering radius, the greatest
distance from its centre to a point below it. The dual traversal starts from the pair of roots and drops a node pair as soon as the distance of its centres exceeds both
covering radii and the threshold together; what is left of a node against many is one matrix product. Bounds are tested in single precision with room for its error, pairs of
points that are left in double precision. No bound is a guess, so the result is exact.

Blocks are by nearest pivot, in the order of a cover tree of the pivots, then by hash within a large pivot's cell: near vectors share a block, and pairs of blocks that the
covering bound excludes are never shipped. In data without clusters few are, and the work grows with the square of the number of distinct vectors, as for any exact method.

A task returns a row for each vector with a partner in it: how many it has, and one partner that stands for its part of the task. So clusters never leave a task as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_labels, materialise

THRESHOLD = 0.9
#: Vectors in a block at most, and tasks to aim at where fewer blocks would do.
BLOCK, TASKS = 16384, 48
#: Pivots for each block's worth of vectors, and bytes of pivots that are broadcast at most: larger cells are cut by hash.
PIVOTS_EACH, PIVOT_BYTES = 4, 32 << 20
FIRST_RADIUS, LEVELS = 2.0, 12
#: Cosines are reported, and held against the threshold, rounded to so many places, so that the order of summation does not matter.
PLACES = 6
#: Rows and columns of a matrix product; node pairs under DENSE are looked at one by one.
ROWS, COLUMNS, DENSE = 128, 4096, 2048
#: Pairs verified at a time.
STEP = 1 << 15
#: What single precision may be off by, in squared distances of unit vectors.
SLACK = 2e-5


class CoverTree:
    """Points in the order of the tree: a node's points are neighbours, its centre the first of them. level[p] is the first level at which point p is a centre;
    cover[k][p] the covering radius of the node of centre p at level k. The nodes of the last level are the points."""

    def __init__(self, x: np.ndarray, level: np.ndarray, cover: np.ndarray):
        self.x, self.x32, self.level, self.cover = x, x.astype(np.float32), level, cover
        self.nodes = [np.flatnonzero(level <= k) for k in range(len(cover))]
        self.first = [np.searchsorted(below, here) for here, below in zip(self.nodes, self.nodes[1:])]
        self.count = [np.diff(np.append(f, len(below))) for f, below in zip(self.first, self.nodes[1:])]


def radii(leaf: float, first: float = FIRST_RADIUS, depth: int = LEVELS) -> list[float]:
    return [first] + [r for k in range(1, depth) if (r := first / 2**k) > leaf]


def build(x: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, level, cover): the points' order in the tree, and the tree's arrays in this order. See CoverTree."""
    n, rs = len(x), radii(leaf)
    last = len(rs)
    level, parent = np.full(n, last), np.zeros(n, dtype=np.int64)
    near, who = np.full(n, np.inf), np.zeros(n, dtype=np.int64)

    def add(new: np.ndarray) -> None:
        for i in range(0, n, 8192):
            d = _distances(x[i : i + 8192], x[new])
            at = d.argmin(axis=1)
            low = d[np.arange(len(d)), at]
            closer = low < near[i : i + 8192]
            near[i : i + 8192][closer], who[i : i + 8192][closer] = low[closer], new[at[closer]]
        near[new], who[new] = 0.0, new

    level[0] = 0
    add(np.zeros(1, dtype=np.int64))
    for k in range(1, last):
        above = who.copy()
        while len(bare := np.flatnonzero(near > rs[k])[:512]):
            inner = _distances(x[bare], x[bare])
            open_, chosen = np.ones(len(bare), dtype=bool), []
            for q in range(len(bare)):
                if open_[q]:
                    open_ &= inner[q] > rs[k]
                    chosen.append(q)
            new = bare[chosen]
            level[new], parent[new] = k, above[new]
            add(new)
    rest = level == last
    parent[rest] = who[rest]
    chain = [np.arange(n)]  # the centre that each point is below, from the last level up
    for k in range(last - 1, -1, -1):
        up = chain[-1]
        chain.append(np.where(level[up] > k, parent[up], up))
    chain.reverse()
    keys = [np.where(chain[k] == chain[k - 1], -1, chain[k]) for k in range(last, 0, -1)]  # a centre comes before what it covers
    order = np.lexsort(keys) if keys else np.arange(n)
    cover = np.zeros((last + 1, n))
    for k in range(last):
        np.maximum.at(cover[k], chain[k], _row_distance(x, x[chain[k]]))
    return order, level[order], cover[:, order]


def tree_of(x: np.ndarray, leaf: float) -> tuple[np.ndarray, CoverTree]:
    """The order of the points, and the tree over them in this order."""
    order, level, cover = build(x, leaf)
    return order, CoverTree(x[order], level, cover)


def _row_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + count[0] - 1, and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _pairs_below(a: CoverTree, b: CoverTree, k: int, u: np.ndarray, v: np.ndarray, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of nodes of level k + 1 below the node pairs (u, v), in order of u, that the bound does not exclude. In one tree each pair comes one way round."""
    room = np.float32(reach)
    pa_, pb, ra, rb = a.nodes[k + 1], b.nodes[k + 1], a.cover[k + 1].astype(np.float32), b.cover[k + 1].astype(np.float32)
    ca, cb = a.count[k][u], b.count[k][v]
    edges = np.flatnonzero(np.diff(u, prepend=-1, append=-1))
    total = ca[edges[:-1]] * np.add.reduceat(cb, edges[:-1])
    for at in np.flatnonzero(total >= DENSE):
        lo, hi = edges[at], edges[at + 1]
        x0, x1 = a.first[k][u[lo]], a.first[k][u[lo]] + ca[lo]
        ys = _ranges(b.first[k][v[lo:hi]], cb[lo:hi])
        for i in range(x0, x1, ROWS):
            p = pa_[i : min(x1, i + ROWS)]
            left, edge = 2 * a.x32[p], (ra[p] + room)[:, None]
            for j in range(0, len(ys), COLUMNS):
                y = ys[j : j + COLUMNS]
                q = pb[y]
                t = edge + rb[q]
                t *= t
                t += left @ b.x32[q].T  # 2 - 2 cos <= (radii + reach)**2
                s, r = np.nonzero(t >= np.float32(2 - SLACK))
                xs, r = s + i, y[r]
                if same:
                    once = xs <= r
                    xs, r = xs[once], r[once]
                if len(xs):
                    yield xs, r
    few = np.repeat(total < DENSE, np.diff(edges))
    u, v, ca, cb = u[few], v[few], ca[few], cb[few]
    cut = np.concatenate([[0], np.cumsum(ca * cb)])
    s = 0
    while s < len(u):
        e = max(s + 1, int(np.searchsorted(cut, cut[s] + STEP, side="right")) - 1)
        size = ca[s:e] * cb[s:e]
        which = np.repeat(np.arange(e - s), size)
        offset = np.arange(len(which)) - np.repeat(cut[s:e] - cut[s], size)
        x, y = a.first[k][u[s:e]][which] + offset // cb[s:e][which], b.first[k][v[s:e]][which] + offset % cb[s:e][which]
        if same:
            once = (x <= y) | (u[s:e] != v[s:e])[which]
            x, y = x[once], y[once]
        p, q = pa_[x], pb[y]
        t = ra[p] + rb[q] + room
        keep = t * t + 2 * np.einsum("ij,ij->i", a.x32[p], b.x32[q]) >= 2 - SLACK
        if keep.any():
            yield x[keep], y[keep]
        s = e


def dual_join(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (i in a, j in b) at a distance of at most reach, and some beyond it by rounding; if both are the same tree, each pair i < j once. Depth first, so that few node pairs wait at a time."""
    same, last = a is b, len(a.nodes) - 1

    def walk(k: int, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if k == last:
            yield (u[u != v], v[u != v]) if same else (u, v)
            return
        for x, y in _pairs_below(a, b, k, u, v, reach, same):
            yield from walk(k + 1, x, y)

    root = np.zeros(1, dtype=np.int64)
    return walk(0, root, root) if len(a.x) and len(b.x) else iter(())


def reach_of(threshold: float) -> float:
    return sqrt(max(0.0, 2 - 2 * (threshold - 10.0**-PLACES)))


def joined(a: CoverTree, b: CoverTree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of a's and b's points, of at least threshold, some at a time."""
    for i, j in dual_join(a, b, reach_of(threshold)):
        for s in range(0, len(i), STEP):
            x, y = i[s : s + STEP], j[s : s + STEP]
            c = np.round(np.einsum("ij,ij->i", a.x[x], b.x[y]), PLACES)
            hit = c >= threshold
            if hit.any():
                yield x[hit], y[hit], c[hit]


def leaf_radius(threshold: float) -> float:
    """Radii below an eighth of the threshold's distance part little that the points' own check does not."""
    return max(reach_of(threshold) / 8, 1e-3)


def tree_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j, cosine) of unit vectors x[i], y[j], or i and j of x if y is None, of at least threshold, each pair once."""
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    if not len(x) or (y is not None and not len(y)):
        return none
    order_a, a = tree_of(x, leaf_radius(threshold))
    order_b, b = (order_a, a) if y is None else tree_of(y, leaf_radius(threshold))
    found = [(order_a[i], order_b[j], c) for i, j, c in joined(a, b, threshold)]
    return tuple(np.concatenate(f) for f in zip(*found)) if found else none


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which, unit vectors): the positions of vectors that have a direction, and these scaled to length one. Null, empty and zero vectors, and those with null, NaN or infinite entries, have none."""
    size = np.diff(vectors.offsets.to_numpy()) if vectors.null_count == 0 else np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()])
    width = int(size.max()) if len(size) else 0
    ok = np.flatnonzero(size == width) if width else np.empty(0, dtype=np.int64)
    if not len(ok):
        return ok, np.empty((0, 0))
    flat = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), width)
    with np.errstate(all="ignore"):
        largest = np.abs(flat).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        ok, flat = ok[good], flat[good] / largest[good][:, None]
        return ok, flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _assign(shared):
    """(id, n, v) -> (id, n, v, pivot, distance), v the unit vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                ok, x = units(batch.column(2))
                if not len(ok):
                    continue
                d = _distances(x, pivots)
                cell = d.argmin(axis=1)
                take = batch.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell), pa.array(_row_distance(x, pivots[cell]))], names=["id", "n", "v", "pivot", "distance"])

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), dtype=np.float64).reshape(len(column), -1)


def _grower(threshold: float):
    """A block's vectors -> the same in the order of their cover tree, with its arrays."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order, level, cover = build(_matrix(frame["v"]), leaf_radius(threshold))
        frame = frame.iloc[order]
        return pd.DataFrame({"block": frame["block"], "pos": np.arange(len(frame)), "id": frame["id"], "n": frame["n"], "v": frame["v"], "level": level, "cover": [c.tobytes() for c in cover.T]})

    return run


def _task_trees(frame: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], list[CoverTree]]:
    """(ids, counts, trees) of a task's sides, 1 and 2; of the one side 0 if it is a block with itself. None if a side has no vectors."""
    ids, counts, trees = [], [], []
    for _, side in sorted(frame.groupby("side"), key=lambda x: x[0]):
        side = side.sort_values("pos")
        ids.append(side["id"].to_numpy()), counts.append(side["n"].to_numpy())
        trees.append(CoverTree(_matrix(side["v"]), side["level"].to_numpy(), _matrix(side["cover"]).T))
    return (ids, counts, trees) if len(trees) == 2 or not frame["side"].any() else ([], [], [])


def _pairer(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, _, trees = _task_trees(frame)
        if not trees:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        found = [(ids[0][i], ids[-1][j], c) for i, j, c in joined(trees[0], trees[-1], threshold)]
        if not found:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        x, y, c = (np.concatenate(f) for f in zip(*found))
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": c})

    return run


def _linker(threshold: float):
    """A task's vectors that have partners in it: (id, links, root); links counts copies, root is the least id of those that the task's pairs join."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, counts, trees = _task_trees(frame)
        if not trees:
            return pd.DataFrame({"id": [], "links": [], "root": []}, dtype=np.int64)
        every, times, shift = np.concatenate(ids), np.concatenate(counts), len(ids[0]) if len(ids) > 1 else 0
        label, links = np.arange(len(every)), np.zeros(len(every))
        for i, j, _ in joined(trees[0], trees[-1], threshold):
            j = j + shift
            links += np.bincount(i, times[j], len(every)) + np.bincount(j, times[i], len(every))
            label = join_labels(label, i, j)
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, label, every)
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": every[some], "links": links[some].astype(np.int64), "root": least[label[some]]})

    return run


def _neighbouring(shared, reach: float):
    """Block numbers -> (a, b), a <= b, of the pairs of blocks that the cells' covering radii do not exclude."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, block, cell, cover = shared.value
        for frame in frames:
            for i in frame["id"]:
                own = np.flatnonzero(block == i)
                hit = np.zeros(len(block), dtype=bool)
                for s in range(0, len(block), 8192):
                    hit[s : s + 8192] = (_distances(pivots[cell[own]], pivots[cell[s : s + 8192]]) <= cover[own][:, None] + cover[None, s : s + 8192] + reach + 1e-5).any(axis=0)
                b = np.unique(block[hit])
                b = b[b >= i]
                yield pd.DataFrame({"a": np.full(len(b), i), "b": b})

    return run


def _records(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2) of the records that have a direction, one an id, written; equal vectors have equal hashes."""
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    d = d.where("id is not null and v is not null and not exists(v, e -> e is null or isnan(e) or abs(e) = double('inf')) and exists(v, e -> e <> 0)")
    return materialise(d.groupBy("id").agg(F.min("v").alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}), "vectors")


def _routed(one: DataFrame, threshold: float, block: int | None) -> DataFrame | None:
    """The representatives' trees, once for each task: (task, side, pos, id, n, v, level, cover). None without representatives."""
    spark = one.sparkSession
    n = one.count()
    if not n:
        return None
    if block is None:
        block = min(BLOCK, max(1024, ceil(n / sqrt(2 * TASKS))))
    blocks = ceil(n / block)
    width = len(one.select("v").first()["v"])
    share = min(1.0, min(blocks * PIVOTS_EACH, max(1, PIVOT_BYTES // (8 * width))) / n)
    wanted = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(max(1, ceil(share * (1 << 30)))))
    rows = wanted.select("v").collect() or one.select("v").limit(1).collect()  # of bounded bytes, whatever n
    pivots = units(pa.array([r["v"] for r in rows], pa.list_(pa.float64())))[1]
    pivots = tree_of(pivots, leaf_radius(threshold))[1].x
    placed = materialise(one.mapInArrow(_assign(spark.sparkContext.broadcast(pivots)), "id long, n long, v binary, pivot long, distance double"), "placed")
    cells = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("cover")).orderBy("pivot").collect()
    # cells fill blocks in the order of the pivots' tree; a cell of more than a block is cut by hash
    plan, at, fill, covers = [], 0, 0, []
    for c in cells:
        parts = max(1, ceil(c["n"] / block))
        if fill and fill + c["n"] > block:
            at, fill = at + 1, 0
        plan.append((c["pivot"], at, parts))
        covers += [(at + k, c["pivot"], float(c["cover"])) for k in range(parts)]
        at, fill = (at + parts - 1, block) if parts > 1 else (at, fill + c["n"])
    count = at + 1
    where = F.broadcast(spark.createDataFrame(plan, "pivot long, at long, parts long"))
    blocked = placed.join(where, "pivot").select("id", "n", "v", (F.col("at") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    trees = materialise(blocked.repartition(min(count, 20_000), "block").groupBy("block").applyInPandas(_grower(threshold), "block long, pos long, id long, n long, v binary, level long, cover binary"), "trees")
    shared = spark.sparkContext.broadcast((pivots, *(np.array(x) for x in zip(*covers))))
    links = materialise(spark.range(0, count, 1, min(count, 2000)).mapInPandas(_neighbouring(shared, reach_of(threshold)), "a long, b long"), "block-pairs")
    task = F.col("a") * F.lit(count) + F.col("b")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("b").alias("block"), F.lit(2).alias("side"))))
    tasks = links.select(task.alias("task"), F.explode(sides).alias("s")).select("task", "s.block", "s.side")
    return trees.join(tasks, "block").drop("block").repartition(min(max(1, links.count()), 20_000), "task").groupBy("task")


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): copies (id, rep) has every record with a direction and the least id of its equals, pairs (a, b, cosine) those of representatives, a < b. For results of which the pairs are wanted; near_duplicates says who is near in a row a record."""
    spark = vectors.sparkSession
    d = _records(vectors, id_col, vector_col)
    first = d.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    pairs = spark.createDataFrame([], "a long, b long, cosine double")
    for w in _widths(d):
        one = d.where(F.size("v") == w).join(first.select("rep", "n"), F.col("id") == F.col("rep")).select("id", "n", "v")
        if (routed := _routed(one, threshold, block)) is not None:
            pairs = pairs.unionByName(routed.applyInPandas(_pairer(threshold), "a long, b long, cosine double"))
    return d.select("id", "h1", "h2").join(first, ["h1", "h2"]).select("id", "rep"), materialise(pairs, "vector-pairs")


def _widths(d: DataFrame) -> list[int]:
    """The lengths of the vectors. Vectors of different lengths have no cosine, so each length is a join of its own."""
    return sorted(r["w"] for r in d.select(F.size("v").alias("w")).distinct().collect())


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links), one row for each id: links is the number of other records whose cosine with it, rounded to PLACES, is at least threshold; class_id the least
    id of those that such links join, its own without links. Every link counts, in whatever way the records are cut into tasks.

    Vectors without a direction (null, empty, zero, or with null, NaN or infinite entries) have no links; nor have vectors of different lengths to each other. Null ids are left out. Rows that share an
    id are one record, that of the least vector, entry by entry, of those with a direction. Ids are whole numbers, or strings of them (others raise). Other columns are ignored, whatever their names. No rows give no rows."""
    spark = vectors.sparkSession
    d = _records(vectors, id_col, vector_col)
    first = materialise(d.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "representatives")
    found = spark.createDataFrame([], "id long, links long, root long")
    for w in _widths(d):
        one = d.where(F.size("v") == w).join(first.select("rep", "n"), F.col("id") == F.col("rep")).select("id", "n", "v")
        if (routed := _routed(one, threshold, block)) is not None:
            found = found.unionByName(routed.applyInPandas(_linker(threshold), "id long, links long, root long"))
    found = materialise(found, "links")
    classes = components(found, "id", "root").select(F.col("id").alias("rep"), "component")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    by_rep = first.join(links, "rep", "left").join(classes, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    known = d.select("id", "h1", "h2").join(by_rep, ["h1", "h2"]).select("id", "class_id", "links")
    every = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()
    return every.join(known, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def sql_near_duplicates(threshold: float = THRESHOLD) -> str:
    """near_duplicates of embeddings by brute force."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), {PLACES}) >= {threshold}),
r(id, too) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.too),
c AS (SELECT id, min(too) AS class_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.id AS vec_id, c.class_id, coalesce(n.links, 0)::BIGINT AS links FROM c LEFT JOIN n ON n.a = c.id"""
