"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree over them, and a chi-square stopping test.

Every vector gets M Gaussian projections (2-stable: a projected squared distance over the true squared distance follows the chi-square law of M degrees of freedom).
A kd-tree indexes the projections. A query takes its neighbours in order of projected distance, verifies them by true distance, and stops once
chi-square of (next projected squared distance / squared distance of the k-th best) reaches P: any point not seen yet that is
better than the k-th best would have been seen by then with probability P.

Equal vectors are searched as one, which carries the k + 1 least of their ids: so a vector that very many records have is no task of its own.

At scale the top of the kd-tree is the partitioning: its cells, of about CELL vectors, are tasks. A first round searches each query's own cell, and so bounds its
k-th distance; the second sends queries on, a leaf of them at a time, only to cells whose box in the projections passes the same test. A cell that many queries
ask is several tasks, so many as its queries need. Each side of a task stays an array, so verification is matrix products over the queries of one leaf and the points of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K, M, P, SEED = 10, 12, 0.97, 29
#: Vectors in a cell, and in a leaf; beyond MOST_CELLS cells grow, so the boxes that are broadcast are 13 MB at most. Queries of a task.
CELL, LEAF, MOST_CELLS, ASKERS = 8192, 256, 65536, 4096
#: Sampled projections for each cell, and in all, from which the cells' boundaries are set. Any boundaries give the same neighbours' guarantee.
SAMPLES_EACH, SAMPLES = 64, 400_000
#: Squared distances are compared and reported rounded to so many places; of equal ones the least id comes first.
PLACES = 6
#: The query asks for the vectors whose id this divides, among all.
EVERY = 20


def chi_square(x: float, m: int) -> float:
    """The distribution function of chi-square with m degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = m / 2, x / 2
    term = total = 1.0 / a
    n = 1
    while term > total * 1e-15 and n < 10_000:
        term *= z / (a + n)
        total += term
        n += 1
    return min(1.0, total * exp(-z + a * log(z) - lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square(hi, m) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def projection(width: int, m: int = M, seed: int = SEED) -> np.ndarray:
    """(width, m) Gaussian entries. Every place computes the same ones."""
    return np.random.RandomState(seed).standard_normal((width, m))


class KdTree:
    """leaves of at most `leaf` points as slices of order, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        cuts, stack = [], [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= leaf:
                cuts.append((lo, hi))
                continue
            part = self.order[lo:hi]
            axis = int(np.argmax(points[part].max(axis=0) - points[part].min(axis=0)))
            half = (hi - lo) // 2
            self.order[lo:hi] = part[np.argpartition(points[part, axis], half)]
            stack += [(lo, lo + half), (lo + half, hi)]
        self.cuts = np.array(sorted(cuts), dtype=np.int64).reshape(-1, 2)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.cuts]).reshape(-1, points.shape[1])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.cuts]).reshape(-1, points.shape[1])


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points q to boxes: (points, boxes)."""
    out = np.zeros((len(q), len(low)))
    for c in range(q.shape[1]):
        x = q[:, c : c + 1]
        gap = np.maximum(np.maximum(low[None, :, c] - x, x - high[None, :, c]), 0)
        out += gap * gap
    return out


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, projection_: np.ndarray, k: int, limit: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, squared distance) of the k nearest found of x for each of q, never the query's own id. limit is the chi-square quantile of the stopping test;
    bound has what is known of each query's k-th squared distance. Rows are in order of query, distance and id."""
    n = len(q)
    best = np.full(n, np.inf) if bound is None else bound.astype(np.float64).copy()
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    if not n or not len(x):
        return none
    pq, px = q @ projection_, x @ projection_
    mine, tree = KdTree(pq), KdTree(px)
    norm = np.einsum("ij,ij->i", x, x)
    norm_q = np.einsum("ij,ij->i", q, q)
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    slack = 1e-5 * (1 + float(norm.max()) + float(norm_q.max()))  # what single precision may be off by
    found = ([], [], [])
    for a, b in mine.cuts:
        group = mine.order[a:b]
        near = box_distance2(pq[group], tree.low, tree.high)
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]  # query's place in group, id, squared distance
        for leaf in np.argsort(near.min(axis=0), kind="stable"):
            live = np.flatnonzero(near[:, leaf] <= limit * best[group])
            if not len(live):
                continue
            points = tree.order[tree.cuts[leaf, 0] : tree.cuts[leaf, 1]]
            rough = norm_q[group[live]][:, None] + norm[points][None, :] - 2 * (q32[group[live]] @ x32[points].T)
            i, j = np.nonzero(rough <= best[group[live]][:, None] + slack)
            if not len(i):
                continue
            if len(i) > 8 * k * len(live):  # so early that nearly all pass: verify the nearest only
                keep = np.argpartition(rough, min(2 * k + 8, len(points) - 1), axis=1)[:, : 2 * k + 8]
                edge = np.take_along_axis(rough, keep, axis=1).max(axis=1) + slack
                i, j = np.nonzero(rough <= np.minimum(edge, best[group[live]] + slack)[:, None])
            gi, pj = live[i], points[j]
            other = q_ids[group[gi]] != x_ids[pj]
            gi, pj = gi[other], pj[other]
            diff = q[group[gi]] - x[pj]
            d2 = np.round(np.einsum("ij,ij->i", diff, diff), PLACES)
            held = _top([np.concatenate([held[0], gi]), np.concatenate([held[1], x_ids[pj]]), np.concatenate([held[2], d2])], k)
            place, count = np.unique(held[0], return_counts=True)
            full = place[count == k]
            last = held[2][np.cumsum(count)[count == k] - 1]
            best[group[full]] = np.minimum(best[group[full]], last)
        found[0].append(group[held[0]]), found[1].append(held[1]), found[2].append(held[2])
    out = [np.concatenate(f) for f in found]
    order = np.lexsort((out[1], out[2], out[0]))
    return out[0][order], out[1][order], out[2][order]


def _top(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k least (distance, id) of each query, an id once."""
    order = np.lexsort((held[1], held[2], held[0]))
    a, b, c = (h[order] for h in held)
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    a, b, c = a[fresh], b[fresh], c[fresh]
    start = np.flatnonzero(np.diff(a, prepend=-1))
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return [a[rank < k], b[rank < k], c[rank < k]]


def build_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """The top of the kd-tree as nodes (axis, cut, left, right); a leaf is (-1, 0, cell, 0)."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    made, queue = 1, [(0, np.arange(len(sample)))]
    leaves = [0]
    while made < cells and queue:
        at, part = queue.pop(0)
        if len(part) < 2:
            continue
        spread = sample[part].max(axis=0) - sample[part].min(axis=0)
        axis = int(spread.argmax())
        if spread[axis] == 0:
            continue
        cut = float(np.median(sample[part, axis]))
        left = sample[part, axis] < cut
        if not left.any():
            left = sample[part, axis] <= cut
            cut = float(np.nextafter(cut, np.inf))
        nodes[at] = (axis, cut, len(nodes), len(nodes) + 1)
        for side in (part[left], part[~left]):
            queue.append((len(nodes), side))
            nodes.append((-1, 0.0, 0, 0))
        made += 1
    leaves = [i for i, n in enumerate(nodes) if n[0] < 0]
    for cell, i in enumerate(leaves):
        nodes[i] = (-1, 0.0, cell, 0)
    return nodes


def locate(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each point."""
    out = np.zeros(len(points), dtype=np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, part = stack.pop()
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out[part] = left
        elif len(part):
            low = points[part, axis] < cut
            stack += [(left, part[low]), (right, part[~low])]
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(column.to_list()).astype(np.float64).reshape(-1, width) if len(column) else np.empty((0, width))


def _locator(shared, width: int, m: int, seed: int):
    """(id, v, asks) with their projections and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = projection(width, m, seed)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            p = x @ g
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * m, pa.int32()), pa.array(p.ravel()))
            cell = locate(p, shared.value) if shared is not None else np.zeros(len(p), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(cell)], names=["id", "v", "asks", "p", "cell"])

    return run


def _own(width: int, m: int, seed: int, k: int, limit: float):
    """A cell's queries against the cell itself."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, asks = _matrix(frame["v"], width), frame["id"].to_numpy(), np.flatnonzero(frame["asks"].to_numpy())
        q, n, d2 = search(x[asks], ids[asks], x, ids, projection(width, m, seed), k, limit)
        return pd.DataFrame({"query": ids[asks][q], "neighbour": n, "d2": d2})

    return run


def _cross(width: int, m: int, seed: int, k: int, limit: float):
    """A task has the points of a cell (side 0) and the queries sent to it (side 1, with bounds)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["side"].to_numpy()
        v, ids = _matrix(frame["v"], width), frame["id"].to_numpy()
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        q, n, d2 = search(v[a], ids[a], v[b], ids[b], projection(width, m, seed), k, limit, frame["bound"].to_numpy()[a])
        return pd.DataFrame({"query": ids[a][q], "neighbour": n, "d2": d2})

    return run


def _sender(shared, width: int, m: int, seed: int, limit: float):
    """(id, cell, bound, v) -> a row for each other cell whose box passes the stopping test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (low, high) = projection(width, m, seed), shared.value
        step = max(1, 8_000_000 // max(1, len(low)))
        for whole in batches:
            for s in range(0, whole.num_rows, min(1024, step)):
                batch = whole.slice(s, min(1024, step))
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                near = box_distance2(x @ g, low, high)
                near[np.arange(len(x)), batch.column(1).to_numpy()] = np.inf
                i, j = np.nonzero(near <= limit * batch.column(2).to_numpy(zero_copy_only=False)[:, None])
                if len(i):
                    take = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([take.column(0), pa.array(j), take.column(2), take.column(3)], names=["id", "cell", "bound", "v"])

    return run


def _nearest(points: DataFrame, width: int, k: int, m: int, p: float, cell: int, seed: int) -> DataFrame:
    """(query, neighbour, d2) of points (id, v, asks), no two of them equal: the k nearest others of each that asks, and perhaps more."""
    spark = points.sparkSession
    total = points.count()
    limit = chi_square_quantile(p, m)
    schema = "id long, v array<double>, asks boolean, p array<double>, cell long"
    shared = None
    cells = min(MOST_CELLS, max(1, ceil(total / cell)))
    if cells > 1:
        share = min(1.0, min(SAMPLES, cells * SAMPLES_EACH) / total)
        some = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(ceil(share * (1 << 30)))).mapInArrow(_locator(None, width, m, seed), schema).select("p").collect()
        if some:
            shared = spark.sparkContext.broadcast(build_cells(np.array([r["p"] for r in some]), cells))
    placed = materialise(points.mapInArrow(_locator(shared, width, m, seed), schema), "placed")
    found = "query long, neighbour long, d2 double"
    own = materialise(placed.select("cell", "id", "v", "asks").groupBy("cell").applyInPandas(_own(width, m, seed, k, limit), found), "own")
    if shared is None:
        return own
    axes = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(m) for n, f in (("low", F.min), ("high", F.max))]
    boxes = placed.groupBy("cell").agg(*axes).collect()  # a row a cell
    count = max(b["cell"] for b in boxes) + 1
    low, high = np.full((count, m), np.inf), np.full((count, m), np.inf)
    for b in boxes:
        low[b["cell"]], high[b["cell"]] = [b[f"low{i}"] for i in range(m)], [b[f"high{i}"] for i in range(m)]
    bound = own.groupBy("query").agg(F.count("*").alias("n"), F.max("d2").alias("worst")).select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("worst")).alias("bound"))
    asking = placed.where("asks").select("id", "cell", "v").join(bound, "id", "left").select("id", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "v")
    sent = materialise(asking.mapInArrow(_sender(spark.sparkContext.broadcast((low, high)), width, m, seed, limit), "id long, cell long, bound double, v array<double>"), "sent")
    asked = F.broadcast(sent.groupBy("cell").agg(F.ceil(F.count("*") / ASKERS).alias("parts")))  # a row a cell
    queries = sent.join(asked, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(1).alias("side"), "id", "bound", "v")
    copies = placed.join(asked, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", F.lit(0.0).alias("bound"), "v")
    return own.unionByName(queries.unionByName(copies).groupBy("cell", "part").applyInPandas(_cross(width, m, seed, k, limit), found))


def neighbours(vectors: DataFrame, k: int = K, m: int = M, p: float = P, cell: int = CELL, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", ask: Column | None = None) -> DataFrame:
    """(query, neighbour, rank, distance): for each record that asks, by a condition on vectors' columns (all without one), its k nearest others by Euclidean distance, rank from 1; fewer where there are fewer others.

    Null ids, null and empty vectors, and vectors with null, NaN or infinite entries neither ask nor answer. Vectors of different lengths are not each other's neighbours. Rows that share an id are one
    record, that of the least vector, which asks if any of its rows does, and is never its own neighbour. Of equal distances (rounded to PLACES of their square) the least id comes first.
    Zero vectors are vectors. Ids are whole numbers, or strings of them (others raise). Other columns are ignored, whatever their names. A table of one record gives no rows."""
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(F.lit(True) if ask is None else ask, F.lit(False)).alias("asks"))
    d = d.where("id is not null and v is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('inf'))")
    d = materialise(d.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}), "records")
    groups = d.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"))
    # the k + 1 least ids of each vector: the limit on ranks is applied before the shuffle too
    few = d.select("h1", "h2", "id").withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1)
    ids = materialise(few.join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id"), "ids")
    near = groups.where("asks").select(F.col("rep").alias("query"), F.col("rep").alias("neighbour"), F.lit(0.0).alias("d2"))
    for w in sorted(r["w"] for r in d.select(F.size("v").alias("w")).distinct().collect()):
        points = d.where(F.size("v") == w).select("id", "v").join(groups.select(F.col("rep").alias("id"), "asks"), "id")
        near = near.unionByName(_nearest(points, w, k, m, p, cell, seed))
    ranked = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("d2", "neighbour"))).where(F.col("nth") <= k + 1)
    each = ranked.select("query", "d2", F.col("neighbour").alias("rep")).join(ids, "rep").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("nth") <= k + 1)
    lists = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("list"))
    asking = d.where("asks").select("h1", "h2", "id").join(groups.select("h1", "h2", F.col("rep").alias("query")), ["h1", "h2"]).select("query", F.col("id").alias("asker"))
    others = asking.join(lists, "query").select("asker", F.slice(F.filter("list", lambda e: e["id"] != F.col("asker")), 1, k).alias("list"))
    return others.select(F.col("asker").alias("query"), F.posexplode("list").alias("at", "e")).select("query", F.col("e.id").alias("neighbour"), (F.col("at") + 1).cast("int").alias("rank"), F.sqrt("e.d2").alias("distance"))


def sql_neighbours(k: int = K, every: int = EVERY) -> str:
    """The true neighbours in embeddings of the vectors whose id is divisible by every."""
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(a.v, b.v) ** 2, {PLACES}) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM d)
SELECT query, neighbour, rank::INTEGER AS rank, sqrt(d2) AS distance FROM r WHERE rank <= {k}"""
