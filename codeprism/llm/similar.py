"""The k most similar vectors of every vector, by cosine, over a hierarchical k-means tree.

1. Per model, the width that most vectors have is the model's width (one aggregate in the JVM).
2. A bounded sample of the vectors grows the tree; its leaves are meant to hold ``leaf_rows`` rows.
3. A set of ``probes`` vectors is compared with all vectors in blocks, which gives their true
   neighbours. From these the margin is calibrated: leaves are visited in best-bin-first order, wider
   and wider, until ``recall`` of the true neighbours has been reached.
4. Every vector is filed in its home leaf and asked of each leaf within the margin; a visit serves both
   sides, the asked vector and the rows of the leaf. The rows and visits of every leaf are counted first.
   A leaf with more than ``split_rows`` of either is cut into a grid, rows by one hash of the id and visits
   by another, so that each row meets each visit in one cell and no group holds more than twice that,
   however many copies a vector has.
   Where that would compare half of all pairs or more, as it does without a floor, the tree is left aside: the
   rows fall into blocks, and each pair of blocks is a cell in which every pair of vectors is compared once.
5. Each cell answers its queries with exact cosines; the k best of each query are merged.

Batches are taken in slices and cells in tiles, and only the k best of each row are kept on the way, so a
worker's memory does not depend on the size of a batch or on the number of hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import Tree, grow, unit

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of vectors in a slice of a batch and of the rows, or visits, of a cell; rows and columns of a tile of cosines.
SLICE, CELL, TILE = 1 << 21, 1 << 24, (512, 2048)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A well-mixed hash of ids, uniform in [0, 1)."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * MIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def one_a_row(responses: DataFrame) -> DataFrame:
    """``model, id, v``: a row for each vector that has an id, so that a batch of rows is small however many vectors a response has."""
    zipped = responses.select("model", F.explode(F.arrays_zip(F.col("vec_ids").alias("id"), F.col("vectors").alias("v"))).alias("z"))
    return zipped.select("model", F.col("z.id").alias("id"), F.col("z.v").alias("v")).where("model is not null and id is not null and v is not null")


def usable(batch: pa.RecordBatch, widths: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(model, ids, unit vectors) of the rows of a batch of (model, id, v) that can be compared.

    A vector is usable when it has its model's width and only finite numbers, and is not all zero. A batch
    comes in parts of about ``SLICE`` bytes.
    """
    ids, rows = batch.column(1).to_numpy(), batch.column(2)
    offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)  # null in a vector: nan
    long = np.diff(offsets)
    for model, width in widths.items():
        own = np.flatnonzero((long == width) & pc.equal(batch.column(0), model).to_numpy(zero_copy_only=False))
        per = max(1, SLICE // (4 * width))
        for i in range(0, len(own), per):
            at = own[i : i + per]
            yield from _clean(model, ids[at], values[offsets[at][:, None] + np.arange(width)].astype(np.float32, copy=False))


def _clean(model, ids, x):
    # scaled by the largest part first, so that the length of very large or small vectors can be told
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) if len(x) else np.zeros(0, bool)
    x = x[ok].astype(np.float64)
    if len(x):
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield model, ids[ok], unit(x).astype(np.float32)


def widths_of(source: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Of each model: the width that most of its vectors have (ties: the smaller), and how many have it."""
    lengths = source.select("model", F.size("v").alias("w")).where("w > 0")
    rows = lengths.groupBy("model", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.max_by(F.struct("w", "n"), F.struct("n", -F.col("w"))).alias("x")).collect()  # one row a model
    return {r["model"]: r["x"]["w"] for r in rows}, {r["model"]: r["x"]["n"] for r in rows}


def _sample(responses: DataFrame, widths: dict[str, int], share: dict[str, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each model, the ids and vectors whose hash is below the share; bounded, since the shares are."""

    def run(batches):
        for b in batches:
            for model, ids, x in usable(b, widths):
                keep = mixed(ids) < share[model]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([model] * int(keep.sum())), pa.array(ids[keep]), pa.array([v.tobytes() for v in x[keep]], pa.binary())], ["model", "id", "v"])

    got = responses.mapInArrow(run, "model string, id bigint, v binary").toPandas()
    out = {}
    for m, g in got.groupby("model"):
        g = g.drop_duplicates("id").sort_values("id")
        out[m] = (g.id.to_numpy(), np.frombuffer(b"".join(g.v), np.float32).reshape(-1, widths[m]))
    return out


class Best:
    """The k best (id, cosine) of each of n rows, from tiles; of equal cosines those that came first stay.

    ``over`` is what a row's next cosine must exceed: the floor at first, then a cosine that k have reached.
    With ``repeats`` an id may come several times, and counts once.
    """

    def __init__(self, n: int, k: int, floor: float | None, repeats: bool = False):
        self.k, self.repeats, self.over = k, repeats, np.full(n, -np.inf if floor is None else np.nextafter(np.float32(floor), np.float32(-1)), np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, max(4096, 2 * n * k)

    def add(self, row: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((row.astype(np.int32), ids, s))
        self.size += len(row)
        if self.size > self.most:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, cosine) of what is kept, by row, best first."""
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, ids, s = (np.concatenate(x) for x in zip(*self.parts))
        if self.repeats:
            row, ids, s = best_of(row, ids, s, self.k)
        else:  # one stable sort by row and falling cosine, as one number
            bits = s.view(np.uint32)
            falling = np.where(bits >> 31, bits, ~(bits | np.uint32(1 << 31)))
            order = np.argsort(row.astype(np.uint64) << np.uint64(32) | falling, kind="stable")
            row = row[order]
            keep = _rank(row) < self.k
            order = order[keep]
            row, ids, s = row[keep], ids[order], s[order]
        last = _rank(row) == self.k - 1
        self.over[row[last]] = np.maximum(self.over[row[last]], s[last])
        self.parts, self.size = [(row, ids, s)], len(row)
        return row, ids, s


def _rank(row: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row, in sorted rows."""
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1])[: len(row)], at, 0))


def best_of(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by row, best first; an id counts once a row, equal cosines go to the smaller id."""
    order = np.lexsort((-s, ids, row))
    row, ids, s = row[order], ids[order], s[order]
    new = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[: len(row)]
    row, ids, s = row[new], ids[new], s[new]
    order = np.lexsort((ids, -s, row))
    row, ids, s = row[order], ids[order], s[order]
    keep = _rank(row) < k
    return row[keep], ids[keep], s[keep]


def above(s: np.ndarray, over: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row that are above ``over``; of equal ones the first columns.

    ``over`` rises to the k-th largest of a row that has so many.
    """
    turned = not s.flags.c_contiguous  # in the order of memory
    hit = s.T > over if turned else s > over[:, None]
    flat = np.flatnonzero(hit)
    r, c = np.divmod(flat, hit.shape[1])
    if turned:
        r, c = c, r
    count = np.bincount(r, minlength=len(s))
    many = np.flatnonzero(count > k)
    if not len(many):
        return r, c
    few = count[r] <= k
    own = np.ascontiguousarray(s[many])
    kth = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]
    over[many] = kth
    best = own >= kth[:, None]
    for i in np.flatnonzero(np.count_nonzero(best, axis=1) > k):  # copies
        first = np.append(np.flatnonzero(own[i] > kth[i]), np.flatnonzero(own[i] == kth[i]))[:k]
        best[i] = False
        best[i, first] = True
    at, col = np.nonzero(best)
    return np.append(r[few], many[at]), np.append(c[few], col)


def _calibrate(responses, widths, trees: dict[str, Tree], probes: dict[str, tuple[np.ndarray, np.ndarray]], k: int, floor: float | None, recall: float) -> dict[str, tuple[float, int]]:
    """Of each model, the margin that reaches ``recall`` of the probes' true neighbours, and how many those are."""

    def run(batches):
        best = {m: Best(len(own), k, floor, repeats=True) for m, (own, _) in probes.items()}
        seen: dict[str, dict[int, bytes]] = {m: {} for m in probes}
        for b in batches:
            for model, ids, x in usable(b, widths):
                if model not in best:
                    continue
                (own, q), mine, vectors = probes[model], best[model], seen[model]
                for i in range(0, len(own), TILE[0]):
                    s = q[i : i + TILE[0]] @ x.T
                    s[own[i : i + TILE[0], None] == ids[None, :]] = -np.inf
                    r, c = above(s, mine.over[i : i + TILE[0]].copy(), k)  # k of a tile may be fewer vectors
                    mine.add(r + i, ids[c], s[r, c])
                    vectors.update((int(ids[j]), x[j].tobytes()) for j in np.unique(c))
                if len(vectors) > 4 * k * len(own) + 10_000:
                    kept = np.unique(mine.trim()[1])
                    seen[model] = {i: vectors[i] for i in kept.tolist()}
        for model, mine in best.items():
            r, ids, s = mine.trim()
            for i in range(0, len(r), 20_000):
                w = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(r[w])), pa.array(probes[model][0][r[w]]), pa.array(ids[w]), pa.array(s[w].astype(np.float64)), pa.array([seen[model][j] for j in ids[w].tolist()], pa.binary())], ["model", "q", "id", "s", "v"])

    hits = responses.mapInArrow(run, "model string, q bigint, id bigint, s double, v binary").dropDuplicates(["model", "q", "id"])
    first = hits.withColumn("r", F.row_number().over(Window.partitionBy("model", "q").orderBy(F.desc("s"), "id"))).where(F.col("r") <= k).toPandas()  # probes x k rows
    out = {}
    for model, tree in trees.items():
        own = first[first.model == model]
        if not len(own):
            out[model] = (0.0 if floor is not None else 2.0), 0
            continue
        ids, q = probes[model]
        near = np.frombuffer(b"".join(own.v), np.float32).reshape(-1, widths[model])
        number = {i: n for n, i in enumerate(ids)}
        of = np.array([number[i] for i in own.q])
        # a pair is seen as soon as one of the two visits the other's leaf
        there = _needed(tree, q, of, tree.home(near))
        back = _needed(tree, near, np.arange(len(near)), tree.home(q)[of])
        needed = np.sort(np.minimum(there, back))
        out[model] = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1e-4, len(needed)
    return out


def _needed(tree: Tree, q: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The margin at which query ``row`` visits ``leaf``, for each pair of the two."""
    out = np.empty(len(row))
    for i in range(0, len(q), 1024):
        at = np.flatnonzero((row >= i) & (row < i + 1024))
        rows, leaves, width = tree.visits(q[i : i + 1024], 2.0)
        table = np.full((min(1024, len(q) - i), tree.leaves), 2.0)
        table[rows, leaves] = width
        out[at] = table[row[at] - i, leaf[at]]
    return out


def search(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cosine): the k best of each of ``asked`` among ``ids`` and the reverse. Both ascend, without repeats."""
    same = np.array_equal(ids, asked)
    tiles = [slice(j, j + TILE[1]) for j in range(0, len(ids), TILE[1])]
    back = [Best(len(ids[t]), k, floor) for t in tiles]
    found = []
    for i in range(0, len(asked), TILE[0]):
        own, who = slice(i, i + TILE[0]), asked[i : i + TILE[0]]
        there = Best(len(who), k, floor)
        for t, reverse in zip(tiles, back):
            s = q[own] @ x[t].T
            at = np.searchsorted(ids[t], who)
            self = np.flatnonzero(ids[t][np.minimum(at, len(ids[t]) - 1)] == who)
            s[self, at[self]] = -np.inf
            r, c = above(s, there.over, k)
            there.add(r, ids[t][c], s[r, c])
            if not same:  # else the reverse is asked as well
                c, r = above(s.T, reverse.over, k)
                reverse.add(c, who[r], s[r, c])
        r, near, s = there.trim()
        found.append((who[r], near, s))
    for t, reverse in zip(tiles, back):
        c, near, s = reverse.trim()
        found.append((ids[t][c], near, s))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    of, near, s = (np.concatenate(y) for y in zip(*found))
    if same or not len(np.intersect1d(ids, asked, assume_unique=True)):
        order = np.argsort(of, kind="stable")
        return of[order], near[order], s[order]
    return best_of(of, near, s, k)


def _loads(responses: DataFrame, widths: dict[str, int], trees: dict[str, Tree], margin: dict[str, float]) -> dict[str, np.ndarray]:
    """Of each model, how many rows each leaf holds and how many visits it gets (leaf x 2)."""

    def run(batches):
        for b in batches:
            for model, _, x in usable(b, widths):
                if model in trees and len(x):
                    rows, leaves, _ = trees[model].visits(x, margin[model])
                    home = np.bincount(trees[model].home(x), minlength=trees[model].leaves)
                    every = np.bincount(leaves, minlength=trees[model].leaves)
                    at = np.flatnonzero(every)
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(at)), pa.array(at), pa.array(home[at]), pa.array(every[at])], ["model", "leaf", "held", "visits"])

    out = {m: np.zeros((t.leaves, 2), np.int64) for m, t in trees.items()}
    got = responses.mapInArrow(run, "model string, leaf bigint, held bigint, visits bigint").groupBy("model", "leaf").agg(F.sum("held"), F.sum("visits"))
    for m, leaf, held, visits in got.collect():  # one row a leaf
        out[m][leaf] = held, visits
    return out


def stacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix, from the bytes of each, without an object for each."""
    parts = [np.zeros((0, width), np.float32)]
    for c in column.chunks:
        first, last = c.offset, c.offset + len(c)
        at = np.frombuffer(c.buffers()[1], np.int32)[first : last + 1] if len(c) else (0, 0)
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float32).reshape(-1, width) if len(c) else parts[0])
    return np.concatenate(parts)


def grid(ids: np.ndarray, leaf: np.ndarray, home: np.ndarray, by_row: np.ndarray, by_visit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the visits ``(id, leaf)`` go: ``(visit, row part, visit part, base, asks)``.

    The leaf is cut into ``by_row[leaf] x by_visit[leaf]`` cells. A visit asks in one column of cells; in the
    home leaf of its id it is also a base row, in one row of them.
    """
    at = np.arange(len(ids))
    r, q = (mixed(ids + 1) * by_row[leaf]).astype(np.int64), (mixed(ids + 2) * by_visit[leaf]).astype(np.int64)
    one = (by_row[leaf] == 1) & (by_visit[leaf] == 1)
    parts = [(at[one], r[one], q[one], home[one], np.ones(one.sum(), bool))]
    for i in range(int(by_row.max(initial=1))):  # asks down the column
        use = ~one & (by_row[leaf] > i)
        parts.append((at[use], np.full(use.sum(), i), q[use], home[use] & (r[use] == i), np.ones(use.sum(), bool)))
    for j in range(int(by_visit.max(initial=1))):  # base along the row, but for the cell where it asks as well
        use = ~one & home & (by_visit[leaf] > j) & (q != j)
        parts.append((at[use], r[use], np.full(use.sum(), j), np.ones(use.sum(), bool), np.zeros(use.sum(), bool)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def paired(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, ...]:
    """Where rows go so that each two meet once: ``(row, block, other block, 0, base, asks)``, a cell for each pair of blocks."""
    own, other = np.repeat((mixed(ids + 3) * blocks).astype(np.int64), blocks), np.tile(np.arange(blocks), len(ids))
    return np.repeat(np.arange(len(ids)), blocks), np.minimum(own, other), np.maximum(own, other), np.zeros(len(own), np.int64), own <= other, own >= other


def neighbours(responses: DataFrame, k: int = 10, floor: float | None = None, recall: float = 0.997, leaf_rows: int = 12000, least_leaves: int = 8, sample_per_leaf: int = 64, max_leaves: int = 4096, probes: int = 512, split_rows: int = 50_000) -> DataFrame:
    """``model, id, neighbour, cosine``: at most k rows for each usable vector, none below ``floor``.

    ``responses`` has model, vec_ids and vectors; other columns are ignored. A repeated (model, id) is
    one vector, the vector itself is not among its neighbours, equal cosines go to the smaller id.
    A leaf is meant to hold ``leaf_rows`` rows, or less where the model would have fewer than ``least_leaves``
    leaves. The sample that grows a model's tree has about ``sample_per_leaf`` vectors a leaf, so at most
    sample_per_leaf * max_leaves; ``recall`` is the share of the true neighbours (above the floor, if
    there is one) of ``probes`` vectors that the calibrated margin must reach. Without a floor the
    neighbours of unclustered vectors lie everywhere: then all pairs are compared, which is exact.
    """
    source = one_a_row(responses)
    widths, counts = widths_of(source)
    spark = source.sparkSession
    empty = spark.createDataFrame([], "model string, id bigint, neighbour bigint, cosine double")
    if not widths:
        return empty
    size = {m: min(leaf_rows, max(64, n // least_leaves)) for m, n in counts.items()}
    leaves = {m: int(min(max_leaves, max(1, n // size[m]))) for m, n in counts.items()}
    share = {m: min(1.0, max(sample_per_leaf * leaves[m], 8 * probes) / counts[m]) for m in counts}
    sample = _sample(source, widths, share)
    trees = {m: grow(x, leaves[m]) for m, (_, x) in sample.items()}
    if not trees:
        return empty
    margin: dict[str, float] = {}
    most = probes
    while len(margin) < len(trees):  # where too few probes have neighbours, more are drawn, the whole sample at most
        asked = {}
        for m, (ids, x) in sample.items():
            if m not in margin:
                first = np.argsort(mixed(ids))[:most]
                asked[m] = (ids[first], x[first])
        got = _calibrate(source, widths, {m: trees[m] for m in asked}, asked, k, floor, recall)
        margin |= {m: w for m, (w, pairs) in got.items() if pairs >= probes or len(asked[m][0]) == len(sample[m][0])}
        most *= 4
    loads = _loads(source, widths, trees, margin)
    most_rows = {m: min(split_rows, max(256, CELL // (4 * widths[m]))) for m in trees}
    cells = {m: np.maximum(1, -(-load // most_rows[m])) for m, load in loads.items()}
    blocks = {}  # of the models whose pairs are all compared
    for m, load in loads.items():
        n = int(load[:, 0].sum())
        if 2 * int((load[:, 0] * load[:, 1]).sum()) >= n * n:
            blocks[m] = max(1, -(-n // most_rows[m]), 3 if n > 10_000 else 1)

    def placed(model, ids, x):
        if model in blocks:
            return paired(ids, blocks[model])
        rows, leaf, _ = trees[model].visits(x, margin[model])
        order = np.argsort(rows, kind="stable")  # visits of a row stay in their order, its home first
        rows, leaf = rows[order], leaf[order]
        home = np.append(True, rows[1:] != rows[:-1])
        by_row, by_visit = cells[model].T
        at, r, q, base, asks = grid(ids[rows], leaf, home, by_row, by_visit)
        return rows[at], leaf[at], r, q, base, asks

    def file(batches):
        for b in batches:
            for model, ids, x in usable(b, widths):
                if model not in trees or not len(x):
                    continue
                at, leaf, r, q, base, asks = placed(model, ids, x)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                for i in range(0, len(at), 20_000):
                    w = slice(i, i + 20_000)
                    to = pa.array(at[w])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model] * len(to)), pa.array(leaf[w]), pa.array(r[w]), pa.array(q[w]), pa.array(base[w]), pa.array(asks[w]), pa.array(ids).take(to), data.take(to)],
                        ["model", "leaf", "r", "q", "base", "asks", "id", "v"],
                    )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        every, first = np.unique(table["id"].to_numpy(), return_index=True)  # a repeated response: its rows are equal
        base, asks = (table[c].to_numpy()[first] for c in ("base", "asks"))
        x = stacked(table["v"], widths[key[0].as_py()])[first]
        ids, near, cosine = search(every[base], x[base], every[asks], x[asks], k, floor)
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        offsets = pa.array(np.append(start, len(ids)).astype(np.int32))
        return pa.table([pa.repeat(key[0], len(start)), pa.array(ids[start]), pa.ListArray.from_arrays(offsets, pa.array(near)), pa.ListArray.from_arrays(offsets, pa.array(cosine))], names=["model", "id", "near", "cosines"])

    filed = source.mapInArrow(file, "model string, leaf bigint, r bigint, q bigint, base boolean, asks boolean, id bigint, v binary")
    found = filed.groupBy("model", "leaf", "r", "q").applyInArrow(answer, "model string, id bigint, near array<bigint>, cosines array<float>")
    best = Window.partitionBy("model", "id").orderBy(F.desc("cosine"), "neighbour")
    # a vector's lists meet first, so that the two later steps need no exchange
    found = found.repartition("model", "id").select("model", "id", F.explode(F.arrays_zip("near", "cosines")).alias("n")).select("model", "id", F.col("n.near").alias("neighbour"), F.col("n.cosines").cast("double").alias("cosine"))
    found = found.groupBy("model", "id", "neighbour").agg(F.max("cosine").alias("cosine"))  # both may have visited the other
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def similar_pairs(responses: DataFrame, floor: float = 0.83, k: int = 10, **how) -> DataFrame:
    """``vec_id_a, vec_id_b``: pairs of which at least one is among the k nearest of the other."""
    near = neighbours(responses, k, floor, **how)
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()
