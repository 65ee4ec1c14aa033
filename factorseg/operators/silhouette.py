"""Mean silhouette of one or many labelings of the same points.

``euclidean`` is exact over all pairs, as usual in the field, and must be asked for: its cost grows with the
square of the number of distinct points. The points are sorted by their labels and cut into blocks; every two blocks meet once, in one
task, and each distance serves both its points. Tasks keep running sums, so no pair is ever a row and memory
stays bounded. All labelings share the distances. ``squared_euclidean`` needs only each cluster's size, sum and
squared norm, so it is exact for its own definition and linear in the rows; it is the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorseg.operators.encode import with_row_index
from factorseg.operators.kmeans import feature_matrix
from factorseg.operators.lineage import Scratch, lean
from factorseg.operators.shipping import ship_by_value

ship_by_value(__name__)

BLOCK_ROWS = 1 << 17     # a task holds two blocks and their sums
BLOCK_BYTES = 64 << 20   # of a block's points, or of its sums
ROW_BYTES = 6_000        # packed points or sums per streamed row stay near this size
TILE_ROWS = 2048         # sums by cell become sums by cluster after so many points
CHUNK_ROWS = 256         # distances between so many points are held at once; they stay near a core's cache
CELLS_PER_CLUSTER = 4    # with more cells than this, sums go by cluster at once
METRICS = ("euclidean", "squared_euclidean")


def silhouettes(df: DataFrame, features: str, labels: str, metric: str = "squared_euclidean") -> list[float]:
    """Mean silhouette for each entry of the ``labels`` array column (labels 0..k-1)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = df.select(F.col(features).alias("f"), F.col(labels).alias("l"))
    if metric == "squared_euclidean":
        points = rows.withColumn("w", F.lit(1).cast("bigint")).persist()  # linear: equal points need not meet
    else:
        points = rows.groupBy("f", "l").agg(F.count("*").alias("w")).persist()
    try:
        one = points.first()
        if one is None:
            return []
        d, n_label = len(one["f"]), len(one["l"])
        if metric == "squared_euclidean":
            return _squared(points, d, n_label)
        return _euclidean(points, d, _sizes(points, n_label), points.count())
    finally:
        points.unpersist()


def silhouette(df: DataFrame, features: str, label: str, metric: str = "squared_euclidean") -> float:
    """The mean silhouette of one label column with any values."""
    codes = with_row_index(df.select(F.col(label).alias("value")).distinct(), ["value"], "code")
    coded = df.join(codes, F.col(label).eqNullSafe(F.col("value"))).select(
        F.col(features).cast("array<double>").alias("f"), F.array(F.col("code").cast("int")).alias("l"))
    return silhouettes(coded, "f", "l", metric)[0]


def _sizes(points: DataFrame, n_label: int) -> list[np.ndarray]:
    rows = (points.select("w", F.posexplode("l").alias("labeling", "cluster"))
            .groupBy("labeling", "cluster").agg(F.sum("w").alias("n")).collect())
    return _by_cluster(rows, n_label)


def _by_cluster(rows, n_label: int) -> list[np.ndarray]:
    out = []
    for i in range(n_label):
        mine = {r["cluster"]: r["n"] for r in rows if r["labeling"] == i}
        out.append(np.array([mine.get(c, 0) for c in range(max(mine) + 1)], dtype=float))
    return out


def _scores(own_sums: np.ndarray, label: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """s = (b - a) / max(a, b) from each point's distance sums to every cluster."""
    at = np.arange(len(label))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(sizes > 0, own_sums / sizes, np.inf)
        a = own_sums[at, label] / (sizes[label] - 1)
        mean[at, label] = np.inf
        b = mean.min(axis=1)
        s = (b - a) / np.maximum(a, b)
    return np.where(sizes[label] > 1, np.nan_to_num(s), 0.0)


def _result(parts: DataFrame, sizes: list[np.ndarray]) -> list[float]:
    rows = {r["labeling"]: r["s"] for r in parts.groupBy("labeling").agg(F.sum("s").alias("s")).collect()}
    return [float(rows[i] / sizes[i].sum()) for i in range(len(sizes))]


def _emit(totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), pa.array(totals)],
                                      ["labeling", "s"])


@dataclass
class _Tile:
    """Points that lie side by side in a block. Their distances are summed by cell (a run of equal labels), cells then by cluster."""
    rows: slice               # of the block
    x: np.ndarray
    close: np.ndarray         # squared distances under this are taken again as differences
    chunks: list[tuple]       # points, their cells, weight of each point in each cell (both ways round), left and right;
                              # left @ right of another chunk are the squared distances
    fold: np.ndarray | None   # cells to the clusters that occur; None where clusters are the cells
    clusters: np.ndarray

    @property
    def width(self) -> int:
        return len(self.clusters) if self.fold is None else len(self.fold)


def _tile(rows: slice, f: np.ndarray, l: np.ndarray, w: np.ndarray, offset: np.ndarray) -> _Tile:
    x, w = f[rows], w[rows]
    n, square, ones = len(x), (x * x).sum(axis=1), np.ones((len(x), 1))
    clusters, at = np.unique(offset[:-1] + l[rows], return_inverse=True)
    at = at.reshape(n, -1)
    new = np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])
    cell, fold = np.cumsum(new) - 1, None
    if cell[-1] < CELLS_PER_CLUSTER * len(clusters):
        fold = np.zeros((cell[-1] + 1, len(clusters)))
        fold[np.arange(len(fold))[:, None], at[new]] = 1.0
    left = np.concatenate([x, square[:, None], ones], axis=1)
    right = np.concatenate([-2.0 * x, ones, square[:, None]], axis=1)
    chunks = []
    for lo in range(0, n, CHUNK_ROWS):
        part = slice(lo, min(lo + CHUNK_ROWS, n))
        cells = slice(0, len(clusters)) if fold is None else slice(cell[lo], cell[part.stop - 1] + 1)
        z = np.zeros((part.stop - lo, cells.stop - cells.start))
        z[np.arange(len(z))[:, None], at[part] if fold is None else cell[part, None] - cells.start] = w[part, None]
        chunks.append((part, cells, z, np.ascontiguousarray(z.T), left[part], np.ascontiguousarray(right[part].T)))
    return _Tile(rows, x, 1e-6 * (1.0 + square), chunks, fold, clusters)


def _tiles(f: np.ndarray, l: np.ndarray, w: np.ndarray, offset: np.ndarray) -> list[_Tile]:
    return [_tile(slice(lo, min(lo + TILE_ROWS, len(f))), f, l, w, offset) for lo in range(0, len(f), TILE_ROWS)]


def _differences(square: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray, close: np.ndarray) -> None:
    """Where cancellation dominates (near or equal points), the squared distance from the difference itself; ``near``: the y of such pairs."""
    low = square[:, near] < close[near]
    if 8 * np.count_nonzero(low) > low.size:
        square[:, near] = sum((x[:, j, None] - y[near, j]) ** 2 for j in range(x.shape[1]))
        return
    i, j = np.nonzero(low)
    gap = x[i] - y[near[j]]
    square[i, near[j]] = (gap * gap).sum(axis=1)


def _meet(a: _Tile, b: _Tile, sums_a: np.ndarray, sums_b: np.ndarray | None, room: np.ndarray) -> None:
    """Adds every distance between two tiles to the sums of both its points by the other's clusters, or of those in ``a`` alone."""
    to_a, to_b = np.zeros((len(a.x), b.width)), np.zeros((a.width, len(b.x)))
    for mine, my_cells, _, my_weight, left, _ in a.chunks:
        for other, cells, weight, _, _, right in b.chunks:
            square = np.matmul(left, right, out=room[:len(left) * len(weight)].reshape(len(left), len(weight)))
            near = np.flatnonzero(square.min(axis=0) < b.close[other])
            if len(near):
                _differences(square, a.x[mine], b.x[other], near, b.close[other])
            np.sqrt(square, out=square)
            to_a[mine, cells] += square @ weight
            if sums_b is not None:
                to_b[my_cells, other] += my_weight @ square
    sums_a[a.rows, b.clusters] += to_a if b.fold is None else to_a @ b.fold
    if sums_b is not None:
        sums_b[b.rows, a.clusters] += to_b.T if a.fold is None else to_b.T @ a.fold


def _runs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows of a matrix from each start to the next one (the last: to the end) as one binary value."""
    values = np.ascontiguousarray(values)
    ends = np.append(starts, len(values)) * (values.itemsize * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _matrix(value: pa.Scalar, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=dtype).reshape(-1, width)


def _euclidean(points: DataFrame, d: int, sizes: list[np.ndarray], count: int) -> list[float]:
    scratch = Scratch(points.sparkSession)
    try:
        # in this order equal labels lie side by side, and every copy of a block is the same
        placed = with_row_index(points, ["l", "f"], "place", scratch.cut)
        return _all_pairs(placed, d, sizes, count)
    finally:
        scratch.drop()


def _all_pairs(placed: DataFrame, d: int, sizes: list[np.ndarray], count: int) -> list[float]:
    """Blocks lie on a ring; each meets itself and those up to half-way round, so two blocks meet once and serve both.

    The task of a block holds that block with its sums and one other block with its sums; the other's sums go to where all
    sums of a point are added up. Work is the same for all tasks but for half a meeting, and tasks come in whole rounds.
    """
    spark, n_label = placed.sparkSession, len(sizes)
    offset = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(int)
    columns = int(offset[-1])
    tasks = 2 * spark.sparkContext.defaultParallelism
    block_rows = int(min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(columns, d + 2))), max(256, -(-count // tasks))))
    blocks = -(-count // block_rows)
    if blocks > tasks:
        blocks = min(count, -(-blocks // tasks) * tasks)
    pack = max(1, ROW_BYTES // (8 * d + 4 * n_label + 8))
    sum_rows = max(1, ROW_BYTES // (8 * columns))

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            place = batch.column(0).to_numpy()
            block = place * blocks // count
            # a point without all its coordinates or labels is an error
            f = feature_matrix(batch.column(1)).astype(float).reshape(len(batch), d)
            l = feature_matrix(batch.column(2)).astype(np.int32).reshape(len(batch), n_label)
            w = batch.column(3).to_numpy(zero_copy_only=False).astype(float)[:, None]
            starts = np.flatnonzero((np.arange(len(block)) % pack == 0) | (np.diff(block, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts].astype(np.int32)), pa.array(place[starts]), _runs(f, starts), _runs(l, starts), _runs(w, starts)],
                ["block", "place", "f", "l", "w"])

    packed = placed.select("place", "f", "l", "w").mapInArrow(pack_up, "block int, place long, f binary, l binary, w binary")
    met = (packed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(blocks // 2))))
           .withColumn("target", F.pmod(F.col("block") - F.col("turn"), F.lit(blocks)))
           .filter((2 * F.col("turn") < blocks) | (2 * F.col("target") < blocks))
           .select("target", "turn", "place", "block", "f", "l", "w")
           .repartitionById(blocks, "target").sortWithinPartitions("turn", "place"))

    def whole_blocks(batches: Iterator[pa.RecordBatch]):
        """(turn, block, its points); coordinates never become Python numbers."""
        key, held = None, []
        for batch in batches:
            for turn, block, f, l, w in zip(*[batch.column(i).to_pylist() for i in (1, 3)], *[batch.column(i) for i in (4, 5, 6)]):
                if (turn, block) != key and held:
                    yield *key, [np.concatenate(h) for h in zip(*held)]
                    held = []
                key = turn, block
                held.append((_matrix(f, np.float64, d), _matrix(l, np.int32, n_label), _matrix(w, np.float64, 1)[:, 0]))
        if held:
            yield *key, [np.concatenate(h) for h in zip(*held)]

    def sums_of(block: int, sums: np.ndarray, l: np.ndarray | None = None, w: np.ndarray | None = None) -> pa.RecordBatch:
        starts = np.arange(0, len(sums), sum_rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), block, dtype=np.int32)), pa.array(np.arange(len(starts), dtype=np.int32)), _runs(sums, starts)]
            + [pa.nulls(len(starts), pa.binary()) if v is None else _runs(v.reshape(len(sums), -1), starts) for v in (l, w)],
            ["block", "piece", "s", "l", "w"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(CHUNK_ROWS * CHUNK_ROWS)
        own = None
        for turn, block, (f, l, w) in whole_blocks(batches):
            tiles, sums = _tiles(f, l, w, offset), np.zeros((len(f), columns))
            if turn == 0:
                own, my_tiles, my_sums = (block, sums, l, w), tiles, sums
                for i, a in enumerate(tiles):
                    _meet(a, a, sums, None, room)
                    for b in tiles[:i]:
                        _meet(a, b, sums, sums, room)
                continue
            for a in my_tiles:
                for b in tiles:
                    _meet(a, b, my_sums, sums, room)
            yield sums_of(block, sums)
        if own is not None:
            yield sums_of(*own)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_label)
        key, now, waiting = None, None, []

        def add() -> None:
            sums, l, w = (np.concatenate(v) for v in zip(*waiting))
            for i, size in enumerate(sizes):
                totals[i] += (w[:, 0] * _scores(sums[:, offset[i]:offset[i + 1]], l[:, i], size)).sum()
            waiting.clear()

        for batch in batches:
            for block, piece, s, l, w in zip(*[batch.column(i).to_pylist() for i in (0, 1)], *[batch.column(i) for i in (2, 3, 4)]):
                if (block, piece) != key:
                    if len(waiting) * sum_rows >= CHUNK_ROWS:
                        add()
                    key, now = (block, piece), [np.zeros(0)] * 3
                    now[0] = _matrix(s, np.float64, columns).copy()
                    waiting.append(now)
                else:
                    now[0] += _matrix(s, np.float64, columns)
                if l.is_valid:
                    now[1:] = _matrix(l, np.int32, n_label).copy(), _matrix(w, np.float64, 1).copy()
        if waiting:
            add()
        yield _emit(totals)

    with lean(spark):
        sums = (met.mapInArrow(task, "block int, piece int, s binary, l binary, w binary")
                .repartition("block", "piece").sortWithinPartitions("block", "piece"))
        return _result(sums.mapInArrow(finish, "labeling int, s double"), sizes)


def _squared(points: DataFrame, d: int, n_label: int) -> list[float]:
    """Sum over a cluster of ||x - y||^2 = n ||x||^2 - 2 x.sum(y) + sum ||y||^2."""
    square = sum((F.col("f")[j] * F.col("f")[j] for j in range(1, d)), F.col("f")[0] * F.col("f")[0])
    rows = (points.select("w", "f", F.posexplode("l").alias("labeling", "cluster"))
            .groupBy("labeling", "cluster")
            .agg(F.sum("w").alias("n"), F.sum(F.col("w") * square).alias("q"),
                 *[F.sum(F.col("w") * F.col("f")[j]).alias(f"s{j}") for j in range(d)]).collect())
    sizes = _by_cluster(rows, n_label)
    norm = [np.zeros(len(s)) for s in sizes]
    total = [np.zeros((len(s), d)) for s in sizes]
    for r in rows:
        norm[r["labeling"]][r["cluster"]] = r["q"]
        total[r["labeling"]][r["cluster"]] = [r[f"s{j}"] for j in range(d)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sizes))
        for batch in batches:
            x, label = feature_matrix(batch.column(0)), feature_matrix(batch.column(1)).astype(int)
            w = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            if not len(w):
                continue
            xx = (x * x).sum(axis=1)[:, None]
            for i, size in enumerate(sizes):
                dist = np.maximum(size * xx - 2.0 * (x @ total[i].T) + norm[i], 0.0)
                sums[i] += (w * _scores(dist, label[:, i], size)).sum()
        yield _emit(sums)

    return _result(points.select("f", "l", "w").mapInArrow(task, "labeling int, s double"), sizes)
