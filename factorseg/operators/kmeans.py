"""K-means with restarts, all starts of all k advanced together.

A search over k with many restarts is hundreds of fits. Fitted one by one, each would read the
rows once per iteration. Here one job per iteration moves every unfinished start: tasks compute
distances on Arrow batches and emit per-centre sums, Spark adds them up, and only the centres
(never rows) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.operators.lineage import drop_written, written
from factorseg.operators.shipping import ship_by_value

ship_by_value(__name__)

SEED_ROUNDS = 5           # rounds of candidate sampling over all rows
SEED_FACTOR = 20          # candidates drawn in a round, times the largest k
SEED_STEPS = 50           # refinement steps of a start on the weighted candidates
CHUNK_CELLS = 2_000_000   # distances held at once in a task
CHUNK_ROWS = 512          # rows whose distances to the centres of one k are held at once; they stay near a core's cache
TASK_WORK = 1e8           # rows x centres x coordinates worth a task of its own
ROW_WORK = 300            # what it costs to read a row, in the same unit
PACKED_BYTES = 64 << 20   # of coordinates in one partition of the packed rows
DIRECT_ROWS = 100_000     # per-task partial sums are added on the driver up to this many


@dataclass
class KMeansModel:
    k: int
    centers: np.ndarray
    inertia: float
    start: int
    iterations: int

    def ordered(self) -> "KMeansModel":
        """Clusters numbered by ascending first coordinate (then the next ones)."""
        order = np.lexsort(self.centers.T[::-1])
        return KMeansModel(self.k, self.centers[order], self.inertia, self.start, self.iterations)


def feature_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list<double> column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _blocks(models: Sequence[np.ndarray]) -> list[tuple[int, int, int]]:
    """Runs of equal k as (k, first centre, models); the input is sorted by k."""
    out, at = [], 0
    for m in models:
        if out and out[-1][0] == len(m):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((len(m), at, 1))
        at += len(m)
    return out


def _nearest(x: np.ndarray, centers: np.ndarray, blocks):
    """(first centre, models, k, distances, labels) per run of equal k."""
    xx = (x * x).sum(axis=1)
    for k, lo, m in blocks:
        c = centers[lo:lo + m * k]
        dist = xx[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
        dist = np.maximum(dist, 0.0).reshape(len(x), m, k)
        yield lo, m, k, dist, dist.argmin(axis=2)


def packed_rows(df: DataFrame, features: str) -> DataFrame:
    """(p): the features of each Arrow batch as one binary value, so that a pass reads a row's coordinates as plain memory."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([feature_matrix(batch.column(0)).tobytes()], pa.binary())], ["p"])

    return df.select(features).mapInArrow(task, "p binary")


def _matrices(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The rows of a batch of either form: packed, or a list of coordinates each."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        for value in column:
            yield np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(-1, d)
    else:
        yield feature_matrix(column)


def _add_sums(x: np.ndarray, centers: np.ndarray, blocks, n: np.ndarray, e: np.ndarray | None, s: np.ndarray) -> None:
    """Adds the rows' counts, squared errors (if asked for) and coordinate sums to those of their centres; ties go to the first.

    Distances lie centre by centre, so that each step runs along the rows; where a row belongs is a 0/1 matrix, and the sums are
    its product with the rows.
    """
    ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for k, lo, m in blocks:
        c = centers[lo:lo + m * k]
        near = (np.concatenate([-2.0 * c, (c * c).sum(axis=1)[:, None]], axis=1) @ ones.T).reshape(m, k, len(x))
        best = near.min(axis=1)
        own = near == best[:, None]
        if np.count_nonzero(own) > m * len(x):  # ties
            own &= np.cumsum(own, axis=1, dtype=np.int32) == 1
        near[...] = own
        if e is not None:
            best = np.maximum(best + (x * x).sum(axis=1), 0.0)
            e[lo:lo + m * k] += np.matmul(near, best[:, :, None]).ravel()
        sums = near.reshape(m * k, len(x)) @ ones
        s[lo:lo + m * k] += sums[:, :-1]
        n[lo:lo + m * k] += sums[:, -1]


def _tasks(count: int, work: int, partitions: int) -> int:
    """Tasks worth starting for so many rows and so much work on each; beyond one a core, whole rounds of them."""
    wanted = int(count * (work + ROW_WORK) / TASK_WORK) + 1
    return wanted if wanted <= partitions else -(-wanted // partitions) * partitions


def _pass(df: DataFrame, features: str, models: Sequence[np.ndarray],
          count: int, partitions: int, errors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, squared error (zeros unless asked for) and coordinate sums per centre, over one job.

    Tasks are merged while there is too little work for them. Each task sends one row per
    centre; a few tasks' rows are added on the driver, many tasks' rows by Spark.
    """
    centers, blocks = np.concatenate(models), _blocks(models)
    total, d = centers.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, e, s = np.zeros(total), np.zeros(total), np.zeros((total, d))
        step = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(k * m for k, _, m in blocks)))
        for batch in batches:
            for rows in _matrices(batch.column(0), d):
                for a in range(0, len(rows), step):
                    _add_sums(rows[a:a + step], centers, blocks, n, e if errors else None, s)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(e[used])]
                + [pa.array(s[used, j]) for j in range(d)], names)

    names = ["center", "n", "e"] + [f"s{j}" for j in range(d)]
    schema = "center int, " + ", ".join(f"{c} double" for c in names[1:])
    wanted = _tasks(count, total * d, partitions)
    parts = df.select(features).coalesce(wanted).mapInArrow(task, schema)
    if wanted * total > DIRECT_ROWS:
        parts = parts.groupBy("center").agg(*[F.sum(c).alias(c) for c in names[1:]])
    got = parts.toArrow()
    at = got.column("center").to_numpy()
    n, e, s = (np.bincount(at, weights=got.column("n").to_numpy(), minlength=total),
               np.bincount(at, weights=got.column("e").to_numpy(), minlength=total), np.zeros((total, d)))
    for j in range(d):
        s[:, j] = np.bincount(at, weights=got.column(f"s{j}").to_numpy(), minlength=total)
    return n, e, s


def seed_candidates(df: DataFrame, features: str, id_col: str, k: int, seed: int, count: int,
                    partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate centres drawn from all rows, and how many rows each stands for.

    Every round draws rows in proportion to their squared distance to the candidates so far: each row gets the key
    ``-log(u) / distance`` with u from a hash of its id, and the smallest keys of all rows win. A task sends no more rows
    than the round draws. So a small cluster far from the rest is drawn however few its rows are.
    """
    draw = SEED_FACTOR * k
    unit = lambda i: F.xxhash64(F.lit(int(seed)), F.lit(i), F.col(id_col)).alias("h")
    first = df.select(features, unit(-1)).orderBy("h", features).first()
    pool = np.array([first[features]], dtype=float)
    for i in range(SEED_ROUNDS):
        def task(batches: Iterator[pa.RecordBatch], pool=pool) -> Iterator[pa.RecordBatch]:
            keys, rows = np.zeros(0), np.zeros((0, pool.shape[1]))
            for batch in batches:
                x = feature_matrix(batch.column(0))
                step = max(1, CHUNK_CELLS // len(pool))
                near = np.concatenate([dist[:, 0].min(axis=1) for at in range(0, len(x), step) for _l, _m, _k, dist, _ in
                                       _nearest(x[at:at + step], pool, [(len(pool), 0, 1)])]) if len(x) else np.zeros(0)
                u = (batch.column(1).to_numpy().view(np.uint64).astype(np.float64) + 0.5) / 2.0 ** 64
                far = near > 1e-12 * (1 + (x * x).sum(axis=1))
                keys = np.concatenate([keys, -np.log(u[far]) / near[far]])
                rows = np.concatenate([rows, x[far]])
                if len(keys) > draw:
                    kept = np.argpartition(keys, draw - 1)[:draw]
                    keys, rows = keys[kept], rows[kept]
            if len(keys):
                ends = np.arange(len(keys) + 1, dtype=np.int32) * rows.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))],
                                                 ["key", "c"])

        drawn = df.select(features, unit(i)).coalesce(_tasks(count, pool.size, partitions)).mapInArrow(task, "key double, c array<double>").orderBy("key", "c").limit(draw).collect()
        if not drawn:
            break
        pool = np.unique(np.concatenate([pool, np.array([r["c"] for r in drawn])]), axis=0)
    weight, _, _ = _pass(df, features, [pool], count, partitions)
    return pool[weight > 0], weight[weight > 0]


def spread_centers(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on weighted candidates: each next centre in proportion to weight times squared distance."""
    out = [x[rng.choice(len(x), p=weight / weight.sum())]]
    near = ((x - out[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = (weight * near).sum()
        i = rng.choice(len(x), p=weight * near / total) if total > 0 else rng.integers(len(x))
        out.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    return np.array(out)


def _refine(x: np.ndarray, weight: np.ndarray, c: np.ndarray, stop: float) -> np.ndarray:
    """A few k-means steps on the weighted candidates."""
    for _ in range(SEED_STEPS):
        label = ((c * c).sum(axis=1) - 2.0 * (x @ c.T)).argmin(axis=1)
        rows = np.bincount(label, weights=weight, minlength=len(c))
        sums = np.stack([np.bincount(label, weights=weight * x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        moved = np.where(rows[:, None] > 0, sums / np.where(rows > 0, rows, 1)[:, None], c)
        shift = ((moved - c) ** 2).sum()
        c = moved
        if shift <= stop:
            break
    return c


def starting_centers(df: DataFrame, seeds: np.ndarray, weight: np.ndarray, ids: Sequence[tuple[int, int]], seed: int,
                     stop: float) -> list[np.ndarray]:
    """Starting centres for every (k, start): k-means++ on the weighted candidates, then refined there.

    The number of candidates depends on k alone; the starts are spread over tasks.
    """
    spark = df.sparkSession
    d = seeds.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = [], []
            for i in batch.column(0).to_pylist():
                k, start = ids[i]
                c = spread_centers(seeds, weight, k, np.random.default_rng([seed, k, start]))
                at.append(i)
                flat.append(_refine(seeds, weight, c, stop).ravel())
            ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))],
                ["i", "c"])

    slices = min(len(ids), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(ids), 1, slices).mapInArrow(task, "i long, c array<double>").collect()
    return [np.array(r["c"]).reshape(-1, d) for r in sorted(rows, key=lambda r: r["i"])]


def _distinct(ids, centers, active: list[int], scale: float) -> list[int]:
    """Starts that reached the same centres continue as one."""
    seen, out = set(), []
    for i in active:
        c = np.round(centers[i] / scale, 9) + 0.0
        key = (ids[i][0], c[np.lexsort(c.T[::-1])].tobytes())
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def fit_kmeans(df: DataFrame, features: str, ks: Sequence[int], starts: int, seed: int = 42,
               id_col: str = "customer_id", max_iter: int = 300, tol: float = 1e-4,
               first_start: int = 0) -> dict[int, KMeansModel]:
    """The lowest-inertia model for each k.

    The ids and coordinates are written once, so an iteration plans and reads that table and not what ``df`` came from.
    Start i of k is the same whatever the number of starts, so a search can be extended: ``first_start`` skips the starts
    that were run before.
    """
    df, path = written(df.select(id_col, features))
    try:
        return _fit(df, features, ks, starts, seed, id_col, max_iter, tol, first_start)
    finally:
        drop_written(df.sparkSession, path)


def _fit(df: DataFrame, features: str, ks: Sequence[int], starts: int, seed: int, id_col: str, max_iter: int, tol: float,
         first_start: int) -> dict[int, KMeansModel]:
    d = len(df.select(features).first()[0])
    spread = df.agg(F.count("*").alias("n"), *[F.var_pop(F.col(features)[j]).alias(f"v{j}") for j in range(d)]).first()
    if spread["n"] < max(ks):
        raise ValueError(f"{spread['n']} rows cannot form {max(ks)} clusters")
    stop = tol * float(np.mean([spread[f"v{j}"] for j in range(d)]))
    partitions = max(1, df.sparkSession.sparkContext.defaultParallelism)
    seeds, weight = seed_candidates(df, features, id_col, max(ks), seed, spread["n"], partitions)
    ids = [(k, i) for k in sorted(ks) for i in range(first_start, starts)]
    centers = starting_centers(df, seeds, weight, ids, seed, stop)
    scale = max(float(np.sqrt(stop / tol)), 1e-300) if stop > 0 else 1.0
    kept = _distinct(ids, centers, list(range(len(ids))), scale)
    iterations = [0] * len(ids)
    active = list(kept)
    # one partition a core, or more where that would hold over PACKED_BYTES
    packed = packed_rows(df, features).coalesce(max(partitions, spread["n"] * d * 8 // PACKED_BYTES)).persist()
    for _ in range(max_iter):
        n, _e, s = _pass(packed, "p", [centers[i] for i in active], spread["n"], partitions, errors=False)
        at, still = 0, []
        for i in active:
            k = ids[i][0]
            rows, sums = n[at:at + k], s[at:at + k]
            at += k
            # a centre that lost all its rows stays where it is
            moved = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centers[i])
            shift = ((moved - centers[i]) ** 2).sum()
            centers[i] = moved
            iterations[i] += 1
            if shift > stop:
                still.append(i)
        done = set(active) - set(still)
        active = _distinct(ids, centers, still, scale)
        kept = [i for i in kept if i in done or i not in set(still) - set(active)]
        if not active:
            break
    _n, e, _s = _pass(packed, "p", [centers[i] for i in kept], spread["n"], partitions)
    packed.unpersist()
    best: dict[int, KMeansModel] = {}
    at = 0
    for (k, i), c, it in [(ids[j], centers[j], iterations[j]) for j in kept]:
        inertia = float(e[at:at + k].sum())
        at += k
        if k not in best or inertia < best[k].inertia:
            best[k] = KMeansModel(k, c, inertia, i, it)
    return {k: m.ordered() for k, m in best.items()}


def nearest_center(features: Column | str, model: KMeansModel) -> Column:
    """The row's cluster as a native expression; a tie goes to the lower number."""
    f = F.col(features) if isinstance(features, str) else features
    options = []
    for i, c in enumerate(model.centers):
        terms = [(f[j] - float(v)) * (f[j] - float(v)) for j, v in enumerate(c)]
        dist = terms[0]
        for t in terms[1:]:
            dist = dist + t
        options.append(F.struct(dist.alias("dist"), F.lit(i).alias("cluster")))
    return F.array_min(F.array(*options))["cluster"] if len(options) > 1 else F.lit(0)


def assign_clusters(df: DataFrame, features: str, model: KMeansModel, out: str = "cluster",
                    keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    return df.select(*keep, nearest_center(features, model).alias(out))


def assign_all(df: DataFrame, features: str, models: Sequence[KMeansModel]) -> DataFrame:
    """(features, labels array): one label per model, in the models' order."""
    parts = [(m.k, m.centers) for m in models]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(0))
            labels = np.empty((len(x), len(parts)), dtype=np.int32)
            for i, (k, c) in enumerate(parts):
                for _lo, _m, _k, _dist, lab in _nearest(x, c, [(k, 0, 1)]):
                    labels[:, i] = lab[:, 0]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(labels.ravel()))], ["features", "labels"])

    return df.select(F.col(features).alias("features")).mapInArrow(task, "features array<double>, labels array<int>")
