"""Approximate nearest neighbours by inner product with cross-polytope hashing.

1. Vectors are scaled by the largest norm and given one more coordinate that makes them unit (queries get 0 there), so the
   largest inner product is the smallest angle. Three rounds of random signs and a fast Hadamard transform rotate them;
   the hash is the nearest signed axis. TABLES rotations give as many tables, and every row is in each of them.
2. A query probes the PROBES axes nearest to it in every table.
3. Axes are gathered to cells of about CELL_ROWS rows (a fuller axis is split), queries to blocks of QUERY_ROWS. A cell
   and a block meet in one task of bounded size, which scores all probed candidates on the original vectors in double
   precision and passes on each query's best ``k``.
4. The best ``k`` of all cells are the result; a query with fewer is searched again with all axes probed.

The driver sees row counts per table and axis only. Measured recall at 20: 0.95 or more on the test tables.

Defined results: rows that are null, zero or hold null or non-finite components take no part, nor do rows without an id or
of another length than the most frequent one; rows that repeat an id count once, with the best score; ties go to the
smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.llm import vectors
from factorseg.operators.lineage import cut_lineage

TABLES, PROBES = 5, 48
CELL_ROWS, QUERY_ROWS = 16384, 2048
ROUNDS = 3


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, size = a.shape
    step = 1
    while step < size:
        a = a.reshape(n, -1, 2, step)
        a = np.concatenate([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=-1).reshape(n, -1)
        step *= 2
    return a / np.sqrt(size)


def rotations(size: int, tables: int, seed: int = 7) -> np.ndarray:
    """Signs (tables, ROUNDS, padded size); the size is padded to a power of two with room for one more coordinate."""
    padded = 1 << size.bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, ROUNDS, padded))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    y = np.zeros((len(x), signs.shape[1]))
    y[:, :x.shape[1]] = x
    for round_ in signs:
        y = hadamard(y * round_)
    return y


def _scaled(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    if query:
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x / top
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def nearest(rows: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows found, all if there are fewer."""
    spark = rows.sparkSession
    rows = rows.filter(F.col(id_col).isNotNull())
    good, size = vectors.of_usual_size(rows.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"),
                                                   F.col(vector_col).alias("v")), "v")
    empty = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], empty)
    top = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    signs = rotations(size, tables)
    kind = good.schema["v"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            x = vectors.matrix(batch.column("v"), size)
            for t in range(tables):
                y = rotated(_scaled(x, top, False), signs[t])
                axis = np.abs(y).argmax(axis=1)
                axis = axis * 2 + (y[np.arange(len(y)), axis] < 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(axis.astype(np.int32) + t * 2 * signs.shape[2]), batch.column("id"), batch.column("v")], ["axis", "id", "v"])

    indexed = good.select("id", "v").mapInArrow(index, f"axis int, id long, v {kind}")
    filled = {r["axis"]: r["n"] for r in indexed.groupBy("axis").agg(F.count("*").alias("n")).collect()}
    total_queries = good.filter("asks").count()
    cells = _cells(filled, tables, 2 * signs.shape[2])
    query_blocks = max(1, -(-total_queries // QUERY_ROWS))

    def search(queries: DataFrame, width: int) -> DataFrame:
        return _met(queries, indexed, cells, signs, size, top, kind, width, query_blocks, k)

    queries = good.filter("asks").select("id", "v")
    best = cut_lineage(_best(search(queries, probes), k))
    found = best.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = min(k, max(0, sum(filled.values()) // tables - 1))
    short = queries.join(found.filter(F.col("n") >= wanted), queries.id == found.query_id, "left_anti")
    if short.take(1):
        lists = best.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("score").alias("scores"))
        best = _best(lists.unionAll(search(short, 2 * signs.shape[2])), k)
    return best


def _cells(filled: dict[int, int], tables: int, axes: int) -> dict[int, tuple[int, int]]:
    """axis -> (cell, blocks of the cell): neighbouring axes of a table share a cell up to CELL_ROWS rows."""
    out, cell, held = {}, -1, CELL_ROWS
    for axis in range(tables * axes):
        n = filled.get(axis, 0)
        if n and (held + n > CELL_ROWS or axis // axes != last):
            cell, held = cell + 1, 0
        if n:
            out[axis] = (cell, max(1, -(-n // CELL_ROWS)))
            held += n
            last = axis // axes
        elif axis % axes == 0:
            held, last = CELL_ROWS, axis // axes
    return out


def _met(queries: DataFrame, indexed: DataFrame, cells: dict, signs: np.ndarray, size: int, top: float, kind: str,
         width: int, query_blocks: int, k: int) -> DataFrame:
    tables, _, padded = signs.shape
    width = min(width, 2 * padded)
    cell_of = np.full(tables * 2 * padded, -1)
    blocks = np.ones(tables * 2 * padded, np.int64)
    for axis, (cell, n) in cells.items():
        cell_of[axis], blocks[axis] = cell, n
    blocks_of = np.ones(max(cell_of.max() + 1, 1), np.int64)
    np.maximum.at(blocks_of, cell_of[cell_of >= 0], blocks[cell_of >= 0])
    schema = f"cell int, block int, query_block int, axes binary, axis int, id long, v {kind}"
    names = ["cell", "block", "query_block", "axes", "axis", "id", "v"]

    def spread(ids: np.ndarray, n) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n

    def data(batches):
        for batch in batches:
            axis, ids = batch.column("axis").to_numpy(), batch.column("id").to_numpy()
            cell = cell_of[axis]
            block = spread(ids, blocks_of[cell])
            for q in range(query_blocks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(cell), q), pa.int32()),
                     pa.nulls(len(cell), pa.binary()), batch.column("axis"), batch.column("id"), batch.column("v")], names)

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = vectors.matrix(batch.column("v"), size), batch.column("id").to_numpy()
            q = spread(ids, query_blocks)
            for t in range(tables):
                y = rotated(_scaled(x, top, True), signs[t])
                value = np.stack([y, -y], axis=2).reshape(len(y), -1)
                probed = np.argpartition(-value, width - 1, axis=1)[:, :width] + t * 2 * padded
                cell = cell_of[probed]
                row = np.repeat(np.arange(len(x)), width)
                flat, asked = cell.ravel(), probed.ravel()
                row, flat, asked = row[flat >= 0], flat[flat >= 0], asked[flat >= 0]
                order = np.lexsort((asked, flat, row))
                row, flat, asked = row[order], flat[order], asked[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])]) if len(row) else row
                end = np.append(first[1:], len(row))
                probes_of = [asked[a:b].astype(np.int32).tobytes() for a, b in zip(first, end)]
                who, cell = row[first], flat[first]
                for block in range(int(blocks_of[cell].max(initial=0))):
                    on = np.flatnonzero(blocks_of[cell] > block)
                    take = pa.array(who[on])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[on], pa.int32()), pa.array(np.full(len(on), block), pa.int32()), pa.array(q[who[on]], pa.int32()),
                         pa.array([probes_of[i] for i in on], pa.binary()), pa.nulls(len(on), pa.int32()),
                         batch.column("id").take(take), batch.column("v").take(take)], names)

    def score(table: pa.Table) -> pa.Table:
        asks = pc.is_valid(table.column("axes"))
        ask_rows, rows = table.filter(asks), table.filter(pc.invert(asks)).sort_by("id")
        out = []
        if ask_rows.num_rows and rows.num_rows:
            x, y = vectors.matrix(rows.column("v"), size), vectors.matrix(ask_rows.column("v"), size)
            ids, axis = rows.column("id").to_numpy(), rows.column("axis").to_numpy()
            low, place = np.unique(axis, return_inverse=True)
            for at in range(0, len(y), 256):
                part = y[at:at + 256]
                open_ = np.zeros((len(part), len(low)), bool)
                own = ask_rows.column("id").slice(at, 256).to_numpy()
                for i, probed in enumerate(ask_rows.column("axes").slice(at, 256).to_pylist()):
                    open_[i] = np.isin(low, np.frombuffer(probed, np.int32))
                value = np.where(open_[:, place] & (ids[None, :] != own[:, None]), part @ x.T, -np.inf)
                if len(ids) > k:
                    least = np.partition(value, len(ids) - k, axis=1)[:, len(ids) - k]
                    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                    chosen = (value >= (least - slack)[:, None]) & np.isfinite(value)
                else:
                    chosen = np.isfinite(value)
                who, what = np.nonzero(chosen)
                exact = vectors.dots(part[who], x[what])
                order = np.lexsort((ids[what], -exact, who))
                who, what, exact = who[order], what[order], exact[order]
                within = np.arange(len(who)) - np.searchsorted(who, who)
                keep = within < k
                who, what, exact = who[keep], what[keep], exact[keep]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else who
                ends = np.append(first, len(who)).astype(np.int32)
                out.append(pa.table({"query_id": pa.array(own[who[first]]), "ids": pa.ListArray.from_arrays(ends, ids[what]),
                                     "scores": pa.ListArray.from_arrays(ends, exact)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())),
                                                           "scores": pa.array([], pa.list_(pa.float64()))})

    both = indexed.mapInArrow(data, schema).unionAll(queries.mapInArrow(ask, schema))
    return both.groupBy("cell", "block", "query_block").applyInArrow(score, "query_id long, ids array<long>, scores array<double>")


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's lists, of which there are at most as many as it probes axes; an id counts once."""
    item = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("id")))
    every = lists.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(item))).alias("all"))
    none = F.slice("all", 1, 0)
    top = F.aggregate("all", none, lambda kept, x: F.when(
        (F.size(kept) >= k) | F.exists(kept, lambda y: y["id"] == x["id"]), kept).otherwise(F.concat(kept, F.array(x))))
    return every.select("query_id", F.posexplode(top).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
