"""Factor analysis of mixed data for columns of many levels, without a matrix of levels.

``famd.fit_famd`` gathers the cross products of all levels on the driver. Here nothing of the size of the levels leaves Spark: the
leading axes are found by block iteration (locally optimal block conjugate gradients). The state is a table with one row per
numeric column and per level that holds the block's vectors; multiplying the cross-product matrix by a block is

1. a join of the rows with the levels' entries (broadcast up to SMALL_ROWS levels of a column, by its count), which sums to
   one value a row and vector, and
2. one aggregate of these values by level, combined in each task before its shuffle.

The driver sees products of vectors only, three blocks squared. A level's rows are never gathered; adaptive execution splits a
frequent level's side of a join. The result equals the dense one up to the tolerance.

Defined results: as in ``famd``: null categories are the level ``missing``, null numbers 0; a table without rows and numeric columns
without variance raise ValueError; each axis' largest weight in size is positive, ties to the first variable and level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.functions.columns import category_filled, number_filled
from factorseg.operators.famd import components_to_target
from factorseg.operators.joins import SMALL_ROWS
from factorseg.operators.lineage import Scratch, cut_lineage

BASIS = ("v", "r", "p")   # the block, its residuals, the last steps; m_<name> is the matrix times them


@dataclass
class WideModel:
    cats: list[str]
    nums: list[str]
    mean: np.ndarray
    sd: np.ndarray
    n_levels: list[int]
    eigenvalues: np.ndarray
    n_keep: int
    total_inertia: float
    weights: DataFrame        # variable, level ("" of a numeric), share, axis array: one row per numeric and level

    @property
    def explained(self) -> np.ndarray:
        """Share of the learned components' inertia."""
        return self.eigenvalues / self.eigenvalues.sum()

    def contributions(self) -> DataFrame:
        """(variable, component, contribution): each variable's share of each component's inertia."""
        each = self.weights.select("variable", F.posexplode("axis").alias("at", "w"))
        return each.groupBy("variable", (F.col("at") + 1).alias("component")).agg(F.sum(F.col("w") * F.col("w")).alias("contribution"))

    def transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",), n: int | None = None) -> DataFrame:
        """``keep`` plus Factor_1..n; a level unseen in the fit adds nothing."""
        n = self.n_keep if n is None else n
        rows = _standardised(df, self.cats, self.nums, self.mean, self.sd, keep)
        scaled = self.weights.select(F.col("variable").alias("v"), "level", F.transform("axis", lambda x: x / F.sqrt("share")).alias("w"))
        scaled = scaled.withColumn("v", _number("v", self.cats + self.nums))
        shift = self.weights.filter(F.col("variable").isin(self.cats)).agg(*[F.sum(F.sqrt("share") * F.col("axis")[j]) for j in range(len(self.eigenvalues))])
        value = _values(rows, scaled, self.n_levels, len(self.nums), [x or 0.0 for x in shift.first()], n)
        return value.select(*keep, *[F.col("y")[j].alias(f"Factor_{j + 1}") for j in range(n)])


def _number(column: str, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column)).cast("int") - 1


def _standardised(df: DataFrame, cats, nums, mean, sd, keep=()) -> DataFrame:
    return df.select(*keep, *[category_filled(c).alias(f"_c{i}") for i, c in enumerate(cats)],
                     *[((number_filled(df, c) - float(mean[i])) / float(sd[i])).alias(f"_z{i}") for i, c in enumerate(nums)])


def _values(rows: DataFrame, weights: DataFrame, n_levels: list[int], n_nums: int, shift: list[float], k: int) -> DataFrame:
    """The rows and y: for each vector the sum of (v, level, w array) over the row's levels and numbers, less ``shift``."""
    p = len(n_levels)
    numeric = {r["v"]: r["w"] for r in weights.filter(F.col("v") >= p).collect()}  # one row per numeric column
    for i, levels in enumerate(n_levels):
        side = weights.filter(F.col("v") == i).select(F.col("level").alias(f"_l{i}"), F.col("w").alias(f"_w{i}"))
        rows = rows.join(F.broadcast(side) if levels <= SMALL_ROWS else side, F.col(f"_c{i}") == F.col(f"_l{i}"), "left").drop(f"_l{i}")

    def total(j: int) -> Column:
        out = F.lit(-float(shift[j]))
        for i in range(p):
            out = out + F.coalesce(F.element_at(f"_w{i}", j + 1), F.lit(0.0))
        for i in range(n_nums):
            out = out + F.col(f"_z{i}") * float(numeric[p + i][j])
        return out

    return rows.withColumn("y", F.array(*[total(j) for j in range(k)])).drop(*[f"_w{i}" for i in range(p)])


def _times(rows: DataFrame, state: DataFrame, name: str, out: str, n: int, n_levels: list[int], n_nums: int, k: int) -> DataFrame:
    """The state and ``out``: the cross-product matrix times its block ``name``."""
    p = len(n_levels)
    scaled = state.select("v", "level", F.transform(name, lambda x: x / F.sqrt("share")).alias("w"))
    shift = state.filter(F.col("v") < p).agg(*[F.sum(F.sqrt("share") * F.col(name)[j]) for j in range(k)]).first()
    value = _values(rows, scaled, n_levels, n_nums, [x or 0.0 for x in shift], k)
    part = lambda v, level, by: F.struct(F.lit(v).alias("v"), level.alias("level"), by.alias("by"))
    each = value.select("y", F.inline(F.array(*[part(i, F.col(f"_c{i}"), F.lit(1.0)) for i in range(p)],
                                              *[part(p + i, F.lit(""), F.col(f"_z{i}")) for i in range(n_nums)])))
    sums = each.groupBy("v", "level").agg(*[F.sum(F.col("y")[j] * F.col("by")).alias(f"s{j}") for j in range(k)])
    sums = sums.select("v", "level", F.array(*[F.col(f"s{j}") / n for j in range(k)]).alias("_sums"))
    return state.join(sums, ["v", "level"]).withColumn(out, F.transform("_sums", lambda x: x / F.sqrt("share"))).drop("_sums")


def _products(state: DataFrame, names: list[str], k: int) -> np.ndarray:
    """Inner products of the columns of all the named blocks, summed in tasks."""
    width = len(names) * k

    def gram(batches):
        out = np.zeros((width, width))
        for batch in batches:
            x = np.hstack([batch.column(c).flatten().to_numpy().reshape(-1, k) for c in names]) if batch.num_rows else np.zeros((0, width))
            out += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(out.ravel())], ["at", "x"])

    rows = state.select(*names).mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in rows:  # the square of three blocks' vectors
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def _combined(state: DataFrame, blocks: dict[str, tuple[list[str], np.ndarray]], k: int) -> DataFrame:
    """New blocks as combinations of old ones: name -> (old blocks, coefficients)."""
    schema = "v int, level string, share double, " + ", ".join(f"{b} array<double>" for b in blocks)

    def combine(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for names, c in blocks.values():
                x = np.hstack([batch.column(b).flatten().to_numpy().reshape(-1, k) for b in names]) @ c
                out.append(pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("v", "level", "share")] + out, ["v", "level", "share", *blocks])

    return state.mapInArrow(combine, schema)


def fit_famd_wide(df: DataFrame, cats: Sequence[str], nums: Sequence[str], n_components: int = 2, target: float = 0.85,
                  tolerance: float = 1e-9, max_steps: int = 60, extra: int = 2) -> WideModel:
    """The leading ``n_components`` axes; ``extra`` vectors more are carried to speed up the last ones.

    Steps end when an eigenvalue's residual, which bounds its error by its square over the gap, is under the root of ``tolerance``.
    """
    cats, nums = list(cats), list(nums)
    scratch = Scratch(df.sparkSession)
    first = df.agg(F.count("*").alias("n"), *[F.avg(number_filled(df, c)).alias(f"m{i}") for i, c in enumerate(nums)],
                   *[F.stddev_pop(number_filled(df, c)).alias(f"s{i}") for i, c in enumerate(nums)]).first()
    n = first["n"]
    if not n:
        raise ValueError("the table has no rows")
    mean, sd = (np.array([first[f"{x}{i}"] for i in range(len(nums))], float) for x in "ms")
    if flat := [c for c, s in zip(nums, sd) if not s > 0]:
        raise ValueError(f"numeric columns without variance: {flat}")
    rows = scratch.cut(_standardised(df, cats, nums, mean, sd))
    p, q = len(cats), len(nums)
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("v"), F.col(f"_c{i}").alias("level")) for i in range(p)],
                                        *([F.struct(F.lit(-1).alias("v"), F.lit("").alias("level"))] if not p else []))))
    levels = each.groupBy("v", "level").agg((F.count("*") / n).alias("share")).filter("v >= 0")
    numbers = df.sparkSession.range(q).select((F.col("id") + p).cast("int").alias("v"), F.lit("").alias("level"), F.lit(1.0).alias("share"))
    state = scratch.cut(levels.unionByName(numbers))
    sizes = {r["v"]: r["n"] for r in state.groupBy("v").agg(F.count("*").alias("n")).collect()}
    n_levels = [sizes[i] for i in range(p)]
    rank = sum(c - 1 for c in n_levels) + q
    learn = min(n_components, rank)
    k = min(learn + extra, rank)
    guess = lambda j: F.pmod(F.xxhash64("v", "level", F.lit(j)), F.lit(1 << 20)) / float(1 << 19) - 1
    # vectors of a column's levels are orthogonal to the roots of its shares after one multiplication
    state = state.withColumn("g", F.array(*[guess(j) for j in range(k)]))
    names = ["v"]
    state = scratch.cut(_times(rows, state, "g", "b_v", n, n_levels, q, k).drop("g"))
    state = scratch.cut(_times(rows, state, "b_v", "m_v", n, n_levels, q, k))
    last = []
    for _ in range(max_steps):
        blocks = [f"b_{x}" for x in names]
        both = _products(state, blocks + [f"m_{x}" for x in names], k)
        width = len(blocks) * k
        g, h = both[:width, :width], both[:width, width:]
        scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        own, axes = np.linalg.eigh(g * np.outer(scale, scale))
        keep = own > 1e-12 * own[-1]
        basis = scale[:, None] * axes[:, keep] / np.sqrt(own[keep])
        values, turn = np.linalg.eigh(basis.T @ ((h + h.T) / 2) @ basis)
        c = (basis @ turn[:, ::-1])[:, :k]
        values = values[::-1][:k]
        move = c.copy()
        move[:k] = 0
        old = {x: [f"{x}_{b}" for b in names] for x in "bm"}
        new = {"b_v": (old["b"], c), "m_v": (old["m"], c), "b_r": (old["m"] + old["b"], np.vstack([c, -c * values]))}
        if len(names) > 1:
            new |= {"b_p": (old["b"], move), "m_p": (old["m"], move)}
        made = scratch.cut(_combined(state, new, k))
        gap = np.sqrt(np.maximum(np.diag(_products(made, ["b_r"], k))[:learn], 0))
        state = made
        if gap.max() < np.sqrt(tolerance) or (last and max(abs(a - b) for a, b in zip(last, values[:learn])) < tolerance * 1e-3):
            break
        last = list(values[:learn])
        state = scratch.cut(_times(rows, state, "b_r", "m_r", n, n_levels, q, k))
        names = ["v", "r", "p"] if "b_p" in new else ["v", "r"]
    lead = state.agg(*[F.max_by(F.col("b_v")[j], F.struct(F.abs(F.col("b_v")[j]), -F.col("v"))) for j in range(learn)]).first()
    sign = [1.0 if x >= 0 else -1.0 for x in lead]
    variable = F.element_at(F.array(*[F.lit(x) for x in cats + nums]), F.col("v") + 1)
    weights = cut_lineage(state.select(variable.alias("variable"), "level", "share", F.array(*[
        F.col("b_v")[j] * sign[j] for j in range(learn)]).alias("axis")))
    scratch.drop()
    values = values[:learn]
    return WideModel(cats, nums, mean, sd, n_levels, values, components_to_target(np.cumsum(values / values.sum()), target), float(rank), weights)
