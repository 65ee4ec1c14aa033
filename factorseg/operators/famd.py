"""Factor analysis of mixed data from distributed sufficient statistics.

Numeric columns are standardised (population sd), each level c of a categorical becomes
(1_c - p_c) / sqrt(p_c). The mean cross-product matrix M of these columns has one row per
numeric and per level; it is all the fit needs. Spark aggregates M, the driver decomposes it
(its size depends on the number of levels, never on rows), and scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as arrow
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factorseg.functions.columns import category_filled, number_filled, round_even
from factorseg.operators.assoc import PAIRS_PER_JOB
from factorseg.operators.joins import SMALL_ROWS

LITERAL_LEVELS = 64      # up to here level weights are a literal map, beyond it a broadcast join
CELLS_PER_ROW = 0.1      # aggregate whole category tuples first when they are this few per row of a task
MAX_CELLS = 1_000_000


@dataclass
class MixedStats:
    """Everything about the rows that the analysis uses."""

    n: int
    cats: list[str]
    nums: list[str]
    mean: np.ndarray                      # per numeric
    sd: np.ndarray
    levels: dict[str, list[str]]          # sorted, per categorical
    share: dict[str, np.ndarray]          # level shares
    matrix: np.ndarray                    # M, numerics first, then levels by variable

    def rows_of(self, variable: str) -> np.ndarray:
        if variable in self.nums:
            return np.array([self.nums.index(variable)])
        start = len(self.nums)
        for c in self.cats:
            if c == variable:
                break
            start += len(self.levels[c])
        return np.arange(start, start + len(self.levels[variable]))


def mixed_stats(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> MixedStats:
    """Two jobs over the rows when the category tuples repeat, a few more when they do not."""
    cats, nums = list(cats), list(nums)
    base = df.select(*[category_filled(c).alias(f"c{i}") for i, c in enumerate(cats)],
                     *[number_filled(df, c).alias(f"x{i}") for i, c in enumerate(nums)])
    p, q = len(cats), len(nums)
    first = base.agg(F.count("*").alias("n"),
                     *[F.approx_count_distinct(f"c{i}").alias(f"d{i}") for i in range(p)],
                     *[F.avg(f"x{i}").alias(f"m{i}") for i in range(q)],
                     *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(q)]).first()
    n = first["n"]
    if n == 0:
        raise ValueError("the table has no rows")
    many = {c: first[f"d{i}"] for i, c in enumerate(cats)}
    mean = np.array([first[f"m{i}"] for i in range(q)], dtype=float)
    sd = np.array([first[f"s{i}"] for i in range(q)], dtype=float)
    flat = [nums[i] for i in range(q) if not sd[i] > 0]
    if flat:
        raise ValueError(f"numeric columns without variance: {flat}")
    z = base.select(*[f"c{i}" for i in range(p)],
                    *[((F.col(f"x{i}") - float(mean[i])) / float(sd[i])).alias(f"z{i}") for i in range(q)])

    tuples = float(np.prod([float(v) for v in many.values()])) if cats else 1.0
    products = list(combinations_with_replacement(range(q), 2))
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if tuples <= max(1.0, min(MAX_CELLS, CELLS_PER_ROW * n / tasks)) and len(products) <= PAIRS_PER_JOB:
        # few distinct tuples, so tasks combine their rows: one aggregate over the rows, the rest on its small result
        cells = z.groupBy(*[f"c{i}" for i in range(p)]).agg(
            F.count("*").alias("w"), *[F.sum(f"z{i}").alias(f"z{i}") for i in range(q)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"zz{i}_{j}") for i, j in products]).persist()
    else:
        cells = z.withColumn("w", F.lit(1).cast("bigint"))
    weight, sums = F.col("w"), [F.sum(f"z{i}").alias(f"z{i}") for i in range(q)]

    level_rows, pair_rows = [], None
    if cats:
        each = cells.select("w", *[f"z{i}" for i in range(q)], F.inline(F.array(*[
            F.struct(F.lit(i).alias("v"), F.col(f"c{i}").alias("level")) for i in range(p)])))
        level_rows = each.groupBy("v", "level").agg(F.sum(weight).alias("w"), *sums).collect()
    if p > 1:
        pair_ids = list(combinations(range(p), 2))
        both = cells.select("w", F.inline(F.array(*[
            F.struct(F.lit(k).alias("pair"), F.col(f"c{a}").alias("la"), F.col(f"c{b}").alias("lb"))
            for k, (a, b) in enumerate(pair_ids)])))
        pair_rows = both.groupBy("pair", "la", "lb").agg(F.sum(weight).alias("w")).toArrow()

    levels, share, sums_by = {}, {}, {}
    for i, c in enumerate(cats):
        mine = sorted((r for r in level_rows if r["v"] == i), key=lambda r: r["level"])
        levels[c] = [r["level"] for r in mine]
        share[c] = np.array([r["w"] for r in mine], dtype=float) / n
        sums_by[c] = np.array([[r[f"z{k}"] for k in range(q)] for r in mine], dtype=float).reshape(len(mine), q)

    size = q + sum(len(v) for v in levels.values())
    m = np.zeros((size, size))
    if q:
        m[:q, :q] = _numeric_products(cells, products, q, n)
    offset, at = {}, q
    for c in cats:
        offset[c] = at
        at += len(levels[c])
    for c in cats:
        o, k, pc = offset[c], len(levels[c]), share[c]
        m[o:o + k, o:o + k] = np.eye(k) - np.sqrt(np.outer(pc, pc))
        if q:  # mean of z within the level times sqrt(p)
            m[o:o + k, :q] = sums_by[c] / n / np.sqrt(pc)[:, None]
            m[:q, o:o + k] = m[o:o + k, :q].T
    if p > 1:
        joint = {pair: np.zeros((len(levels[cats[pair[0]]]), len(levels[cats[pair[1]]]))) for pair in pair_ids}
        number, weights = pair_rows.column("pair").to_numpy(), pair_rows.column("w").to_numpy() / n
        for k, (a, b) in enumerate(pair_ids):
            mine = np.flatnonzero(number == k)
            at = [arrow.index_in(pair_rows.column(side).take(pa.array(mine)), pa.array(levels[cats[v]])).to_numpy()
                  for side, v in (("la", a), ("lb", b))]
            joint[a, b][at[0], at[1]] = weights[mine]
        for (a, b), pj in joint.items():
            ca, cb = cats[a], cats[b]
            expect = np.outer(share[ca], share[cb])
            block = (pj - expect) / np.sqrt(expect)
            m[offset[ca]:offset[ca] + len(levels[ca]), offset[cb]:offset[cb] + len(levels[cb])] = block
            m[offset[cb]:offset[cb] + len(levels[cb]), offset[ca]:offset[ca] + len(levels[ca])] = block.T
    cells.unpersist()
    return MixedStats(n, cats, nums, mean, sd, levels, share, m)


def _numeric_products(cells: DataFrame, products, q: int, n: int) -> np.ndarray:
    """Correlations from standardised products; pre-aggregated cells carry the sums already."""
    summed = "zz0_0" in cells.columns
    r = np.eye(q)
    for start in range(0, len(products), PAIRS_PER_JOB):
        some = [ij for ij in products[start:start + PAIRS_PER_JOB] if ij[0] != ij[1]]
        if not some:
            continue
        term = (lambda i, j: F.col(f"zz{i}_{j}")) if summed else (lambda i, j: F.col(f"z{i}") * F.col(f"z{j}"))
        row = cells.agg(*[F.sum(term(i, j)).alias(f"r{i}_{j}") for i, j in some]).first()
        for i, j in some:
            r[i, j] = r[j, i] = row[f"r{i}_{j}"] / n
    return r


@dataclass
class FamdModel:
    stats: MixedStats
    variables: list[str]                  # input order
    eigenvalues: np.ndarray               # learned components, descending
    vectors: np.ndarray                   # rows of M x components
    n_keep: int
    target: float
    total_inertia: float = field(default=0.0)

    # ---- scalars -------------------------------------------------------
    @property
    def explained(self) -> np.ndarray:
        """Share of the learned components' inertia (not of the total)."""
        return self.eigenvalues / self.eigenvalues.sum()

    @property
    def kept_share(self) -> float:
        return float(np.cumsum(self.explained)[self.n_keep - 1])

    @property
    def factor_names(self) -> list[str]:
        return [f"Factor_{j + 1}" for j in range(self.n_keep)]

    def contribution(self) -> dict[str, np.ndarray]:
        """Each variable's share of each component's inertia."""
        return {v: (self.vectors[self.stats.rows_of(v)] ** 2).sum(axis=0) for v in self.variables}

    def total_contribution_pct(self) -> dict[str, float]:
        """Percent over the kept components; sums to 100."""
        part = {v: c[:self.n_keep].sum() for v, c in self.contribution().items()}
        whole = sum(part.values())
        return {v: float(100.0 * c / whole) for v, c in part.items()}

    # ---- small result tables -------------------------------------------
    def explained_table(self, spark: SparkSession) -> DataFrame:
        cum = np.cumsum(self.explained)
        rows = [(j + 1, float(e), float(x), float(c), float(100 * e / self.total_inertia), j < self.n_keep)
                for j, (e, x, c) in enumerate(zip(self.eigenvalues, self.explained, cum))]
        return spark.createDataFrame(rows, "component int, eigenvalue double, explained_variance double, "
                                           "cumulative_variance double, inertia_pct double, retained boolean")

    def contributions_table(self, spark: SparkSession) -> DataFrame:
        """(variable, component, contribution, total_contribution_pct) for the kept components."""
        total, parts = self.total_contribution_pct(), self.contribution()
        rows = [(v, j + 1, float(parts[v][j]), total[v]) for v in self.variables for j in range(self.n_keep)]
        return spark.createDataFrame(rows, "variable string, component int, contribution double, "
                                           "total_contribution_pct double")

    def coordinates_table(self, spark: SparkSession) -> DataFrame:
        """(variable, kind, component, squared, signed): r2 or eta2 with the factor; r for numerics."""
        rows = []
        for v in self.variables:
            at = self.stats.rows_of(v)
            kind = "numeric" if v in self.stats.nums else "categorical"
            for j in range(self.n_keep):
                squared = float(self.eigenvalues[j] * (self.vectors[at, j] ** 2).sum())
                signed = float(np.sqrt(self.eigenvalues[j]) * self.vectors[at[0], j]) if kind == "numeric" else None
                rows.append((v, kind, j + 1, squared, signed))
        return spark.createDataFrame(rows, "variable string, kind string, component int, squared double, signed double")

    def centroids_table(self, spark: SparkSession) -> DataFrame:
        """(variable, level, component, centroid, share): mean score of each level's rows."""
        rows = []
        for c in self.stats.cats:
            at = self.stats.rows_of(c)
            for k, lev in enumerate(self.stats.levels[c]):
                for j in range(self.n_keep):
                    rows.append((c, lev, j + 1, float(self._level_mean(at[k], c, k, j)),
                                 float(self.stats.share[c][k])))
        return spark.createDataFrame(rows, "variable string, level string, component int, centroid double, share double")

    def _level_mean(self, row: int, c: str, k: int, j: int) -> float:
        return self.eigenvalues[j] * self.vectors[row, j] / np.sqrt(self.stats.share[c][k])

    def loadings_table(self, spark: SparkSession) -> DataFrame:
        """(variable, component, loading): correlation of each variable with each score.

        A categorical enters by the rank of its level. Shares and level means fix the
        correlation, so the rows are not read again.
        """
        rows = []
        for v in self.variables:
            at = self.stats.rows_of(v)
            for j in range(self.n_keep):
                root = np.sqrt(self.eigenvalues[j])
                if v in self.stats.nums:
                    r = root * self.vectors[at[0], j]
                else:
                    pc = self.stats.share[v]
                    code = np.arange(len(pc), dtype=float)
                    centred = code - (pc * code).sum()
                    spread = np.sqrt((pc * centred ** 2).sum())
                    means = np.array([self._level_mean(at[k], v, k, j) for k in range(len(pc))])
                    r = float((pc * centred * means).sum() / (spread * root)) if spread > 0 else None
                rows.append((v, j + 1, None if r is None else float(r)))
        return spark.createDataFrame(rows, "variable string, component int, loading double")

    def interpretation_table(self, spark: SparkSession, top: int = 3) -> DataFrame:
        """One row per kept component: explained, cumulative, leading variables."""
        cum, parts, rows = np.cumsum(self.explained), self.contribution(), []
        for j in range(self.n_keep):
            lead = sorted(self.variables, key=lambda v: (-parts[v][j], v))[:top]
            cells = []
            for i in range(top):
                cells += [lead[i], round(float(parts[lead[i]][j]), 2)] if i < len(lead) else ["", 0.0]
            rows.append((f"Factor_{j + 1}", round(float(self.explained[j]) * 100, 2),
                         round(float(cum[j]) * 100, 2), *cells))
        tops = ", ".join(f"top_variable_{i} string, top_contrib_{i} double" for i in range(1, top + 1))
        return spark.createDataFrame(
            rows, f"component string, explained_variance_pct double, cumulative_variance_pct double, {tops}")

    def relationship_blocks(self) -> dict[tuple[str, str], float]:
        """Squared sums of M's blocks: R2, eta2 and (uncorrected) phi2; 1 or levels - 1 on the diagonal."""
        m = self.stats.matrix
        return {(a, b): float((m[np.ix_(self.stats.rows_of(a), self.stats.rows_of(b))] ** 2).sum())
                for a in self.variables for b in self.variables}

    def relationship_table(self, spark: SparkSession, correction: str = "auto", digits: int | None = 3) -> DataFrame:
        """(row_var, col_var, value) as ``assoc.relationship_matrix``, without reading the rows again.

        ``auto`` applies Yates' correction to pairs of two-level categoricals. There all four
        cells deviate by the same count, so the correction rescales the uncorrected value.
        """
        rows, n = [], self.stats.n
        for (a, b), v in self.relationship_blocks().items():
            pa, pb = self.stats.share.get(a), self.stats.share.get(b)
            if correction == "auto" and a != b and pa is not None and pb is not None and len(pa) == len(pb) == 2:
                weight = (1 / pa).sum() * (1 / pb).sum() / n     # sum of 1 / expected count
                gap = np.sqrt(v * n / weight)
                v = v * (max(gap - 0.5, 0.0) / gap) ** 2 if gap > 0 else 0.0
            rows.append((a, b, float(v)))
        out = spark.createDataFrame(rows, "row_var string, col_var string, value double")
        return out if digits is None else out.withColumn("value", round_even("value", digits))

    # ---- scores --------------------------------------------------------
    def transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",), n: int | None = None,
                  as_array: str | None = None) -> DataFrame:
        """``keep`` plus Factor_1..n, or one array column. A level unseen in the fit adds nothing."""
        n = self.n_keep if n is None else n
        s = self.stats
        out = df.select(*keep, *[category_filled(c).alias(f"_c{i}") for i, c in enumerate(s.cats)],
                        *[number_filled(df, c).alias(f"_x{i}") for i, c in enumerate(s.nums)])
        zero = F.array(*[F.lit(0.0)] * n)
        for i, c in enumerate(s.cats):
            w = self.vectors[s.rows_of(c)][:, :n] / np.sqrt(s.share[c])[:, None]
            w = w - (s.share[c][:, None] * w).sum(axis=0)
            if len(s.levels[c]) <= LITERAL_LEVELS:
                table = F.create_map(*[x for lev, row in zip(s.levels[c], w)
                                       for x in (F.lit(lev), F.array(*[F.lit(float(v)) for v in row]))])
                out = out.withColumn(f"_w{i}", F.coalesce(F.try_element_at(table, F.col(f"_c{i}")), zero))
            else:
                rows = [(lev, [float(v) for v in row]) for lev, row in zip(s.levels[c], w)]
                table = df.sparkSession.createDataFrame(rows, f"_l{i} string, _w{i} array<double>")
                side = F.broadcast(table) if len(rows) <= SMALL_ROWS else table
                out = (out.join(side, F.col(f"_c{i}") == F.col(f"_l{i}"), "left")
                       .withColumn(f"_w{i}", F.coalesce(f"_w{i}", zero)).drop(f"_l{i}"))
        factors = []
        for j in range(n):
            terms = [(F.col(f"_x{i}") - float(s.mean[i])) * float(self.vectors[i, j] / s.sd[i])
                     for i in range(len(s.nums))]
            terms += [F.element_at(f"_w{i}", j + 1) for i in range(len(s.cats))]
            total: Column = terms[0]
            for t in terms[1:]:
                total = total + t
            factors.append(total)
        if as_array:
            return out.select(*keep, F.array(*factors).alias(as_array))
        return out.select(*keep, *[f.alias(f"Factor_{j + 1}") for j, f in enumerate(factors)])


def fit_famd(df: DataFrame, cats: Sequence[str], nums: Sequence[str], target: float = 0.85,
             max_components: int = 20, n_components: int | None = None) -> FamdModel:
    stats = mixed_stats(df, cats, nums)
    return decompose(stats, list(cats) + list(nums), target, max_components, n_components)


def decompose(stats: MixedStats, variables: Sequence[str], target: float = 0.85,
              max_components: int = 20, n_components: int | None = None) -> FamdModel:
    values, vectors = np.linalg.eigh(stats.matrix)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    rank = int((values > 1e-10 * max(values[0], 1.0)).sum())
    learn = n_components or min(max_components, max(2, len(variables) - 1))
    learn = max(1, min(learn, rank))
    values, vectors = values[:learn], vectors[:, :learn]
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[lead, np.arange(learn)])
    total = len(stats.nums) + sum(len(v) - 1 for v in stats.levels.values())
    keep = components_to_target(np.cumsum(values / values.sum()), target)
    return FamdModel(stats, list(variables), values, vectors, keep, target, float(total))


def components_to_target(cumulative: Sequence[float], target: float) -> int:
    """First component whose cumulative share reaches the target, within [2, all]."""
    reached = [i + 1 for i, c in enumerate(cumulative) if c >= target]
    return min(max(2, reached[0] if reached else len(cumulative)), len(cumulative))


def restrict(stats: MixedStats, variables: Sequence[str]) -> MixedStats:
    """The same statistics for fewer variables: a refit needs no further pass over the rows."""
    cats = [c for c in stats.cats if c in variables]
    nums = [c for c in stats.nums if c in variables]
    rows = np.concatenate([stats.rows_of(v) for v in nums + cats]) if nums + cats else np.array([], dtype=int)
    at = [stats.nums.index(c) for c in nums]
    return MixedStats(stats.n, cats, nums, stats.mean[at], stats.sd[at], {c: stats.levels[c] for c in cats},
                      {c: stats.share[c] for c in cats}, stats.matrix[np.ix_(rows, rows)])


def ranked_contributions(model: FamdModel, spark: SparkSession) -> DataFrame:
    """(rank, variable, total_contrib_pct), largest first, ties by name."""
    pct = model.total_contribution_pct()
    ranked = sorted(pct.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame([(i + 1, v, float(p)) for i, (v, p) in enumerate(ranked)],
                                 "rank int, variable string, total_contrib_pct double")


def prune_list(shares: DataFrame, fraction: float = 0.15, min_pct: float = 0.40) -> DataFrame:
    """(variable, total_contrib_pct, rank, dropped) from a small (variable, total_contrib_pct) table.

    Dropped: the last floor(fraction * n) of the ranking, and everything below ``min_pct``.
    The table has one row per variable, so one window over it is small.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("total_contrib_pct"), F.asc("variable"))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    ranked = shares.select("variable", "total_contrib_pct", F.row_number().over(w).alias("rank"), n.alias("n"))
    last = F.col("rank") > F.col("n") - F.floor(F.lit(float(fraction)) * F.col("n"))
    return ranked.select("variable", "total_contrib_pct", "rank",
                         (last | (F.col("total_contrib_pct") < min_pct)).alias("dropped"))


def prune_variables(model: FamdModel, fraction: float = 0.15, min_pct: float = 0.40) -> list[str]:
    """Variables that stay, in input order; all of them when fewer than two would."""
    pct = model.total_contribution_pct()
    ranked = sorted(pct, key=lambda v: (-pct[v], v))
    cut = int(np.floor(fraction * len(ranked)))
    drop = set(ranked[len(ranked) - cut:]) | {v for v in ranked if pct[v] < min_pct}
    keep = [v for v in model.variables if v not in drop]
    return keep if len(keep) >= 2 else list(model.variables)


def variance_table(components: DataFrame, target: float = 0.85) -> DataFrame:
    """(component, eigenvalue, explained, cumulative, retained) from a small (component, eigenvalue) table."""
    whole = Window.partitionBy(F.lit(0))
    so_far = whole.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    share = components.withColumn("explained", F.col("eigenvalue") / F.sum("eigenvalue").over(whole))
    share = share.withColumn("cumulative", F.sum("explained").over(so_far))
    pos = F.row_number().over(whole.orderBy("component"))
    share = share.withColumn("pos", pos).withColumn("len", F.count("*").over(whole))
    reach = F.coalesce(F.min(F.when(F.col("cumulative") >= target, F.col("pos"))).over(whole), F.col("len"))
    keep = F.least(F.greatest(reach, F.lit(2)), F.col("len"))
    return share.select("component", "eigenvalue", "explained", "cumulative", (F.col("pos") <= keep).alias("retained"))
