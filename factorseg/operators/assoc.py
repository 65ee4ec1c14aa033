"""Association between variables: contingency, chi-squared, phi-squared, eta-squared, R-squared."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from factorseg.functions.columns import category_filled, correlation_band, number, number_filled, round_even
from factorseg.functions.shape import level_rows
from factorseg.operators.quality import level_counts

PAIRS_PER_JOB = 100  # correlation expressions in one aggregate


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(level_a, level_b, n)."""
    return (df.groupBy(category_filled(a).alias("level_a"), category_filled(b).alias("level_b"))
            .agg(F.count("*").alias("n")))


def pair_counts(df: DataFrame, cats: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(var_a, var_b, level_a, level_b, n) for each pair of categoricals, a before b in input order.

    Pairs are formed inside each row; counting combines before the shuffle.
    """
    pairs = list(combinations(cats, 2))
    w = F.lit(1).cast("bigint") if weight is None else weight
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), category_filled(a).alias("level_a"),
                               category_filled(b).alias("level_b"))
                      for i, (a, b) in enumerate(pairs)])
    counts = (df.select(w.alias("w"), F.inline(cells))
              .groupBy("pair", "level_a", "level_b").agg(F.sum("w").alias("n")))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)
    return counts.select(name(0).alias("var_a"), name(1).alias("var_b"), "level_a", "level_b", "n")


def chi_squared(counts: DataFrame, correction: str = "auto") -> DataFrame:
    """(var_a, var_b, n, dof, chi2, phi2) from ``pair_counts``.

    ``auto`` applies Yates' correction to 2x2 tables, ``none`` never. Marginals come from the
    pair's own cells. The plain form needs the observed cells only; in the corrected form all
    four cells deviate equally, so one cell's deviation and the marginals are enough.
    """
    pair = ["var_a", "var_b"]
    row = counts.groupBy(*pair, "level_a").agg(F.sum("n").alias("ra"))
    col = counts.groupBy(*pair, "level_b").agg(F.sum("n").alias("cb"))
    rows = row.groupBy(*pair).agg(F.count("*").alias("n_a"), F.sum("ra").alias("n"),
                                  F.sum(1 / F.col("ra")).alias("inv_a"))
    cols = col.groupBy(*pair).agg(F.count("*").alias("n_b"), F.sum(1 / F.col("cb")).alias("inv_b"))
    cells = (counts.join(row, pair + ["level_a"]).join(col, pair + ["level_b"])
             .groupBy(*pair).agg(
                 F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"),
                 F.min(F.struct("level_a", "level_b", "n", "ra", "cb")).alias("c")))
    t = cells.join(rows, pair).join(cols, pair)
    n = F.col("n").cast("double")
    dof = (F.col("n_a") - 1) * (F.col("n_b") - 1)
    plain = F.when(dof == 0, F.lit(0.0)).otherwise(n * (F.col("s") - 1))
    gap = F.abs(F.col("c.n") - F.col("c.ra") * F.col("c.cb") / n) - 0.5
    yates = F.pow(F.greatest(gap, F.lit(0.0)), 2) * n * F.col("inv_a") * F.col("inv_b")
    chi2 = F.when(dof == 1, yates).otherwise(plain) if correction == "auto" else plain
    return t.select(*pair, F.col("n").cast("bigint").alias("n"), dof.alias("dof"), chi2.alias("chi2"),
                    (chi2 / n).alias("phi2"))


def phi_squared(df: DataFrame, cats: Sequence[str], correction: str = "auto") -> DataFrame:
    return chi_squared(pair_counts(df, cats), correction)


def _pairwise(df: DataFrame, columns: dict[str, Column], measure: str = "r") -> DataFrame:
    """(var_a, var_b, r) over all pairs, a before b; wide inputs are spread over several aggregates."""
    pairs = list(combinations(columns, 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        some = pairs[start:start + PAIRS_PER_JOB]
        one = df.agg(*[F.corr(columns[a], columns[b]).alias(f"r_{i}") for i, (a, b) in enumerate(some)])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"r_{i}").alias(measure))
            for i, (a, b) in enumerate(some)]))))
    return reduce(DataFrame.unionByName, parts)


def r_squared(df: DataFrame, nums: Sequence[str]) -> DataFrame:
    """(var_a, var_b, r2); nulls count as 0."""
    r = _pairwise(df, {c: number_filled(df, c) for c in nums})
    return r.select("var_a", "var_b", (F.col("r") * F.col("r")).alias("r2"))


def eta_squared(df: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> DataFrame:
    """(num_var, cat_var, eta2) over rows where both are given.

    Count, mean and variance per level give both sums of squares, so one pass is enough.
    Fewer than two groups or no variance gives 0.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cats])
    rows = df.select(*[number(df, c).alias(f"x_{i}") for i, c in enumerate(nums)], F.inline(cells))
    aggs = []
    for i in range(len(nums)):
        x = F.col(f"x_{i}")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.var_pop(x).alias(f"v_{i}")]
    groups = rows.filter(F.col("level").isNotNull()).groupBy("variable", "level").agg(*aggs)
    long = groups.select("variable", F.inline(F.array(*[
        F.struct(F.lit(c).alias("num_var"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("m"),
                 F.col(f"v_{i}").alias("v")) for i, c in enumerate(nums)])))
    long = long.filter(F.col("n") > 0)
    n = F.sum("n")
    # between groups: the variance of group means, weighted by group size
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2))
    within = F.sum(F.col("n") * F.col("v"))
    mean = long.groupBy("variable", "num_var").agg((F.sum(F.col("n") * F.col("m")) / n).alias("mean"))
    out = (long.join(mean, ["variable", "num_var"]).groupBy("num_var", F.col("variable").alias("cat_var"))
           .agg(F.count("*").alias("g"), between.alias("ssb"), within.alias("ssw")))
    total = F.col("ssb") + F.col("ssw")
    eta = F.when((F.col("g") < 2) | (total == 0), F.lit(0.0)).otherwise(F.col("ssb") / total)
    every = df.sparkSession.createDataFrame([(a, b) for a in nums for b in cats], "num_var string, cat_var string")
    return (every.join(out.select("num_var", "cat_var", eta.alias("eta2")), ["num_var", "cat_var"], "left")
            .select("num_var", "cat_var", F.coalesce("eta2", F.lit(0.0)).alias("eta2")))


def _both_ways(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    sides = F.array(F.struct(F.col(a).alias("row_var"), F.col(b).alias("col_var"), F.col(value).alias("value")),
                    F.struct(F.col(b).alias("row_var"), F.col(a).alias("col_var"), F.col(value).alias("value")))
    return pairs.select(F.inline(sides))


def relationship_matrix(df: DataFrame, nums: Sequence[str], cats: Sequence[str],
                        correction: str = "auto", digits: int | None = 3) -> DataFrame:
    """(row_var, col_var, value): R2 between numerics, phi2 between categoricals, eta2 across;
    the diagonal is 1 for a numeric and levels - 1 for a categorical."""
    spark = df.sparkSession
    parts = []
    if nums:
        parts.append(spark.createDataFrame([(c, c, 1.0) for c in nums],
                                           "row_var string, col_var string, value double"))
    if cats:
        levels = level_counts(df, cats, fill=False).filter(F.col("level").isNotNull())
        parts.append(levels.groupBy("variable").agg((F.count("*") - 1).cast("double").alias("value"))
                     .select(F.col("variable").alias("row_var"), F.col("variable").alias("col_var"), "value"))
    if len(nums) > 1:
        parts.append(_both_ways(r_squared(df, nums), "var_a", "var_b", "r2"))
    if len(cats) > 1:
        parts.append(_both_ways(phi_squared(df, cats, correction), "var_a", "var_b", "phi2"))
    if nums and cats:
        parts.append(_both_ways(eta_squared(df, nums, cats), "num_var", "cat_var", "eta2"))
    out = reduce(DataFrame.unionByName, parts)
    return out if digits is None else out.withColumn("value", round_even("value", digits))


def matrix_wide(long: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """Long (row_var, col_var, value) to one column per variable."""
    return long.groupBy("row_var").pivot("col_var", list(names)).agg(F.first(value))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_var, col_var, r) with both triangles and the diagonal."""
    pairs = _both_ways(_pairwise(df, {c: F.col(c).cast("double") for c in columns}), "var_a", "var_b", "r")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns],
                                               "row_var string, col_var string, value double")
    return pairs.unionByName(diagonal).withColumnRenamed("value", "r")


def correlation_summary(matrix: DataFrame) -> DataFrame:
    """(n_columns, min_r, max_r, mean_abs_r) off the diagonal."""
    off = matrix.filter(F.col("row_var") != F.col("col_var"))
    return off.agg(F.count_distinct("row_var").alias("n_columns"), F.min("r").alias("min_r"),
                   F.max("r").alias("max_r"), F.avg(F.abs("r")).alias("mean_abs_r"))


def top_correlated_pair(matrix: DataFrame) -> DataFrame:
    """(row_var, col_var, r, band) of the largest absolute value; a tie goes to the first names."""
    off = matrix.filter((F.col("row_var") != F.col("col_var")) & F.col("r").isNotNull())
    best = off.agg(F.min(F.struct((-F.abs("r")).alias("neg"), "row_var", "col_var", "r")).alias("b"))
    return best.select("b.row_var", "b.col_var", "b.r", correlation_band(F.col("b.r")).alias("band"))


def loading_summary(loadings: DataFrame, value: str = "loading") -> DataFrame:
    """(n_positive, n_negative, min_loading, max_loading), NaN left out."""
    v = F.col(value)
    ok = loadings.filter(v.isNotNull() & ~F.isnan(v))
    return ok.agg(F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"),
                  F.min(v).alias("min_loading"), F.max(v).alias("max_loading"))
