"""Per-cluster profiles: sizes, modal values, means, medians, match rate and promotion mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from factorseg.functions.columns import number, round_even, share_label
from factorseg.functions.shape import level_rows
from factorseg.operators.medians import group_medians


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n_customers"))


def group_level_counts(df: DataFrame, cluster: str, cats: Sequence[str]) -> DataFrame:
    """(cluster, variable, level, n), nulls left out."""
    return (level_rows(df, [F.col(cluster).alias("cluster")], cats, fill=False)
            .filter(F.col("level").isNotNull())
            .groupBy("cluster", "variable", "level").agg(F.count("*").alias("n")))


def group_value_shares(df: DataFrame, cluster: str, cats: Sequence[str]) -> DataFrame:
    """(cluster, variable, level, n, share within cluster and variable)."""
    counts = group_level_counts(df, cluster, cats)
    totals = counts.groupBy("cluster", "variable").agg(F.sum("n").alias("total"))
    return (counts.join(totals, ["cluster", "variable"])
            .select("cluster", "variable", "level", "n", (F.col("n") / F.col("total")).alias("share")))


def modal_values(df: DataFrame, cluster: str, cats: Sequence[str]) -> DataFrame:
    """(cluster, variable, top, share); a tie goes to the smallest value."""
    counts = group_level_counts(df, cluster, cats)
    best = F.min(F.struct((-F.col("n")).alias("neg"), "level"))
    return (counts.groupBy("cluster", "variable").agg(best.alias("b"), F.sum("n").alias("total"))
            .select("cluster", "variable", F.col("b.level").alias("top"),
                    (-F.col("b.neg") / F.col("total")).alias("share")))


def top_values(df: DataFrame, cluster: str, column: str, top: int = 3) -> DataFrame:
    """(cluster, rank, value, share) of a column's most frequent values."""
    counts = group_level_counts(df, cluster, [column])
    totals = counts.groupBy("cluster").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), F.asc("level"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return (ranked.join(totals, "cluster")
            .select("cluster", "rank", F.col("level").alias("value"), (F.col("n") / F.col("total")).alias("share")))


def promo_mix(df: DataFrame, cluster: str, column: str, top: int = 3) -> DataFrame:
    """(cluster, promo_1..promo_n) as ``code:share%``."""
    rows = top_values(df, cluster, column, top).withColumn("label", share_label("value", "share"))
    return rows.groupBy("cluster").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("label"))).alias(f"promo_{i}") for i in range(1, top + 1)])


def group_numeric_means(df: DataFrame, cluster: str, nums: Sequence[str]) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        *[F.avg(number(df, c)).alias(f"{c}_mean") for c in nums])


def cluster_profile(df: DataFrame, cluster: str, cats: Sequence[str], nums: Sequence[str],
                    match_col: str | None = None, promo_col: str | None = None,
                    null_as_zero: bool = True, top_promos: int = 3) -> DataFrame:
    """One wide row per cluster, columns ``<cat>_top/_pct``, ``<num>_mean/_median``,
    ``<match>_pct`` and ``promo_1..n``; columns absent from the frame are left out.

    With ``null_as_zero`` a mean counts nulls as 0; a median always skips them.
    """
    cats = [c for c in cats if c in df.columns]
    nums = [c for c in nums if c in df.columns]
    df = df.filter(F.col(cluster).isNotNull())
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    means = [round_even(F.avg(zero(number(df, c)) if null_as_zero else number(df, c)), 2).alias(f"{c}_mean")
             for c in nums]
    match = []
    if match_col and match_col in df.columns:
        match = [round_even(F.avg(zero(number(df, match_col))) * 100, 1).alias(f"{match_col}_pct")]
    out = df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n_customers"), *means, *match)
    if cats:
        pick = lambda c, v: F.max(F.when(F.col("variable") == c, v))
        tops = modal_values(df, cluster, cats).groupBy("cluster").agg(*[
            e for c in cats for e in (
                pick(c, F.col("top")).alias(f"{c}_top"),
                pick(c, round_even(F.col("share") * 100, 1)).alias(f"{c}_pct"))])
        out = out.join(tops, "cluster", "left")
    if nums:
        keyed = df.select(F.col(cluster).alias("cluster"), *[number(df, c).alias(c) for c in nums])
        med = group_medians(keyed, ["cluster"], {c: F.col(c) for c in nums}).groupBy("cluster").agg(*[
            round_even(F.max(F.when(F.col("variable") == c, F.col("median"))), 2).alias(f"{c}_median")
            for c in nums])
        out = out.join(med, "cluster", "left")
    if promo_col and promo_col in df.columns:
        out = out.join(promo_mix(df, cluster, promo_col, top_promos), "cluster", "left")
    order = ["cluster", "n_customers"]
    order += [f"{c}_{s}" for c in cats for s in ("top", "pct")]
    order += [f"{c}_{s}" for c in nums for s in ("mean", "median")]
    order += [c for c in out.columns if c not in order]
    return out.select(*order).orderBy("cluster")


def mean_value_by_group(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(cluster, n_customers, mean), the unclustered bucket included."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n_customers"), F.avg(number(df, value)).alias(f"{value}_mean"))


def unclustered_summary(df: DataFrame, cluster: str = "cluster_final") -> DataFrame:
    """(n_unclustered, n_total, pct)."""
    un = F.coalesce(F.sum(F.when(F.col(cluster) == -1, 1).otherwise(0)), F.lit(0))
    n = F.count("*")
    return df.agg(un.alias("n_unclustered"), n.alias("n_total"),
                  F.when(n > 0, F.lit(100.0) * un / n).alias("pct"))
