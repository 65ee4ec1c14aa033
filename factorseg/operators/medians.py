"""Exact medians per group without collecting a group.

``median`` keeps every distinct value of a group in one buffer, which fails when a group holds
a third of a large table. Here sketches of fixed size narrow the values around the middle, exact counts
keep the ranks, and only a bounded number of distinct values is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factorseg.functions.shape import value_rows
from factorseg.operators.joins import materialize_small
from factorseg.operators.lineage import cut_lineage

ACCURACY = 2000          # sketch size; rank error at most n / ACCURACY
RANK_ROWS = 4096         # distinct values of a group that are ranked in one window


def group_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys.., variable, median); nulls are skipped, an even count averages the middle two.

    Values are counted once. Quantiles of a group's distinct values from a sketch cut them into steps; exact counts tell the
    steps that hold the middle ranks, whatever the sketch's error. That repeats inside those steps until every group has
    few distinct values left, and only those are ranked.
    """
    keys = list(keys)
    by = keys + ["variable"]
    counted = cut_lineage(value_rows(df, keys, values).filter(F.col("value").isNotNull()).groupBy(*by, "value")
                          .agg(F.count("*").alias("c")))
    # (first, second): the 1-based middle ranks among the values that are still in the running
    total = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.min("value").alias("low"),
                                     F.max("value").alias("high"))
    state = cut_lineage(total.select(*by, F.lit(0).cast("bigint").alias("below"), "kinds", "low", "high",
                                     F.floor((F.col("n") + 1) / 2).alias("first"), F.floor((F.col("n") + 2) / 2).alias("second")))
    inside = _within(counted, state, by)
    while state.filter(F.col("kinds") > RANK_ROWS).take(1):
        open_ = inside.filter(F.col("kinds") > RANK_ROWS)
        # sixteen steps over the distinct values; exact counts tell the steps that hold the middle ranks
        q = F.percentile_approx("value", [0.0, *[i / 16 for i in range(1, 16)], 1.0], ACCURACY)
        cuts = open_.groupBy(*by).agg(q.alias("cuts"))
        placed = _joined(open_, cuts, by)
        step = F.size(F.filter("cuts", lambda x: x < F.col("value")))
        sizes = (placed.withColumn("step", step).groupBy(*by, "step")
                 .agg(F.sum("c").alias("c"), F.count("*").alias("kinds"), F.min("value").alias("low"), F.max("value").alias("high"),
                      F.first("below").alias("below"), F.first("first").alias("first"), F.first("second").alias("second")))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by).orderBy("step"))
        near = (sizes.withColumn("upto", upto).filter((F.col("upto") >= F.col("first")) & (F.col("upto") - F.col("c") < F.col("second")))
                .groupBy(*by).agg(F.min(F.col("upto") - F.col("c")).alias("below"), F.sum("kinds").alias("kinds"),
                                  F.min("low").alias("low"), F.max("high").alias("high"), F.first("first").alias("first"),
                                  F.first("second").alias("second")))
        state = cut_lineage(near.unionByName(state.filter(F.col("kinds") <= RANK_ROWS)))
        inside = _within(counted, state, by)
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by).orderBy("value"))
    covers = lambda r: (F.col("upto") >= F.col(r)) & (F.col("upto") - F.col("c") < F.col(r))
    mid = inside.withColumn("upto", upto).groupBy(*by).agg(
        F.max(F.when(covers("first"), F.col("value"))).alias("m1"), F.max(F.when(covers("second"), F.col("value"))).alias("m2"))
    return mid.select(*by, ((F.col("m1") + F.col("m2")) / 2).alias("median"))


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The groups' columns beside the rows; one row per group and variable is broadcast when that is few."""
    named = groups.select(*[F.col(k).alias(f"b_{k}") for k in by], *[c for c in groups.columns if c not in by])
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in by]
    return rows.join(materialize_small(named), same).drop(*[f"b_{k}" for k in by])


def _within(counted: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    return _joined(counted, state, by).filter(F.col("value").between(F.col("low"), F.col("high")))
