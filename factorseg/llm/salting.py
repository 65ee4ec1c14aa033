"""A join of rows to a summary of their keys in which no key, however frequent, is one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 64   # keys with more than 1 / HOT_KEYS of all rows are salted, so there are fewer of them than this
SALTS = 64


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``summary`` (one row per key with its number of rows in ``count``, which is dropped); null keys meet.

    The rows of frequent keys are dealt by ``spread`` over SALTS copies of the key's summary row; the planner
    broadcasts the summary where its written size is small.
    """
    total = summary.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    frequent = summary.filter(F.col(count) * HOT_KEYS > F.lit(total)).select(*keys).collect()  # fewer than HOT_KEYS rows
    same = [reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]) for r in frequent]
    hot = reduce(Column.__or__, same, F.lit(False))
    salted = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = summary.drop(count).withColumn("_salt", F.explode(F.when(
        hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    copies = copies.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_salt").alias("_salt_b"),
                           *[c for c in copies.columns if c not in (*keys, "_salt")])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_salt") == F.col("_salt_b"))
    return salted.join(copies, on, how).drop("_salt", "_salt_b", *[f"_key_{k}" for k in keys])
