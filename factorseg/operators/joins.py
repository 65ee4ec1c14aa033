"""Label and lookup joins. Sides are not forced to broadcast: Spark checks sizes at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


SMALL_ROWS = 10_000


def materialize_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A summary table as a broadcast side if it has at most ``max_rows`` rows, else unchanged.

    At most ``max_rows + 1`` rows reach the driver to settle that.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_labels(labels: DataFrame, features: DataFrame, on: str = "customer_id",
                how: str = "left") -> DataFrame:
    return labels.join(features, on, how)


def lookup_join(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Dictionary lookup against a table of (key, value); keys must be unique, misses give null."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias(out))
    return df.join(t, F.col(column) == F.col("_k"), "left").drop("_k")


def size_outer_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cluster, orig_size, new_size, delta) from two (cluster, n_customers) tables."""
    a = left.select("cluster", F.col("n_customers").alias("orig_size"))
    b = right.select("cluster", F.col("n_customers").alias("new_size"))
    return a.join(b, "cluster", "full_outer").withColumn("delta", F.col("new_size") - F.col("orig_size"))
