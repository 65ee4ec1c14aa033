"""Agreement of two labelings and clean-up of small clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factorseg.operators.joins import materialize_small


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari): adjusted Rand index from the contingency counts."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))
    n = F.col("n").cast("double")
    both = cells.agg(pairs(n).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").cast("double").alias("n")).agg(pairs(n).alias("s")).scalar()
    sa, sb = F.col("sa"), F.col("sb")
    every = F.col("total") * (F.col("total") - 1) / 2
    expected = F.when(every > 0, sa * sb / every).otherwise(0.0)
    top = (sa + sb) / 2
    ari = F.when((top - expected) == 0, F.lit(1.0)).otherwise((F.col("s") - expected) / (top - expected))
    return (both.select("s", "total", side("a").alias("sa"), side("b").alias("sb"))
            .select(F.col("total").cast("bigint").alias("n"), ari.alias("ari")))


def min_cluster_size(n: Column, pct: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(float(pct)) * n))


def merge_small_clusters(labels: DataFrame, pct: float = 0.05, cluster: str = "cluster") -> DataFrame:
    """Adds ``cluster_final``: the label, or -1 when its cluster is below ``pct`` of all rows.

    Only the clusters that stay are joined back; they are broadcast if few.
    """
    sizes = labels.groupBy(F.col(cluster).alias("kept_cluster")).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("n")).scalar()
    kept = sizes.filter(F.col("size") >= min_cluster_size(total, pct)).select("kept_cluster")
    final = F.when(F.col("kept_cluster").isNull(), F.lit(-1)).otherwise(F.col(cluster).cast("int"))
    return (labels.join(materialize_small(kept), F.col(cluster) == F.col("kept_cluster"), "left")
            .withColumn("cluster_final", final.cast("int")).drop("kept_cluster"))
