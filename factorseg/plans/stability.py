"""Seed stability and the clean-up of small clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from factorseg.config import SegmentConfig
from factorseg.operators.agreement import adjusted_rand, merge_small_clusters
from factorseg.operators.joins import join_labels, size_outer_join
from factorseg.operators.kmeans import fit_kmeans, nearest_center
from factorseg.operators.profile import cluster_profile, cluster_sizes, mean_value_by_group, unclustered_summary
from factorseg.plans.report import persona_lines, value_summary


@dataclass
class Stability:
    summary: DataFrame      # tag, ari, n_clusters, n_samples
    sizes: DataFrame        # cluster, orig_size, new_size, delta
    comparison: DataFrame   # id, cluster_original, cluster_newseed


def seed_stability(tag: str, scores: DataFrame, labels: DataFrame, seed: int = 123, starts: int = 50,
                   features: str = "features", id_col: str = "customer_id") -> Stability:
    """Cluster the same scores again with another seed and compare.

    ``scores`` has (id, features), ``labels`` (id, cluster); they are matched by id.
    """
    k = labels.select("cluster").distinct().count()
    model = fit_kmeans(scores, features, [k], starts, seed, id_col)[k]
    both = (labels.select(id_col, F.col("cluster").cast("int").alias("cluster_original"))
            .join(scores.select(id_col, nearest_center(features, model).alias("cluster_newseed")), id_col)).persist()
    ari = adjusted_rand(both, "cluster_original", "cluster_newseed").first()
    summary = scores.sparkSession.createDataFrame(
        [(tag, float(ari["ari"]), int(k), int(ari["n"]))], "tag string, ari double, n_clusters int, n_samples long")
    size = lambda c: cluster_sizes(both.select(F.col(c).alias("cluster")))
    return Stability(summary, size_outer_join(size("cluster_original"), size("cluster_newseed")), both)


def stability_table(runs: list[Stability]) -> DataFrame:
    """The summary rows of several passes."""
    return reduce(DataFrame.unionByName, [r.summary for r in runs])


@dataclass
class Cleaned:
    labels: DataFrame       # id, cluster, cluster_final
    profiles: DataFrame
    value: DataFrame
    personas: DataFrame     # line_no, line
    value_bars: DataFrame   # cluster (with -1), n_customers, net_ltv_mean


def clean_small_clusters(tag: str, labels: DataFrame, features: DataFrame, cfg: SegmentConfig = SegmentConfig(),
                         value_col: str = "net_ltv", id_col: str = "customer_id") -> Cleaned:
    """Small clusters become -1; profiles, value and personas are redone without them.

    Means skip nulls here, as medians do.
    """
    final = merge_small_clusters(labels, cfg.small_cluster_pct)
    merged = join_labels(final, features, id_col)
    profiles = cluster_profile(merged.filter(F.col("cluster_final") != -1), "cluster_final", cfg.profile_categorical,
                               cfg.profile_numeric, cfg.match_col, cfg.promo_col, null_as_zero=False)
    text = persona_lines(profiles, tag, absent="—")
    escaped = tag.replace("%", "%%")
    un = unclustered_summary(final).filter(F.col("n_unclustered") > 0).select(
        F.lit(1 << 62).alias("line_no"),
        F.format_string(f"{escaped} — Unclustered (-1) — %d customers (%.1f%% of sample)",
                        F.col("n_unclustered"), F.col("pct")).alias("line"))
    bars = mean_value_by_group(merged, "cluster_final", value_col)
    return Cleaned(final, profiles, value_summary(profiles), text.unionByName(un), bars)
