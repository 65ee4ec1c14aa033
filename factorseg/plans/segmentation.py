"""The segmentation pass: factor analysis, pruning, refit, k-means, profiles; and the two-pass run."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from factorseg.config import SegmentConfig
from factorseg.operators.famd import FamdModel, MixedStats, decompose, mixed_stats, prune_variables, restrict
from factorseg.operators.kmeans import KMeansModel, assign_all, fit_kmeans, nearest_center
from factorseg.operators.profile import cluster_profile
from factorseg.operators.quality import dominance_filter
from factorseg.operators.silhouette import silhouettes


@dataclass
class PassResult:
    tag: str
    chosen_k: int
    silhouette: float              # of the search's model for the chosen k
    final_silhouette: float        # of the labels returned
    curve: list[tuple[int, float | None]]
    first_fit: FamdModel
    famd: FamdModel
    kmeans: KMeansModel
    scored: DataFrame              # the base columns and ``features``; cached
    clustered: DataFrame           # the same with ``cluster``
    profiles: DataFrame
    id_col: str = "customer_id"

    @property
    def n_keep(self) -> int:
        return self.famd.n_keep

    @property
    def cumvar(self) -> float:
        return self.famd.kept_share

    @property
    def cluster_col(self) -> str:
        return f"cluster_{self.tag}"

    @property
    def labels(self) -> DataFrame:
        return self.clustered.select(self.id_col, F.col("cluster").alias(self.cluster_col))

    @property
    def scores(self) -> DataFrame:
        """The id and Factor_1..n."""
        return self.clustered.select(self.id_col, *[F.col("features")[j].alias(f"Factor_{j + 1}")
                                                    for j in range(self.n_keep)])

    def silhouette_curve(self) -> DataFrame:
        return self.clustered.sparkSession.createDataFrame(self.curve, "k int, silhouette double")

    def release(self) -> None:
        self.scored.unpersist()


def choose_k(scored: DataFrame, ks: Sequence[int], starts: int, seed: int = 42, features: str = "features",
             id_col: str = "customer_id", metric: str = "squared_euclidean"):
    """(best k, its silhouette, curve, models); the smallest k wins a tie."""
    models = fit_kmeans(scored, features, ks, starts, seed, id_col)
    ordered = [models[k] for k in sorted(models)]
    values = silhouettes(assign_all(scored, features, ordered), "features", "labels", metric)
    curve = [(m.k, v) for m, v in zip(ordered, values)]
    best_k, best_s = None, -1.0
    for k, v in curve:
        if v > best_s:
            best_k, best_s = k, v
    if best_k is None:
        best_k, best_s = curve[0]
    return best_k, best_s, curve, models


def extend_starts(scored: DataFrame, found: KMeansModel, done: int, starts: int, seed: int,
                  features: str = "features", id_col: str = "customer_id") -> KMeansModel:
    """The best of ``starts`` starts, given the best of the first ``done``."""
    if starts <= done:
        return found
    more = fit_kmeans(scored, features, [found.k], starts, seed, id_col, first_start=done)[found.k]
    return more if more.inertia < found.inertia else found


def segment_pass(tag: str, base: DataFrame, cats: Sequence[str], nums: Sequence[str],
                 cfg: SegmentConfig = SegmentConfig(), force_k: int | None = None,
                 stats: MixedStats | None = None, id_col: str = "customer_id") -> PassResult:
    """One pass over a modelling frame that the caller has cached.

    The refit on the surviving variables uses the same statistics, and labels are computed next
    to the base columns, so neither the refit nor the profile needs another read or a join.
    """
    cats, nums = [c for c in cats if c in base.columns], [c for c in nums if c in base.columns]
    if stats is None:
        cats, nums = dominance_filter(base, cats, nums, cfg.dominance)
        stats = mixed_stats(base, cats, nums)
    else:
        cats, nums = [c for c in cats if c in stats.cats], [c for c in nums if c in stats.nums]
        stats = restrict(stats, cats + nums)
    first = decompose(stats, cats + nums, cfg.explained_target, cfg.max_components)
    keep = prune_variables(first, cfg.prune_fraction, cfg.min_contribution_pct)
    famd = decompose(restrict(stats, keep), keep, cfg.explained_target, cfg.max_components)

    scored = spread_rows(famd.transform(base, keep=base.columns, as_array="features"), id_col).persist()
    if force_k is None:
        k, score, curve, models = choose_k(scored, cfg.k_range, cfg.search_starts, cfg.seed,
                                           id_col=id_col, metric=cfg.silhouette_metric)
    else:
        models = fit_kmeans(scored, "features", [force_k], cfg.search_starts, cfg.seed, id_col)
        labelled = assign_all(scored, "features", [models[force_k]])
        k, score = force_k, silhouettes(labelled, "features", "labels", cfg.silhouette_metric)[0]
        curve = [(i, None) for i in cfg.k_range]
    final = extend_starts(scored, models[k], cfg.search_starts, cfg.final_starts, cfg.seed, id_col=id_col)
    final_score = score
    if final is not models[k]:
        final_score = silhouettes(assign_all(scored, "features", [final]), "features", "labels",
                                  cfg.silhouette_metric)[0]
    clustered = scored.withColumn("cluster", nearest_center("features", final))
    profiles = cluster_profile(clustered, "cluster", cfg.profile_categorical, cfg.profile_numeric,
                               cfg.match_col, cfg.promo_col)
    return PassResult(tag, k, score, final_score, curve, first, famd, final, scored, clustered, profiles,
                      id_col)


def spread_rows(df: DataFrame, id_col: str) -> DataFrame:
    """The rows dealt out anew for compute-heavy steps, at least one partition a core."""
    spark = df.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wide, spark.sparkContext.defaultParallelism), id_col)


def two_pass(base: DataFrame, cats: Sequence[str], nums: Sequence[str], value: Sequence[str],
             cfg: SegmentConfig = SegmentConfig(), tags: Sequence[str] = ("A_withLTV", "B_noLTV"),
             id_col: str = "customer_id") -> dict[str, PassResult]:
    """Pass A with the value columns in the analysis, pass B without.

    B's variables are part of A's, so one set of statistics serves both; the passes then run
    side by side.
    """
    value = [c for c in value if c in base.columns]
    base = base.persist()
    kept_cats, kept_nums = dominance_filter(base, cats, [*nums, *value], cfg.dominance)
    stats = mixed_stats(base, kept_cats, kept_nums)
    jobs = [(tags[0], [*nums, *value], cfg.force_k_a), (tags[1], list(nums), cfg.force_k_b)]
    run = lambda tag, columns, k: segment_pass(tag, base, cats, columns, cfg, k, stats, id_col)
    with ThreadPoolExecutor(len(jobs)) as pool:
        # the wrapper is made per job: it copies the caller's local properties
        running = [pool.submit(inheritable_thread_target(base.sparkSession)(run), *job) for job in jobs]
        results = [r.result() for r in running]
    return dict(zip(tags, results))
