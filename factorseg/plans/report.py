"""Reports and plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorseg.functions.columns import plain_number
from factorseg.operators.assoc import correlation_matrix, correlation_summary, top_correlated_pair

# Columns of the value tables.
VALUE_SUMMARY = ("cluster", "n_customers", "net_ltv_mean", "net_ltv_median",
                 "avg_order_value_mean", "avg_order_value_median")
VALUE_COMPARISON = VALUE_SUMMARY + ("order_count_mean",)


def value_summary(profiles: DataFrame, tag: str | None = None) -> DataFrame:
    """The value columns a profile has, optionally tagged."""
    out = profiles.select(*[c for c in VALUE_SUMMARY if c in profiles.columns])
    return out if tag is None else out.withColumn("tag", F.lit(tag))


def value_comparison(profiles: dict[str, DataFrame]) -> DataFrame:
    """All approaches' value columns stacked; a column a profile lacks counts as 0."""
    parts = []
    for approach, p in profiles.items():
        cells = [F.col(c) if c in p.columns else F.lit(0.0).alias(c) for c in VALUE_COMPARISON]
        parts.append(p.select(F.lit(approach).alias("approach"), *cells))
    return reduce(DataFrame.unionByName, parts)


def persona_text(profiles: DataFrame, tag: str, absent: str = "0") -> Column:
    """One block of text per profile row. Absent texts show a dash, absent numbers ``absent``."""
    has = set(profiles.columns)
    # fixed values: the wording and order of the block below

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("—")) if c in has else F.lit("—")

    def num(c: str, missing: str = absent) -> Column:
        return plain_number(c) if c in has else F.lit(missing)

    return F.concat(
        F.lit(f"{tag} — Cluster "), F.col("cluster").cast("string"), F.lit(" — "),
        F.col("n_customers").cast("string"), F.lit(" customers\n- Quiz result: "), text("quiz_result_top"),
        F.lit("; Gender: "), text("gender_cat_top"), F.lit("; First-SKU: "), text("first_sku_bucket_top"),
        F.lit("\n- GI/BM: "), text("gi_symptom_cat_top"), F.lit(", "), text("bm_pattern_top"),
        F.lit("; Avg symptoms: "), num("symptom_count_mean"),
        F.lit("\n- Behavior: avg orders "), num("order_count_mean"), F.lit(", days since last order "),
        num("days_since_last_order_mean"), F.lit("; Quiz-match: "), num("quiz_reco_match_pct"),
        F.lit("%\n- VALUE: mean LTV $"), num("net_ltv_mean", "—"), F.lit(", mean AOV $"),
        num("avg_order_value_mean", "—"), F.lit("\n- Top promos: "), text("promo_1"), F.lit(" "), text("promo_2"),
        F.lit("\n"))


def persona_lines(profiles: DataFrame, tag: str, absent: str = "0") -> DataFrame:
    """(line_no, line): the personas in cluster order."""
    return profiles.select(F.col("cluster").cast("bigint").alias("line_no"),
                           persona_text(profiles, tag, absent).alias("line"))


def run_summary(results: dict, n_rows: int, n_features: int, cfg) -> list[tuple[str, str, str]]:
    """(section, metric, value) of a two-pass run."""
    rows = [("run", "rows", f"{n_rows:,}"), ("run", "seed", str(cfg.seed)), ("run", "features", str(n_features))]
    for tag, r in results.items():
        rows += [(tag, "clusters", str(r.chosen_k)), (tag, "silhouette", f"{r.silhouette:.4f}"),
                 (tag, "final_silhouette", f"{r.final_silhouette:.4f}"),
                 (tag, "components", str(r.n_keep)), (tag, "variance_pct", f"{r.cumvar * 100:.1f}")]
        # one row per cluster, k of them
        rows += [(tag, f"size_cluster_{p['cluster']}", f"{p['n_customers']:,}")
                 for p in r.profiles.select("cluster", "n_customers").orderBy("cluster").collect()]
    return rows + [("settings", "coverage_pct", f"{cfg.coverage * 100:.0f}"),
                   ("settings", "dominance_pct", f"{cfg.dominance * 100:.1f}"),
                   ("settings", "variance_target_pct", f"{cfg.explained_target * 100:.0f}"),
                   ("settings", "prune_pct", f"{cfg.prune_fraction * 100:.0f}")]


def summary_table(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "section string, metric string, value string")


def summary_lines(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(line_no, line): the summary as text, a heading per section."""
    lines, section = [], None
    for s, metric, value in rows:
        if s != section:
            lines += ([""] if lines else []) + [f"## {s}"]
            section = s
        lines.append(f"- {metric}: {value}")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def factor_correlation_report(scores: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The factors' correlation matrix (long), and one summary row with the most correlated pair."""
    factors = [c for c in scores.columns if c.startswith("Factor_")]
    if not factors:
        raise ValueError("no Factor_ columns in the score table")
    matrix = correlation_matrix(scores, factors).persist()
    pair = top_correlated_pair(matrix).first()
    summary = correlation_summary(matrix).select(F.lit(tag).alias("tag"), "*")
    if pair is not None:
        summary = summary.withColumns({k: F.lit(pair[k]) for k in ("row_var", "col_var", "r", "band")})
    return matrix, summary


# ---- plot-ready tables ------------------------------------------------------

def _two_dims(coordinates: DataFrame, value: Column, *keys: str) -> DataFrame:
    dim = lambda j: F.max(F.when(F.col("component") == j, value)).alias(f"dim{j}")
    return coordinates.groupBy(*keys).agg(dim(1), dim(2))


def correlation_circle(model, spark: SparkSession) -> DataFrame:
    """(variable, kind, dim1, dim2): r for numerics, eta2 for categoricals."""
    return _two_dims(model.coordinates_table(spark), F.coalesce("signed", "squared"), "variable", "kind")


def variable_quality(model, spark: SparkSession) -> DataFrame:
    """(variable, dim1, dim2, contribution): squared coordinates and the contribution to both axes."""
    at = _two_dims(model.coordinates_table(spark), F.col("squared"), "variable")
    part = (model.contributions_table(spark).filter(F.col("component") <= 2)
            .groupBy("variable").agg(F.sum("contribution").alias("contribution")))
    return at.join(part, "variable")


def category_map(model, spark: SparkSession) -> DataFrame:
    """(variable, level, dim1, dim2): mean position of each level's rows."""
    return _two_dims(model.centroids_table(spark), F.col("centroid"), "variable", "level")


def cluster_scatter(clustered: DataFrame, features: str = "features") -> DataFrame:
    """(dim1, dim2, cluster) of every row."""
    return clustered.select(F.col(features)[0].alias("dim1"), F.col(features)[1].alias("dim2"), "cluster")


def individuals_map(scores: DataFrame, id_col: str = "customer_id") -> DataFrame:
    return scores.select(id_col, F.col("Factor_1").alias("dim1"), F.col("Factor_2").alias("dim2"))


def scree_table(model, spark: SparkSession) -> DataFrame:
    return model.explained_table(spark).select("component", "eigenvalue", "explained_variance", "inertia_pct")


def value_bars(comparison: DataFrame) -> DataFrame:
    """(approach, label, panel, value): the four panels of the value comparison."""
    label = F.concat("approach", F.lit(" C"), F.col("cluster").cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("panel"), F.col(c).cast("double").alias("value"))
                      for c in ("net_ltv_mean", "avg_order_value_mean", "order_count_mean", "n_customers")])
    return comparison.select("approach", label.alias("label"), F.inline(cells))
