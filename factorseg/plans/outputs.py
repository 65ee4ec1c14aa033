"""The result tables of a run under their usual names, and the mixed-data validation run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.config import CleaningSpec, SegmentConfig
from factorseg.operators.assoc import matrix_wide
from factorseg.operators.famd import FamdModel, fit_famd, prune_list, ranked_contributions
from factorseg.operators.heavy_hitters import frequent_values
from factorseg.plans import catalogue
from factorseg.plans.cleaning import prepare_types_keep_nulls, prepared_rows
from factorseg.plans.report import (factor_correlation_report, persona_lines, run_summary, summary_lines, value_comparison,
                                    value_summary)
from factorseg.plans.segmentation import PassResult, spread_rows
from factorseg.plans.stability import clean_small_clusters, seed_stability, stability_table
from factorseg.sources.tables import read_labels, require_columns, select_prefix, write_report, write_table


def wide_components(long: DataFrame, key: str, value: str, n: int, prefix: str = "Factor_") -> DataFrame:
    """(key, component, value) to one column per component."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("component") == j, F.col(value))).alias(f"{prefix}{j}")
                                   for j in range(1, n + 1)])


def fit_tables(name: str, model: FamdModel, spark: SparkSession) -> dict[str, DataFrame]:
    contributions = model.contributions_table(spark)
    total = contributions.select("variable", "total_contribution_pct").distinct()
    wide = wide_components(contributions, "variable", "contribution", model.n_keep, "component_")
    return {
        f"{name}_explained_variance": model.explained_table(spark),
        f"{name}_variable_contributions": wide.join(total, "variable").orderBy(F.desc("total_contribution_pct")),
        f"{name}_factor_interpretation": model.interpretation_table(spark),
        f"{name}_relationship_matrix": matrix_wide(model.relationship_table(spark), model.variables),
        f"{name}_variable_coordinates": wide_components(model.coordinates_table(spark), "variable", "squared", model.n_keep),
        f"{name}_loading_matrix": wide_components(model.loadings_table(spark), "variable", "loading", model.n_keep),
    }


def pass_tables(r: PassResult) -> dict[str, DataFrame]:
    """Every table of one pass."""
    spark = r.clustered.sparkSession
    ranked = ranked_contributions(r.first_fit, spark)
    pruned = prune_list(ranked.select("variable", "total_contrib_pct"))
    dropped = [v for v in r.first_fit.variables if v not in r.famd.variables]
    return {
        **fit_tables(f"{r.tag}_initial", r.first_fit, spark),
        **fit_tables(f"{r.tag}_final", r.famd, spark),
        f"{r.tag}_feature_contributions_ranked": pruned.select("variable", "total_contrib_pct").orderBy(
            F.desc("total_contrib_pct"), "variable"),
        f"{r.tag}_pruned_features": spark.createDataFrame([(v,) for v in sorted(dropped)], "dropped_feature string"),
        f"{r.tag}_final_factor_scores": r.scores,
        f"{r.tag}_factor_correlation_matrix": matrix_wide(factor_correlation_report(r.scores, r.tag)[0], r.famd.factor_names, "r"),
        f"{r.tag}_silhouette": r.silhouette_curve(),
        f"{r.tag}_labels": r.labels,
        f"{r.tag}_cluster_profiles": r.profiles,
        f"{r.tag}_value_by_cluster": value_summary(r.profiles, r.tag),
    }


def run_outputs(results: dict[str, PassResult], base: DataFrame | None = None,
                cfg: SegmentConfig = SegmentConfig()) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables of all passes with the comparison, and the persona, factor-correlation and, with ``base``, run-summary texts."""
    tables = {name: df for r in results.values() for name, df in pass_tables(r).items()}
    tables["clustering_value_comparison"] = value_comparison({t: r.profiles for t, r in results.items()})
    texts = {f"{t}_personas": persona_lines(r.profiles, t) for t, r in results.items()}
    texts |= {f"{t}_factor_correlations": correlation_lines(r.scores, t) for t, r in results.items()}
    if base is not None:
        spark = base.sparkSession
        texts["run_summary"] = summary_lines(spark, run_summary(results, base.count(), len(base.columns) - 1, cfg))
    return tables, texts


def write_run(results: dict[str, PassResult], folder: str, fmt: str = "parquet", mode: str = "errorifexists",
              base: DataFrame | None = None, cfg: SegmentConfig = SegmentConfig()) -> list[str]:
    """Every output of a run under its name in ``folder``; returns the names written."""
    tables, texts = run_outputs(results, base, cfg)
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt, mode)
    for name, lines in texts.items():
        write_report(lines, f"{folder}/{name}", mode)
    return [*tables, *texts]


def publish_run(results: dict[str, PassResult], folder: str, base: DataFrame, cfg: SegmentConfig = SegmentConfig(),
                raw: DataFrame | None = None, fmt: str = "parquet") -> int:
    """The outputs of a run as one entry of the catalogue in ``folder``, run summary included; with ``raw`` its schema summary too."""
    tables, texts = run_outputs(results, base, cfg)
    if raw is not None:
        texts["schema_summary"] = schema_lines(raw)
    return catalogue.publish(base.sparkSession, folder, tables, texts, fmt)


def correlation_lines(scores: DataFrame, tag: str) -> DataFrame:
    """(line_no, line): the factor-correlation summary of one pass as text."""
    summary = factor_correlation_report(scores, tag)[1]
    number = lambda c: F.coalesce(F.round(F.col(c), 4).cast("string"), F.lit("nan"))
    cells = [F.concat(F.lit(f"- {f.name}: "), number(f.name) if f.dataType.typeName() == "double"
                      else F.coalesce(F.col(f.name).cast("string"), F.lit(""))) for f in summary.schema if f.name != "tag"]
    lines = F.array(F.concat(F.lit("## factor correlations "), F.col("tag")), *cells)
    return summary.select(F.posexplode(lines).alias("line_no", "line"))


def schema_lines(df: DataFrame, top: int = 10) -> DataFrame:
    """(line_no, line): every column with its type and its most frequent values, as text."""
    at = F.element_at(F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))]), F.col("column"))
    profile = frequent_values(df, top)
    heads = profile.filter("rank = 1").select((at * (top + 1)).alias("line_no"), F.concat("column", F.lit(" ("), "data_type", F.lit(")")).alias("line"))
    values = profile.select((at * (top + 1) + F.col("rank")).alias("line_no"), F.concat(
        F.lit("  "), F.coalesce("value", F.lit("null")), F.lit(": "), F.col("n").cast("string")).alias("line"))
    return heads.unionByName(values)


def write_stability(spark: SparkSession, folder: str, tags: Sequence[str], cfg: SegmentConfig = SegmentConfig(),
                    fmt: str = "parquet", mode: str = "errorifexists", id_col: str = "customer_id") -> list[str]:
    """Seed stability of passes whose score and label tables are stored in ``folder``; the results are written there."""
    runs, names = [], []
    for tag in tags:
        scores = require_columns(spark.read.format(fmt).load(f"{folder}/{tag}_final_factor_scores"), [id_col])
        labels = read_labels(spark.read.format(fmt).load(f"{folder}/{tag}_labels"), tag, id_col)
        factors = select_prefix(scores, "Factor_")
        features = spread_rows(scores.select(id_col, F.array(*[F.col(c).cast("double") for c in factors]).alias("features")), id_col).persist()
        run = seed_stability(tag, features, labels, cfg.stability_seed, cfg.final_starts, id_col=id_col)
        for name, df in ((f"{tag}_stability_sizes", run.sizes), (f"{tag}_labels_stability", run.comparison)):
            write_table(df, f"{folder}/{name}", fmt, mode)
            names.append(name)
        runs.append(run)
        features.unpersist()
    write_table(stability_table(runs), f"{folder}/two_pass_seed_stability_summary", fmt, mode)
    return [*names, "two_pass_seed_stability_summary"]


def write_clean(folder: str, tag: str, raw: DataFrame, spec: CleaningSpec, cfg: SegmentConfig = SegmentConfig(),
                fmt: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """The clean-up of small clusters from a stored label table, on a frame that keeps its nulls; written to ``folder``."""
    labels = read_labels(raw.sparkSession.read.format(fmt).load(f"{folder}/{tag}_labels"), tag, spec.id_col, strict=False)
    frame = prepare_types_keep_nulls(prepared_rows(raw, spec, cfg), spec.categorical, [*spec.numeric, *spec.value])
    c = clean_small_clusters(tag, labels.select(spec.id_col, "cluster"), frame, cfg, id_col=spec.id_col)
    tables = {f"{tag}_labels_pruned": c.labels, f"{tag}_cluster_profiles_clean": c.profiles, f"{tag}_value_by_cluster_clean": c.value}
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt, mode)
    write_report(c.personas, f"{folder}/{tag}_personas_clean", mode)
    return [*tables, f"{tag}_personas_clean"]


@dataclass
class ValidationRun:
    variance: DataFrame      # component, eigenvalue, explained (of learned), inertia_pct (of total), cumulative_pct
    rows: DataFrame          # id, Dim1..n
    variables: DataFrame     # variable, Dim1..n


def validation_run(df: DataFrame, cats: Sequence[str], nums: Sequence[str], n_components: int = 5,
                   id_col: str = "customer_id") -> ValidationRun:
    """Factor analysis of one mixed table with a given number of components."""
    spark = df.sparkSession
    m = fit_famd(df, cats, nums, n_components=n_components)
    m.n_keep = n = len(m.eigenvalues)
    total, rows = 0.0, []
    for j, e in enumerate(m.eigenvalues):
        total += 100 * float(e) / m.total_inertia
        rows.append((j + 1, float(e), float(m.explained[j]), 100 * float(e) / m.total_inertia, total))
    variance = spark.createDataFrame(rows, "component int, eigenvalue double, explained double, inertia_pct double, "
                                           "cumulative_pct double")
    scores = m.transform(df, [id_col]).toDF(id_col, *[f"Dim{j}" for j in range(1, n + 1)])
    return ValidationRun(variance, scores, wide_components(m.coordinates_table(spark), "variable", "squared", n, "Dim"))
