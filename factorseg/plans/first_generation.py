"""The first-generation density pipeline: encoded matrix, 2-D projection, density clusters, summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from factorseg.functions import columns as C
from factorseg.operators.density import density_clusters
from factorseg.operators.encode import flag_fill, one_hot_drop_first, pca_projection, zscore
from factorseg.operators.lineage import cut_lineage
from factorseg.operators.profile import group_numeric_means, group_value_shares
from factorseg.operators.quality import coverage_filter
from factorseg.plans.cleaning import flag_filter
from factorseg.sources.tables import drop_present, present

# Columns this pipeline drops, encodes and scales.
DROPPED = (
    "gross_ltv", "net_ltv", "avg_order_value", "total_cogs", "shipping_collected", "shipping_spend",
    "refund_amt", "first_order_date", "last_order_date", "refund_ratio", "refund_count", "quiz_taker",
    "recent_abx_flag", "email_key", "quiz_date", "ancestor_discount_code", "affiliate_segment",
    "in_third_trimester_flag", "stress_physical_flag", "sx_brain_fog",
)
ENCODED = ("first_sku", "quiz_result", "acquisition_code_group", "bm_pattern", "gi_symptom_cat", "primary_goal")
SCALED = ("symptom_count", "high_stress", "order_count", "days_since_last_order")


@dataclass(frozen=True)
class EncodingSpec:
    id_col: str = "customer_id"
    flag_col: str = "quiz_taker"
    sentinels: dict = field(default_factory=lambda: {"primary_goal": "-", "bm_pattern": "unspecified"})
    name_col: str = "quiz_result"
    name_map: dict = field(default_factory=dict)
    code_col: str = "ancestor_discount_code"
    codes: tuple = ()
    drop: tuple = DROPPED
    encode: tuple = ENCODED
    scale: tuple = SCALED
    coverage: float = 0.80


def prepare_rows(raw: DataFrame, spec: EncodingSpec) -> DataFrame:
    """Flagged rows, names mapped, codes grouped, listed and thin columns dropped."""
    df = flag_filter(raw, spec.flag_col)
    df = df.withColumns({c: C.sentinel_replace(c, v) for c, v in spec.sentinels.items() if c in df.columns})
    df = df.withColumns({
        "acquisition_code_group": C.code_group_exact(C.optional_column(df, spec.code_col), spec.codes),
        spec.name_col: C.replace_map(spec.name_col, spec.name_map)})
    return coverage_filter(drop_present(df, spec.drop), spec.coverage, strict=True)


def encode_rows(rows: DataFrame, spec: EncodingSpec) -> DataFrame:
    """The id and the encoded matrix: one-hot levels, filled flags, z-scored numerics."""
    df = one_hot_drop_first(rows, present(rows, spec.encode))
    return zscore(flag_fill(df), present(df, spec.scale))


def matrix_columns(encoded: DataFrame, id_col: str) -> list[str]:
    return [f.name for f in encoded.schema if f.name != id_col and isinstance(f.dataType, T.NumericType)]


@dataclass
class DensityRun:
    projection: DataFrame    # id, pc1, pc2
    clusters: DataFrame      # id, cluster
    rows: DataFrame          # prepared rows with their cluster


def density_run(raw: DataFrame, spec: EncodingSpec, eps: float, min_samples: int,
                min_cluster_size: int = 60) -> DensityRun:
    """Encode, project linearly to two dimensions, cluster by density, attach the clusters.

    Rows and projection are written once, so the many small jobs after them plan and read those tables, not where they came from.
    """
    rows = cut_lineage(prepare_rows(raw, spec))
    encoded = encode_rows(rows, spec)
    projection = cut_lineage(pca_projection(encoded, spec.id_col, matrix_columns(encoded, spec.id_col)))
    clusters = density_clusters(projection, "pc1", "pc2", eps, min_samples, min_cluster_size, spec.id_col)
    return DensityRun(projection, clusters, rows.join(clusters, spec.id_col))


def density_summary(run: DensityRun, spec: EncodingSpec) -> tuple[DataFrame, DataFrame]:
    """Numeric means per cluster, and value shares of the categoricals per cluster."""
    cats = present(run.rows, spec.encode)
    nums = [f.name for f in run.rows.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in (spec.id_col, "cluster")]
    return group_numeric_means(run.rows, "cluster", nums), group_value_shares(run.rows, "cluster", cats)


def density_summary_lines(run: DensityRun, spec: EncodingSpec) -> DataFrame:
    """(line_no, line): the summary as text, a sort key keeping sections together."""
    means, shares = density_summary(run, spec)
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.round(F.col(c), 6).cast("string"), F.lit("nan")))
             for c in means.columns if c != "cluster"]
    top = means.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("variable"), "cluster",
                                F.lit(0.0).alias("order"), F.lit("").alias("level")).alias("line_no"),
                       F.concat(F.lit("cluster "), F.col("cluster").cast("string"), F.lit(": "),
                                F.concat_ws(", ", *cells)).alias("line"))
    rest = shares.select(F.struct(F.lit(1).alias("part"), "variable", "cluster",
                                  (-F.col("share")).alias("order"), "level").alias("line_no"),
                         F.concat(F.upper("variable"), F.lit(" cluster "), F.col("cluster").cast("string"),
                                  F.lit(" "), "level", F.lit(": "), F.round("share", 6).cast("string")).alias("line"))
    return top.unionByName(rest)
