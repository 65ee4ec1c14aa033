"""From the raw customer table to the modelling frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorseg.config import CleaningSpec, SegmentConfig
from factorseg.functions import columns as C
from factorseg.operators.quality import coverage_report
from factorseg.sources.tables import drop_present, present, require_columns


def derive_features(df: DataFrame, spec: CleaningSpec) -> DataFrame:
    """Adds the derived columns; input columns that are absent count as null."""
    require_columns(df, [spec.id_col])
    df = df.withColumns({c: C.sentinel_replace(C.optional_column(df, c).cast("string"), v)
                         for c, v in spec.sentinels.items()})
    name = C.optional_column(df, spec.name_col).cast("string")
    tokens = C.optional_column(df, spec.token_col).cast("string")
    code = C.optional_column(df, spec.code_col).cast("string")
    gender = C.fallback_category(df, spec.gender_col, spec.gender_flag_col)
    df = df.withColumns({
        "quiz_bucket": C.bucket_lookup(name, spec.name_map, spec.name_to_bucket),
        "first_sku_buckets": C.token_buckets(tokens, spec.token_to_bucket),
        "acquisition_code_group": C.code_group(code, spec.codes),
        "gender_cat": gender,
        spec.name_col: C.normalize_map(name, spec.name_map),
    })
    return df.withColumns({
        "first_sku_bucket": C.collapse_buckets("first_sku_buckets"),
        "quiz_reco_match": C.bucket_match("quiz_bucket", "first_sku_buckets"),
    })


def flag_filter(df: DataFrame, column: str, value: str = "yes") -> DataFrame:
    """Rows whose flag equals ``value`` in any case; no trimming, nulls out."""
    require_columns(df, [column])
    return df.filter(F.lower(F.col(column).cast("string")) == value)


def group_filter(df: DataFrame, column: str = "acquisition_code_group") -> DataFrame:
    return df.filter(F.col(column) != "none")


def prepare_types(df: DataFrame, cats, nums) -> DataFrame:
    """Categoricals as text with nulls as ``missing``, numerics as double with nulls as 0."""
    return df.withColumns({**{c: C.category_filled(c) for c in present(df, cats)},
                           **{c: C.number_filled(df, c) for c in present(df, nums)}})


def prepare_types_keep_nulls(df: DataFrame, cats, nums) -> DataFrame:
    """The clean-up variant: numerics keep their nulls."""
    return df.withColumns({**{c: C.category_filled(c) for c in present(df, cats)},
                           **{c: C.number(df, c) for c in present(df, nums)}})


def prepared_rows(raw: DataFrame, spec: CleaningSpec, cfg: SegmentConfig) -> DataFrame:
    """Flagged rows with derived columns, leakage columns gone. The filter runs before the derivations."""
    df = derive_features(flag_filter(raw, spec.flag_col, spec.flag_value), spec)
    if cfg.group_only:
        df = group_filter(df)
    return drop_present(df, spec.drop)


def modeling_frame(raw: DataFrame, spec: CleaningSpec = CleaningSpec(),
                   cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """id, categoricals, numerics and the value columns that have enough coverage.

    Coverage is measured on the columns that can be kept, so the others are never read.
    """
    df = prepared_rows(raw, spec, cfg)
    base = [spec.id_col, *spec.categorical, *spec.numeric]
    wanted = [c for c in (*base, *spec.value) if c in df.columns]
    report = coverage_report(df.select(*wanted), cfg.coverage)
    covered = {r["column"] for r in report.filter("kept").collect()}
    absent = [c for c in base if c not in covered]
    if absent:
        raise ValueError(f"columns absent or below coverage {cfg.coverage}: {absent}")
    keep = base + [c for c in spec.value if c in covered]
    return prepare_types(df, spec.categorical, (*spec.numeric, *spec.value)).select(*keep)
