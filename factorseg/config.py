"""Settings of the segmentation pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Column roles, thresholds and search ranges of the analysis.
BASE_CATEGORICAL = (
    "quiz_result", "acquisition_code_group", "bm_pattern", "gi_symptom_cat",
    "primary_goal", "gender_cat", "first_sku_bucket",
)
BASE_NUMERIC = (
    "order_count", "days_since_last_order", "symptom_count", "gut_issue_score",
    "high_stress", "refund_count", "quiz_reco_match",
)
VALUE_COLUMNS = ("net_ltv", "avg_order_value", "gross_ltv")
PROFILE_CATEGORICAL = (
    "quiz_result", "bm_pattern", "gi_symptom_cat", "acquisition_code_group",
    "gender_cat", "first_sku_bucket",
)
PROFILE_NUMERIC = BASE_NUMERIC + VALUE_COLUMNS
LEAKAGE_COLUMNS = (
    "email_key", "quiz_date", "first_order_date", "last_order_date",
    "ancestor_discount_code", "quiz_taker", "first_sku", "first_sku_buckets",
    "total_cogs", "shipping_collected", "shippingspend", "refund_amt", "refund_ratio",
    "recent_abx_flag", "affiliate_segment",
)


@dataclass(frozen=True)
class CleaningSpec:
    """Which input columns play which role, and the caller's lookup tables.

    Lookups are data, not code: name variants, product codes and promotion codes
    come from the caller.
    """

    id_col: str = "customer_id"
    flag_col: str = "quiz_taker"
    flag_value: str = "yes"
    sentinels: dict = field(default_factory=lambda: {"primary_goal": "-", "bm_pattern": "unspecified"})
    name_col: str = "quiz_result"
    name_map: dict = field(default_factory=dict)
    name_to_bucket: dict = field(default_factory=dict)
    token_col: str = "first_sku"
    token_to_bucket: dict = field(default_factory=dict)
    code_col: str = "ancestor_discount_code"
    codes: tuple = ()
    gender_col: str = "gender"
    gender_flag_col: str = "is_male"
    categorical: tuple = BASE_CATEGORICAL
    numeric: tuple = BASE_NUMERIC
    value: tuple = VALUE_COLUMNS
    drop: tuple = LEAKAGE_COLUMNS


@dataclass(frozen=True)
class SegmentConfig:
    seed: int = 42
    stability_seed: int = 123
    group_only: bool = False
    coverage: float = 0.60
    dominance: float = 0.995
    explained_target: float = 0.85
    max_components: int = 20
    prune_fraction: float = 0.15
    min_contribution_pct: float = 0.40
    k_min: int = 2
    k_max: int = 10
    search_starts: int = 30
    final_starts: int = 50
    force_k_a: int | None = None
    force_k_b: int | None = None
    silhouette_metric: str = "squared_euclidean"   # linear; "euclidean" compares all pairs
    small_cluster_pct: float = 0.05
    profile_categorical: tuple = PROFILE_CATEGORICAL
    profile_numeric: tuple = PROFILE_NUMERIC
    match_col: str | None = "quiz_reco_match"
    promo_col: str | None = "acquisition_code_group"

    @property
    def k_range(self) -> range:
        return range(self.k_min, self.k_max + 1)

    def with_(self, **changes) -> "SegmentConfig":
        return replace(self, **changes)
