"""Named queries: each runs one operator over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.config import SegmentConfig
from factorseg.functions import columns as C
from factorseg.operators.dictionary import token_buckets_from
from factorseg.operators import agreement, assoc, density, encode, famd, famd_wide, heavy_hitters, joins, kmeans, profile, quality, silhouette
from factorseg.plans import cleaning, first_generation, outputs, report, segmentation, stability
from factorseg.sources import customers as cust
from factorseg.sources.customers import customer_frame, parquet_tables, raw_customers, sample_spec
from factorseg.sources.tables import select_positions

CATS = ["segment", "region", "first_priority", "first_status", "first_sku"]
NUMS = ["order_count", "days_since_last_order", "acctbal", "refund_count", "net_ltv", "avg_order_value", "gross_ltv"]
CFG = SegmentConfig()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _customers(spark: SparkSession, folder: str, cached: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """``cached`` for operators that read the frame several times; only ``columns``, if given, are carried and held."""
    df = customer_frame(parquet_tables(spark, folder))
    df = df.select(*columns) if columns else df
    return df.persist() if cached else df


def _filled(df: DataFrame) -> DataFrame:
    return cleaning.prepare_types(df, CATS, NUMS)


def _raw(spark: SparkSession, folder: str, cached: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    df = raw_customers(parquet_tables(spark, folder))
    df = df.select(*columns) if columns else df
    return df.persist() if cached else df


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _tidy(df: DataFrame) -> DataFrame:
    """Money sums without the last-digit noise of floating-point addition order."""
    return _rounded(df, 6, *[c for c in ("net_ltv", "avg_order_value", "gross_ltv", "gut_issue_score") if c in df.columns])


# ---- scans and projections ---------------------------------------------------

@query
def typed_projection(spark, folder):
    c = parquet_tables(spark, folder)("customer")
    text = c.select(F.col("c_custkey").alias("customer_id"), "c_mktsegment",
                    F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("t"))
    return text.select("customer_id", C.number_filled(text, "t").alias("acctbal"), C.to_number("t").alias("acctbal_kept"),
                       C.number_filled(text, "c_mktsegment").alias("bad"), C.category_filled("c_mktsegment").alias("segment"))


@query
def positional_select(spark, folder):
    return select_positions(parquet_tables(spark, folder)("lineitem"), [0, 3, 4, 8])


@query
def sentinel_replace(spark, folder):
    o = parquet_tables(spark, folder)("orders")
    return o.select("o_orderkey", C.sentinel_replace("o_orderpriority", "5-LOW").alias("priority"),
                    C.sentinel_replace("o_orderstatus", "P").alias("status"))


@query
def normalize_map(spark, folder):
    c = parquet_tables(spark, folder)("customer")
    name = F.concat(F.lit("  "), F.nullif("c_mktsegment", F.lit("AUTOMOBILE")), F.lit(" "))
    return c.select(F.col("c_custkey").alias("customer_id"), C.normalize_map(name, cust.SEGMENT_NAMES).alias("name"),
                    C.replace_map("c_mktsegment", cust.SEGMENT_NAMES).alias("name_exact"))


@query
def bucket_lookup(spark, folder):
    c = parquet_tables(spark, folder)("customer")
    return c.select(F.col("c_custkey").alias("customer_id"),
                    C.bucket_lookup("c_mktsegment", cust.SEGMENT_NAMES, cust.SEGMENT_BUCKETS).alias("bucket"))


@query
def token_buckets(spark, folder):
    df = _customers(spark, folder)
    return df.select("customer_id", "first_sku", C.token_buckets("first_sku", cust.TYPE_BUCKETS).alias("b")).select(
        "customer_id", F.concat_ws("|", "b").alias("buckets"), C.collapse_buckets("b").alias("bucket"))


@query
def token_buckets_table(spark, folder):
    """Brands of each order's parts; the dictionary is the whole part table."""
    t = parquet_tables(spark, folder)
    codes = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ", ")
    orders = t("lineitem").groupBy("l_orderkey").agg(codes.alias("codes"))
    table = t("part").select(F.col("p_partkey").cast("string").alias("code"), "p_brand")
    return token_buckets_from(orders, "codes", table, "code", "p_brand", "brands").select(
        "l_orderkey", F.concat_ws("|", "brands").alias("brands"), F.size("brands").alias("n_brands"))


@query
def one_hot_sparse(spark, folder):
    """The one-hot matrix of all orders, one column a customer too, as the numbers of the ones in each row."""
    o = parquet_tables(spark, folder)("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    rows, _ = encode.one_hot_sparse(o, ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return rows.select("o_orderkey", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("ones"))


@query
def sparse_cross_products(spark, folder):
    """Cross products of that matrix: how often two levels meet."""
    o = parquet_tables(spark, folder)("orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    return encode.sparse_cross_products(encode.one_hot_sparse(o, ["o_orderstatus", "o_orderpriority", "o_custkey"])[0])


@query
def bucket_match(spark, folder):
    df = _customers(spark, folder)
    bucket = C.bucket_lookup("segment", cust.SEGMENT_NAMES, cust.SEGMENT_BUCKETS)
    return df.select("customer_id", C.bucket_match(bucket, C.token_buckets("first_sku", cust.TYPE_BUCKETS)).alias("match"))


@query
def code_group(spark, folder):
    o = parquet_tables(spark, folder)("orders")
    code = F.nullif("o_orderpriority", F.lit("1-URGENT"))
    return o.select("o_orderkey", C.code_group(code, cust.PRIORITY_CODES).alias("code_any_case"),
                    C.code_group_exact(code, cust.PRIORITY_CODES).alias("code_exact"))


@query
def fallback_category(spark, folder):
    raw = _raw(spark, folder)
    return raw.select("customer_id", C.fallback_category(raw, "gender", "is_male").alias("gender_cat"))


@query
def slugify(spark, folder):
    p = parquet_tables(spark, folder)("part")
    return p.select("p_partkey", C.slugify(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"))


@query
def share_labels(spark, folder):
    counts = quality.value_shares(parquet_tables(spark, folder)("orders"), "o_orderpriority")
    return counts.select(C.share_label("value", "share").alias("label"))


@query
def ordinal_codes(spark, folder):
    df = _customers(spark, folder, cached=True, columns=("customer_id", "first_sku"))
    return encode.ordinal_codes(df, "first_sku", "code").select("customer_id", "code")


@query
def one_hot_drop_first(spark, folder):
    df = _customers(spark, folder, cached=True, columns=("customer_id", "region", "first_status"))
    return encode.one_hot_drop_first(df, ["region", "first_status"])


@query
def zscore_pop(spark, folder):
    df = _customers(spark, folder, cached=True, columns=("customer_id", "acctbal", "order_count"))
    return _rounded(encode.zscore(df, ["acctbal", "order_count"], ddof=0), 6, "acctbal", "order_count")


@query
def zscore_sample(spark, folder):
    df = _customers(spark, folder, cached=True, columns=("customer_id", "acctbal", "net_ltv"))
    return _rounded(encode.zscore(df, ["acctbal", "net_ltv"], ddof=1), 6, "acctbal", "net_ltv")


@query
def flag_fill(spark, folder):
    df = _customers(spark, folder).select(
        "customer_id", F.when(F.col("acctbal") > 2500, 1.0).alias("is_rich"),
        F.when(F.col("refund_count") > 10, 1.0).alias("refund_flag"),
        F.when(F.col("region") != "ASIA", 0.0).alias("sx_far"), F.col("order_count").alias("flag_other"))
    return encode.flag_fill(df)


@query
def row_index(spark, folder):
    o = parquet_tables(spark, folder)("orders").select("o_orderkey", "o_orderdate")
    return encode.with_row_index(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "customer_index")


# ---- filters -----------------------------------------------------------------

@query
def row_index_by_file(spark, folder):
    """Row numbers of orders in file order; no column is sorted."""
    return encode.with_file_row_index(parquet_tables(spark, folder)("orders")).select("o_orderkey", "customer_index")


@query
def flag_filter(spark, folder):
    return cleaning.flag_filter(_raw(spark, folder), "quiz_taker").select("customer_id", "quiz_taker")


@query
def group_filter(spark, folder):
    raw = cleaning.derive_features(_raw(spark, folder), sample_spec())
    return cleaning.group_filter(raw).select("customer_id", "acquisition_code_group")


def _holes(df: DataFrame) -> DataFrame:
    return df.select("customer_id", F.nullif("first_priority", F.lit("1-URGENT")).alias("priority"),
                     F.nullif("segment", F.lit("BUILDING")).alias("segment"),
                     F.when(F.col("acctbal") > 5000, F.col("acctbal")).alias("acctbal"), "first_sku", "net_ltv")


@query
def coverage_report(spark, folder):
    return quality.coverage_report(_holes(_customers(spark, folder)), 0.60)


@query
def coverage_strict(spark, folder):
    return quality.coverage_report(_holes(_customers(spark, folder)), 0.80, strict=True)


@query
def dominance_report(spark, folder):
    df = _customers(spark, folder, cached=True).select(
        "segment", "first_sku", F.when(F.col("acctbal") < -980, "b").otherwise("a").alias("dominated"),
        F.lit("one").alias("constant_text"), "acctbal", "net_ltv", F.lit(1.0).alias("constant_number"))
    out = quality.dominance_report(df, ["segment", "first_sku", "dominated", "constant_text"],
                                   ["acctbal", "net_ltv", "constant_number"])
    return _rounded(out, 4, "metric").withColumn("n_levels", F.col("n_levels").cast("double"))


# ---- joins -------------------------------------------------------------------

@query
def labels_left_join(spark, folder):
    t = parquet_tables(spark, folder)
    labels = t("orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey")
    feats = t("customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    return joins.join_labels(labels, feats).select("customer_id", "o_orderkey", "c_mktsegment")


@query
def labels_inner_join(spark, folder):
    t = parquet_tables(spark, folder)
    labels = t("orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey")
    feats = t("customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    return joins.join_labels(labels, feats, how="inner").select("customer_id", "o_orderkey", "c_mktsegment")


@query
def lookup_join(spark, folder):
    t = parquet_tables(spark, folder)
    return joins.lookup_join(t("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey",
                             t("nation").filter(F.col("n_regionkey") > 0), "n_nationkey", "n_name", "nation")


@query
def size_outer_join(spark, folder):
    o = parquet_tables(spark, folder)("orders")
    a = profile.cluster_sizes(o.select(F.col("o_orderpriority").alias("cluster")))
    b = profile.cluster_sizes(o.filter(F.col("o_orderpriority") != "5-LOW").filter(F.col("o_totalprice") > 200000)
                              .select(F.col("o_orderpriority").alias("cluster")))
    out = joins.size_outer_join(a, b)
    return out.select("cluster", *[F.col(c).cast("double").alias(c) for c in ("orig_size", "new_size", "delta")])


# ---- counts, profiles --------------------------------------------------------

@query
def value_counts_share(spark, folder):
    return _rounded(quality.value_shares(parquet_tables(spark, folder)("lineitem"), "l_quantity"), 8, "share")


@query
def column_profile_top10(spark, folder):
    return heavy_hitters.frequent_values(parquet_tables(spark, folder)("orders"), 10)


@query
def column_profile_lineitem(spark, folder):
    return heavy_hitters.frequent_values(parquet_tables(spark, folder)("lineitem"), 10)


@query
def cluster_sizes(spark, folder):
    return profile.cluster_sizes(parquet_tables(spark, folder)("lineitem"), "l_returnflag")


@query
def profile_by_group(spark, folder):
    df = _tidy(_customers(spark, folder)).persist()
    return profile.cluster_profile(df, "segment", ["region", "first_status", "first_sku"], NUMS,
                                   promo_col="first_priority").orderBy("cluster")


def _holed_profile(df: DataFrame) -> DataFrame:
    return df.withColumns({"acctbal": F.when(F.col("acctbal") > 0, F.col("acctbal")),
                           "refund_count": F.when(F.col("refund_count") != 3, F.col("refund_count"))})


@query
def profile_skip_null(spark, folder):
    df = _holed_profile(_customers(spark, folder, cached=True, columns=("region", "segment", "acctbal", "refund_count")))
    return profile.cluster_profile(df, "region", ["segment"], ["acctbal", "refund_count"], null_as_zero=False)


@query
def profile_null_as_zero(spark, folder):
    df = _holed_profile(_customers(spark, folder, cached=True, columns=("region", "segment", "acctbal", "refund_count")))
    return profile.cluster_profile(df, "region", ["segment"], ["acctbal", "refund_count"])


@query
def group_medians(spark, folder):
    """Exact medians of order lines by ship flag, over every line."""
    from factorseg.operators.medians import group_medians as run
    item = parquet_tables(spark, folder)("lineitem")
    return run(item, ["l_returnflag"], {c: F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount")})


@query
def group_numeric_means(spark, folder):
    df = _customers(spark, folder)
    # the small addend keeps means that end in a half from falling to either side by the order of addition
    means = profile.group_numeric_means(df, "segment", NUMS)
    return _rounded(means.withColumns({f"{c}_mean": F.col(f"{c}_mean") + 1e-7 for c in NUMS}), 4, *[f"{c}_mean" for c in NUMS])


@query
def group_value_shares(spark, folder):
    return _rounded(profile.group_value_shares(_customers(spark, folder), "segment",
                                               ["region", "first_status", "first_sku"]), 8, "share")


@query
def promo_mix(spark, folder):
    return profile.promo_mix(_customers(spark, folder), "region", "first_sku")


# ---- association -------------------------------------------------------------

@query
def contingency(spark, folder):
    return assoc.contingency(_customers(spark, folder), "segment", "first_sku")


@query
def phi_squared(spark, folder):
    df = _customers(spark, folder).withColumn("rich", F.when(F.col("acctbal") > 2500, "y").otherwise("n")) \
        .withColumn("late", F.when(F.col("days_since_last_order") > 200, "y").otherwise("n"))
    out = assoc.phi_squared(df, ["segment", "region", "first_sku", "rich", "late"])
    return _rounded(out.drop("dof"), 6, "chi2", "phi2")


@query
def r_squared(spark, folder):
    return _rounded(assoc.r_squared(_customers(spark, folder), NUMS), 6, "r2")


@query
def eta_squared(spark, folder):
    return _rounded(assoc.eta_squared(_customers(spark, folder), NUMS, CATS), 6, "eta2")


@query
def relationship_matrix(spark, folder):
    df = _filled(_customers(spark, folder)).persist()
    out = assoc.relationship_matrix(df, ["acctbal", "order_count", "net_ltv"], ["segment", "region", "first_sku"], digits=None)
    return _rounded(out, 6, "value")


@query
def correlation_matrix(spark, folder):
    return _rounded(assoc.correlation_matrix(_filled(_customers(spark, folder)), NUMS), 6, "r")


@query
def correlation_summary(spark, folder):
    m = assoc.correlation_matrix(_filled(_customers(spark, folder)), NUMS)
    return _rounded(assoc.correlation_summary(m), 6, "min_r", "max_r", "mean_abs_r")


@query
def top_correlated_pair(spark, folder):
    m = assoc.correlation_matrix(_filled(_customers(spark, folder)), NUMS)
    return _rounded(assoc.top_correlated_pair(m), 6, "r")


# ---- component arithmetic on a table of revenue per nation --------------------

def _nation_revenue(spark, folder) -> DataFrame:
    """25 rows: (variable, amount)."""
    t = parquet_tables(spark, folder)
    return (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("amount"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("variable"), "amount", "c_nationkey"))


@query
def cumulative_share(spark, folder):
    rows = _nation_revenue(spark, folder).select((F.col("c_nationkey") + 1).alias("component"),
                                                 F.col("amount").alias("eigenvalue"))
    return _rounded(famd.variance_table(rows, 0.85), 6, "eigenvalue", "explained", "cumulative")


@query
def components_to_target(spark, folder):
    rows = _nation_revenue(spark, folder).select((F.col("c_nationkey") + 1).alias("component"),
                                                 F.col("amount").alias("eigenvalue"))
    return famd.variance_table(rows, 0.5).filter("retained").agg(F.count("*").alias("n_keep"))


@query
def contribution_prune(spark, folder):
    rows = _nation_revenue(spark, folder)
    total = rows.agg(F.sum("amount")).scalar()
    shares = rows.select("variable", (F.col("amount") * 100 / total).alias("total_contrib_pct"))
    return _rounded(famd.prune_list(shares, 0.15, 3.6), 6, "total_contrib_pct")


# ---- factor analysis ---------------------------------------------------------

def _fit(spark, folder):
    df = _customers(spark, folder, cached=True)
    return df, famd.fit_famd(df, CATS, NUMS)


@query
def famd_inertia(spark, folder):
    _, m = _fit(spark, folder)
    trace = float(m.stats.matrix.trace())
    return spark.createDataFrame([(round(trace, 6), m.stats.n)], "inertia double, n long")


@query
def famd_relationship_blocks(spark, folder):
    """R2, eta2 and phi2 read off the fit's cross-product matrix."""
    _, m = _fit(spark, folder)
    rows = [(a, b, round(v, 6)) for (a, b), v in m.relationship_blocks().items()]
    return spark.createDataFrame(rows, "row_var string, col_var string, value double")


@query
def famd_score_moments(spark, folder):
    """Per kept factor: mean 0, variance equal to its eigenvalue, uncorrelated with the next factor."""
    df, m = _fit(spark, folder)
    scores = m.transform(df)
    pairs = list(zip(m.factor_names, m.factor_names[1:] + m.factor_names[:1]))
    one = scores.agg(*[e for i, (a, b) in enumerate(pairs) for e in (
        F.avg(a).alias(f"m{i}"), (F.var_pop(a) / float(m.eigenvalues[i])).alias(f"v{i}"), F.corr(a, b).alias(f"r{i}"))])
    cells = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.round(F.abs(f"m{i}"), 6)).alias("mean_abs"),
                               F.round(f"v{i}", 6).alias("variance_ratio"), F.round(F.abs(f"r{i}"), 6).alias("r_abs"))
                      for i in range(len(pairs))])
    return one.select(F.inline(cells)).agg(F.max("mean_abs").alias("mean_abs"), F.min("variance_ratio").alias("ratio_min"),
                                           F.max("variance_ratio").alias("ratio_max"), F.max("r_abs").alias("r_abs"))


@query
def famd_spectrum(spark, folder):
    """Sum and sum of squares of all eigenvalues: trace and squared norm of the cross-product matrix."""
    _, m = _fit(spark, folder)
    every = famd.decompose(m.stats, m.variables, n_components=len(m.stats.matrix)).eigenvalues
    return spark.createDataFrame([(round(float(every.sum()), 6), round(float((every ** 2).sum()), 6))],
                                 "total double, squares double")


@query
def famd_first_factor(spark, folder):
    """Eigenvalue and variable contributions of the first factor."""
    _, m = _fit(spark, folder)
    first = m.contributions_table(spark).filter(F.col("component") == 1)
    return first.select("variable", F.round("contribution", 6).alias("contribution"),
                        F.lit(round(float(m.eigenvalues[0]), 6)).alias("eigenvalue"))


@query
def famd_first_scores(spark, folder):
    df, m = _fit(spark, folder)
    return _rounded(m.transform(df, n=1), 5, "Factor_1")


@query
def famd_first_loadings(spark, folder):
    _, m = _fit(spark, folder)
    return _rounded(m.loadings_table(spark).filter(F.col("component") == 1).drop("component"), 5, "loading")


@query
def famd_first_centroids(spark, folder):
    _, m = _fit(spark, folder)
    return _rounded(m.centroids_table(spark).filter(F.col("component") == 1).drop("component"), 5, "centroid", "share")


@query
def famd_explained(spark, folder):
    return _rounded(_fit(spark, folder)[1].explained_table(spark), 5, "eigenvalue", "explained_variance", "cumulative_variance", "inertia_pct")


@query
def famd_contributions(spark, folder):
    return _rounded(_fit(spark, folder)[1].contributions_table(spark), 5, "contribution", "total_contribution_pct")


@query
def famd_variable_coordinates(spark, folder):
    return _rounded(_fit(spark, folder)[1].coordinates_table(spark), 5, "squared", "signed")


@query
def famd_scores(spark, folder):
    """Every score as (customer_id, component, score)."""
    df, m = _fit(spark, folder)
    scores = m.transform(df, as_array="scores").select("customer_id", F.posexplode("scores").alias("component", "score"))
    return _rounded(scores.withColumn("component", F.col("component") + 1), 5, "score")


@query
def famd_many_levels(spark, folder):
    """The first axis of a price and the part it belongs to, a column with as many levels as there are parts."""
    lines = parquet_tables(spark, folder)("lineitem").select(F.col("l_partkey").cast("string").alias("l_partkey"), "l_extendedprice")
    model = famd_wide.fit_famd_wide(lines, ["l_partkey"], ["l_extendedprice"], n_components=1, tolerance=1e-18)
    out = model.weights.select("variable", "level", "share", F.col("axis")[0].alias("weight"), F.lit(float(model.eigenvalues[0])).alias("eigenvalue"))
    return _rounded(_rounded(out, 8, "share"), 6, "weight", "eigenvalue")


@query
def famd_loadings(spark, folder):
    return _rounded(_fit(spark, folder)[1].loadings_table(spark), 5, "loading")


@query
def loading_summary(spark, folder):
    return _rounded(assoc.loading_summary(_fit(spark, folder)[1].loadings_table(spark)), 5, "min_loading", "max_loading")


@query
def famd_interpretation(spark, folder):
    return _fit(spark, folder)[1].interpretation_table(spark)


@query
def feature_ranking(spark, folder):
    """Contribution ranking with the pruning decision."""
    _, m = _fit(spark, folder)
    ranking = famd.prune_list(famd.ranked_contributions(m, spark).select("variable", "total_contrib_pct"))
    return _rounded(ranking, 5, "total_contrib_pct")


@query
def famd_refit(spark, folder):
    """Explained variance of the second fit, on the variables that survive pruning."""
    _, m = _fit(spark, folder)
    keep = famd.prune_variables(m)
    return _rounded(famd.decompose(famd.restrict(m.stats, keep), keep).explained_table(spark), 5, "eigenvalue", "explained_variance", "cumulative_variance", "inertia_pct")


@query
def famd_component_counts(spark, folder):
    """The same data with 2, 5, 6 and 8 components: explained share of each."""
    _, m = _fit(spark, folder)
    parts = [famd.decompose(m.stats, m.variables, n_components=n).explained_table(spark)
             .withColumn("n_components", F.lit(n)) for n in (2, 5, 6, 8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _rounded(out, 5, "eigenvalue", "explained_variance", "cumulative_variance", "inertia_pct")


@query
def famd_relationship_table(spark, folder):
    """The relationship matrix with Yates' correction, from the fit alone."""
    df = _filled(_customers(spark, folder)).withColumn("rich", F.when(F.col("acctbal") > 2500, "y").otherwise("n")) \
        .withColumn("late", F.when(F.col("days_since_last_order") > 200, "y").otherwise("n")).persist()
    m = famd.fit_famd(df, ["segment", "rich", "late"], ["acctbal", "order_count"])
    return _rounded(m.relationship_table(spark, digits=None), 6, "value")


@query
def validation_variance(spark, folder):
    return outputs.validation_run(_customers(spark, folder, cached=True), CATS, NUMS, 5).variance


@query
def validation_variables(spark, folder):
    return outputs.validation_run(_customers(spark, folder, cached=True), CATS, NUMS, 5).variables


@query
def famd_scaling_invariance(spark, folder):
    """Largest score difference between raw and pre-standardised numerics (up to sign): 0."""
    df, m = _fit(spark, folder)
    z = encode.zscore(df, NUMS, ddof=1)
    other = famd.fit_famd(z, CATS, NUMS)
    both = m.transform(df, n=2, as_array="a").join(other.transform(z, n=2, as_array="b"), "customer_id")
    gap = F.greatest(*[F.abs(F.abs(F.col("a")[j]) - F.abs(F.col("b")[j])) for j in range(2)])
    return both.agg(F.round(F.max(gap), 6).alias("max_gap"), F.count("*").alias("n"))


@query
def category_centroids(spark, folder):
    return _rounded(_fit(spark, folder)[1].centroids_table(spark), 5, "centroid", "share")


@query
def correlation_circle(spark, folder):
    return _rounded(report.correlation_circle(_fit(spark, folder)[1], spark), 5, "dim1", "dim2")


@query
def variable_quality(spark, folder):
    return _rounded(report.variable_quality(_fit(spark, folder)[1], spark), 5, "dim1", "dim2", "contribution")


@query
def category_map(spark, folder):
    return _rounded(report.category_map(_fit(spark, folder)[1], spark), 5, "dim1", "dim2")


@query
def scree_table(spark, folder):
    return _rounded(report.scree_table(_fit(spark, folder)[1], spark), 5, "eigenvalue", "explained_variance", "inertia_pct")


@query
def individuals_map(spark, folder):
    df, m = _fit(spark, folder)
    return _rounded(report.individuals_map(m.transform(df)), 5, "dim1", "dim2")


@query
def factor_correlations(spark, folder):
    df, m = _fit(spark, folder)
    return report.factor_correlation_report(m.transform(df), "customers")[1]


# ---- clustering --------------------------------------------------------------

def _scored(spark, folder):
    df, m = _fit(spark, folder)
    return segmentation.spread_rows(m.transform(df, as_array="features"), "customer_id").persist()


@query
def kmeans_labels(spark, folder):
    scored = _scored(spark, folder)
    model = kmeans.fit_kmeans(scored, "features", [4], CFG.final_starts)[4]
    return kmeans.assign_clusters(scored, "features", model)


@query
def choose_k(spark, folder):
    """(k, silhouette): the search curve over k = 2..10."""
    _, _, curve, _ = segmentation.choose_k(_scored(spark, folder), CFG.k_range, CFG.search_starts,
                                            metric="euclidean")
    return spark.createDataFrame(curve, "k int, silhouette double")


@query
def choose_k_squared(spark, folder):
    """The search with the linear-cost silhouette."""
    _, _, curve, _ = segmentation.choose_k(_scored(spark, folder), CFG.k_range, CFG.search_starts,
                                           metric="squared_euclidean")
    return spark.createDataFrame(curve, "k int, silhouette double")


@query
def forced_k(spark, folder):
    base = _filled(_customers(spark, folder)).persist()
    r = segmentation.segment_pass("forced", base, CATS, NUMS, CFG.with_(
        profile_categorical=tuple(CATS), profile_numeric=tuple(NUMS), match_col=None, promo_col="first_priority"), force_k=3)
    return r.silhouette_curve().withColumn("final_silhouette", F.lit(r.final_silhouette))


@query
def cluster_scatter(spark, folder):
    scored = _scored(spark, folder)
    model = kmeans.fit_kmeans(scored, "features", [4], CFG.search_starts)[4]
    return report.cluster_scatter(scored.withColumn("cluster", kmeans.nearest_center("features", model)))


@query
def adjusted_rand(spark, folder):
    return _rounded(agreement.adjusted_rand(_customers(spark, folder), "segment", "region"), 8, "ari")


@query
def silhouette_exact(spark, folder):
    e = parquet_tables(spark, folder)("embeddings")
    s = silhouette.silhouette(e, "embedding", "label", "euclidean")
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


@query
def silhouette_squared(spark, folder):
    e = parquet_tables(spark, folder)("embeddings")
    s = silhouette.silhouette(e, "embedding", "label", "squared_euclidean")
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


@query
def seed_stability(spark, folder):
    scored = _scored(spark, folder)
    model = kmeans.fit_kmeans(scored, "features", [4], CFG.final_starts)[4]
    return stability.seed_stability("customers", scored, kmeans.assign_clusters(scored, "features", model),
                                    starts=CFG.final_starts).summary


@query
def stability_sizes(spark, folder):
    scored = _scored(spark, folder)
    model = kmeans.fit_kmeans(scored, "features", [4], CFG.final_starts)[4]
    return stability.seed_stability("customers", scored, kmeans.assign_clusters(scored, "features", model),
                                    starts=CFG.final_starts).sizes


def _mix_labels(spark, folder) -> DataFrame:
    """Regions, one of them cut by segment: a labeling with groups on both sides of 5 %, group number by name."""
    df = _customers(spark, folder, cached=True)
    mix = F.when(F.col("region") == "ASIA", F.concat_ws("/", "region", "segment")).otherwise(F.col("region"))
    return encode.ordinal_codes(df.withColumn("mix", mix), "mix", "cluster").drop("mix")


@query
def small_group_merge(spark, folder):
    return agreement.merge_small_clusters(_mix_labels(spark, folder).select("customer_id", "cluster"), 0.05)


@query
def unclustered_summary(spark, folder):
    merged = agreement.merge_small_clusters(_mix_labels(spark, folder).select("customer_id", "cluster"), 0.05)
    return _rounded(profile.unclustered_summary(merged), 6, "pct")


@query
def mean_value_by_group(spark, folder):
    merged = agreement.merge_small_clusters(_mix_labels(spark, folder), 0.05)
    means = profile.mean_value_by_group(merged, "cluster_final", "net_ltv").withColumn("net_ltv_mean", F.col("net_ltv_mean") + 1e-7)
    return _rounded(means, 4, "net_ltv_mean")


@query
def clean_profiles(spark, folder):
    """Profiles without the small groups."""
    df = _tidy(_mix_labels(spark, folder))
    cats = ("segment", "region", "first_status", "first_sku")
    cfg = SegmentConfig(profile_categorical=cats, profile_numeric=tuple(NUMS), match_col=None, promo_col="first_priority")
    labels, feats = df.select("customer_id", "cluster"), df.select("customer_id", *cats, *NUMS, "first_priority")
    return stability.clean_small_clusters("customers", labels, feats, cfg).profiles


# ---- pipelines and reports ---------------------------------------------------

@query
def modeling_frame(spark, folder):
    return _tidy(cleaning.modeling_frame(_raw(spark, folder, cached=True), sample_spec()))


def _by_status(spark, folder) -> DataFrame:
    """The modelling frame with the first order's status as cluster number."""
    base = _tidy(cleaning.modeling_frame(_raw(spark, folder, cached=True), sample_spec()))
    n = F.when(F.col("bm_pattern") == "F", 0).when(F.col("bm_pattern") == "O", 1).otherwise(2)
    return base.withColumn("cluster", n).persist()


def _status_profile(spark, folder) -> DataFrame:
    cfg = SegmentConfig()
    return profile.cluster_profile(_by_status(spark, folder), "cluster", cfg.profile_categorical, cfg.profile_numeric,
                                   cfg.match_col, cfg.promo_col)


@query
def wide_profile(spark, folder):
    return _status_profile(spark, folder)


@query
def value_summary(spark, folder):
    return report.value_summary(_status_profile(spark, folder), "by_status")


@query
def value_comparison(spark, folder):
    p = _status_profile(spark, folder).persist()
    return report.value_comparison({"full": p, "no_orders": p.drop("order_count_mean")})


@query
def value_bars(spark, folder):
    return report.value_bars(report.value_comparison({"by_status": _status_profile(spark, folder)}))


@query
def persona_text(spark, folder):
    return report.persona_lines(_status_profile(spark, folder), "by_status").select(
        F.col("line_no").alias("cluster"), F.col("line").alias("persona"))


@query
def encoded_matrix(spark, folder):
    # only columns this query encodes are carried; ``is_large``, from the net value, is covered too thinly and must go
    keep = ("customer_id", "quiz_taker", "quiz_result", "ancestor_discount_code", "order_count",
            "days_since_last_order", "symptom_count", "high_stress")
    raw = _raw(spark, folder, cached=True, columns=(*keep, "net_ltv")).withColumn("is_large", F.when(F.col("net_ltv") > 2e6, 1))
    spec = first_generation.EncodingSpec(name_map={" FURNITURE ": "Furniture", " HOUSEHOLD ": "Household"},
                                         codes=cust.PRIORITY_CODES, encode=("quiz_result", "acquisition_code_group"),
                                         scale=("order_count", "days_since_last_order", "symptom_count"))
    out = first_generation.encode_rows(first_generation.prepare_rows(raw.select(*keep, "is_large"), spec), spec)
    out = _rounded(out, 6, "order_count", "days_since_last_order", "symptom_count")
    return out.toDF(*[c.strip().replace(" ", "").replace("-", "_").lower() for c in out.columns])


def _density_spec():
    return first_generation.EncodingSpec(codes=cust.PRIORITY_CODES)


@query
def pca_projection(spark, folder):
    spec = _density_spec()
    rows = first_generation.prepare_rows(_raw(spark, folder, cached=True), spec).persist()
    encoded = first_generation.encode_rows(rows, spec)
    return encode.pca_projection(encoded, "customer_id", first_generation.matrix_columns(encoded, "customer_id"))


@query
def density_clusters(spark, folder):
    """Density clusters of all flagged customers in the 2-D projection."""
    run = first_generation.density_run(_raw(spark, folder, cached=True), _density_spec(), eps=0.25, min_samples=10)
    return run.clusters


@query
def density_summary(spark, folder):
    spec = _density_spec()
    run = first_generation.density_run(_raw(spark, folder, cached=True), spec, eps=0.25, min_samples=10)
    return first_generation.density_summary(run, spec)[1]


@query
def segmentation_two_pass(spark, folder):
    """Both passes on the modelling frame; the value columns of every cluster."""
    spec = sample_spec()
    base = cleaning.modeling_frame(_raw(spark, folder, cached=True), spec)
    results = segmentation.two_pass(base, spec.categorical, spec.numeric, spec.value, CFG)
    return report.value_comparison({tag: r.profiles for tag, r in results.items()})


@query
def run_summary(spark, folder):
    """The two-pass run summary, searched with the linear-cost silhouette."""
    spec = sample_spec()
    cfg = CFG.with_(silhouette_metric="squared_euclidean")
    base = cleaning.modeling_frame(_raw(spark, folder, cached=True), spec, cfg).persist()
    results = segmentation.two_pass(base, spec.categorical, spec.numeric, spec.value, cfg)
    return report.summary_table(spark, report.run_summary(results, base.count(), len(base.columns) - 1, cfg))
