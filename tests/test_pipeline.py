import pytest
from pyspark.sql import functions as F

from factorseg.config import CleaningSpec, SegmentConfig
from factorseg.operators.agreement import adjusted_rand
from factorseg.plans import cleaning, first_generation, outputs, report, segmentation, stability
from factorseg.sources.customers import PRIORITY_CODES, parquet_tables, raw_customers, sample_spec

CFG = SegmentConfig(search_starts=2, final_starts=3, k_max=4)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return raw_customers(parquet_tables(spark, sf_dir)).persist()


@pytest.fixture(scope="module")
def base(raw):
    return cleaning.modeling_frame(raw, sample_spec(), CFG).persist()


@pytest.fixture(scope="module")
def results(base):
    spec = sample_spec()
    return segmentation.two_pass(base, spec.categorical, spec.numeric, spec.value, CFG)


def test_flag_filter(spark):
    df = spark.createDataFrame([("YES",), ("yes ",), ("no",), (None,)], "quiz_taker string")
    assert [r[0] for r in cleaning.flag_filter(df, "quiz_taker").collect()] == ["YES"]
    with pytest.raises(ValueError, match="other"):
        cleaning.flag_filter(df, "other")


def test_modeling_frame(raw, base):
    spec = sample_spec()
    assert base.columns == [spec.id_col, *spec.categorical, *spec.numeric, *spec.value]
    assert base.count() == raw.filter("quiz_taker = 'Yes'").count()
    assert base.filter(" or ".join(f"{c} is null" for c in base.columns)).count() == 0
    only = cleaning.modeling_frame(raw, spec, CFG.with_(group_only=True))
    assert only.filter("acquisition_code_group = 'none'").count() == 0 and 0 < only.count() < base.count()


def test_thin_base_column_is_named(raw):
    thin = raw.withColumn("symptom_count", F.when(F.col("symptom_count") > 8000, 1.0))
    with pytest.raises(ValueError, match="symptom_count"):
        cleaning.modeling_frame(thin, sample_spec())
    value = raw.withColumn("gross_ltv", F.when(F.col("gross_ltv") > 1e9, 1.0))
    assert "gross_ltv" not in cleaning.modeling_frame(value, sample_spec()).columns


def test_absent_optional_columns(spark):
    df = spark.createDataFrame([(1, "yes")], "customer_id long, quiz_taker string")
    row = cleaning.derive_features(df, CleaningSpec()).first()
    assert (row["acquisition_code_group"], row["gender_cat"], row["first_sku_bucket"], row["quiz_reco_match"]) == \
        ("none", "missing", "none", 0)
    assert row["quiz_result"] is None and row["first_sku_buckets"] == []


def test_two_passes(spark, base, results):
    a, b = results["A_withLTV"], results["B_noLTV"]
    assert set(b.first_fit.variables) < set(a.first_fit.variables) and "net_ltv" in a.first_fit.variables
    assert "net_ltv" not in b.first_fit.variables
    for r in results.values():
        assert r.chosen_k == max(r.curve, key=lambda kv: (kv[1], -kv[0]))[0] and r.n_keep >= 2
        assert r.labels.columns == ["customer_id", r.cluster_col] and r.labels.count() == base.count()
        assert r.profiles.agg(F.sum("n_customers")).first()[0] == base.count()
        assert len(r.scores.columns) == 1 + r.n_keep and r.silhouette_curve().count() == 3
        assert "net_ltv_mean" in r.profiles.columns and "promo_1" in r.profiles.columns
    both = report.value_comparison({t: r.profiles for t, r in results.items()})
    assert both.count() == a.chosen_k + b.chosen_k
    assert report.value_bars(both).count() == 4 * both.count()
    rows = report.run_summary(results, base.count(), len(base.columns) - 1, CFG)
    assert ("A_withLTV", "clusters", str(a.chosen_k)) in rows
    assert report.summary_table(spark, rows).count() == len(rows) < report.summary_lines(spark, rows).count()


def test_pass_alone_equals_pass_from_shared_statistics(base, results):
    spec = sample_spec()
    alone = segmentation.segment_pass("B", base, spec.categorical, spec.numeric, CFG)
    shared = results["B_noLTV"]
    assert alone.chosen_k == shared.chosen_k and alone.silhouette == pytest.approx(shared.silhouette)
    pair = alone.labels.join(shared.labels, "customer_id")
    assert adjusted_rand(pair, "cluster_B", "cluster_B_noLTV").first()["ari"] == pytest.approx(1)


def test_forced_k(base):
    spec = sample_spec()
    r = segmentation.segment_pass("F", base, spec.categorical, spec.numeric, CFG, force_k=3)
    assert r.chosen_k == 3 and all(v is None for _, v in r.curve) and -1 < r.silhouette < 1


def test_factor_correlations(results):
    matrix, summary = report.factor_correlation_report(results["A_withLTV"].scores, "A")
    row = summary.first()
    assert row["n_columns"] == results["A_withLTV"].n_keep and row["band"] == "low" and abs(row["r"]) < 1e-9
    assert matrix.count() == row["n_columns"] ** 2


def test_clean_up(base, results):
    labels = results["A_withLTV"].clustered.select("customer_id", "cluster")
    # split off a few rows as a tiny cluster
    few = [r[0] for r in labels.orderBy("customer_id").limit(2).collect()]
    labels = labels.withColumn("cluster", F.when(F.col("customer_id").isin(few), 99).otherwise(F.col("cluster")))
    c = stability.clean_small_clusters("A", labels, base, CFG)
    assert c.labels.count() == base.count() and c.labels.filter("cluster_final = -1").count() >= 2
    assert c.profiles.filter("cluster = -1 or cluster = 99").count() == 0
    last = c.personas.orderBy("line_no").collect()[-1]["line"]
    assert last.startswith("A — Unclustered (-1) — ") and last.endswith("% of sample)")
    assert c.value_bars.filter("cluster = -1").count() == 1


def test_first_generation(raw):
    spec = first_generation.EncodingSpec(codes=PRIORITY_CODES, encode=("quiz_result", "acquisition_code_group"))
    run = first_generation.density_run(raw, spec, eps=0.8, min_samples=4, min_cluster_size=5)
    means, shares = first_generation.density_summary(run, spec)
    assert run.rows.count() == run.clusters.count() == run.projection.count()
    assert means.count() == run.clusters.select("cluster").distinct().count()
    total = shares.groupBy("cluster", "variable").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9")
    assert total.count() == 0
    assert first_generation.density_summary_lines(run, spec).count() == means.count() + shares.count()


def test_outputs(spark, results, raw, tmp_path):
    names = outputs.write_run({"B_noLTV": results["B_noLTV"]}, str(tmp_path / "out"))
    r = results["B_noLTV"]
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert "B_noLTV_final_loading_matrix" in names and len(names) == 23
    assert set(read("B_noLTV_factor_correlation_matrix").columns) == {"row_var", *r.famd.factor_names}
    assert spark.read.text(str(tmp_path / "out" / "B_noLTV_factor_correlations")).count() > 3
    stored = outputs.write_stability(spark, str(tmp_path / "out"), ["B_noLTV"], CFG)
    assert stored == ["B_noLTV_stability_sizes", "B_noLTV_labels_stability", "two_pass_seed_stability_summary"]
    assert read("two_pass_seed_stability_summary").first()["n_samples"] == r.labels.count()
    cleaned = outputs.write_clean(str(tmp_path / "out"), "B_noLTV", raw, sample_spec(), CFG)
    assert read("B_noLTV_labels_pruned").count() == r.labels.count() and len(cleaned) == 4
    lines = [x["line"] for x in outputs.schema_lines(raw.select("gender", "order_count")).orderBy("line_no").collect()]
    assert lines[0] == "gender (string)" and "order_count (double)" in lines
    assert read("B_noLTV_labels").count() == r.labels.count()
    wide = read("B_noLTV_final_relationship_matrix")
    assert set(wide.columns) == {"row_var", *r.famd.variables} and wide.count() == len(r.famd.variables)
    assert len(read("B_noLTV_final_variable_contributions").columns) == r.n_keep + 2
    dropped = {x[0] for x in read("B_noLTV_pruned_features").collect()}
    assert dropped == set(r.first_fit.variables) - set(r.famd.variables)
    assert spark.read.text(str(tmp_path / "out" / "B_noLTV_personas")).count() >= r.chosen_k


def test_stability_rows_of_both_passes(results):
    runs = [stability.seed_stability(t, r.clustered.select("customer_id", "features"),
                                     r.clustered.select("customer_id", "cluster"), starts=2) for t, r in results.items()]
    assert {r["tag"] for r in stability.stability_table(runs).collect()} == set(results)


def test_validation_run(base):
    run = outputs.validation_run(base, ["quiz_result", "bm_pattern"], ["order_count", "symptom_count", "net_ltv"])
    v = run.variance.orderBy("component").collect()
    assert len(v) == 5 and v[-1]["cumulative_pct"] == pytest.approx(sum(r["inertia_pct"] for r in v))
    assert run.rows.columns == ["customer_id", *[f"Dim{j}" for j in range(1, 6)]] and run.variables.count() == 5
