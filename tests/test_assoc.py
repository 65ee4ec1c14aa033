import numpy as np
import pytest

from factorseg.operators import assoc
from factorseg.operators.agreement import adjusted_rand, merge_small_clusters
from factorseg.operators.joins import size_outer_join


@pytest.fixture(scope="module")
def two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    return spark.createDataFrame(rows, "p string, q string")


def test_chi_squared(two_by_two):
    plain = assoc.phi_squared(two_by_two, ["p", "q"], "none").first()
    yates = assoc.phi_squared(two_by_two, ["p", "q"]).first()
    assert plain["chi2"] == pytest.approx(0.793651, abs=1e-6) and plain["phi2"] == pytest.approx(0.00793651, abs=1e-8)
    assert yates["chi2"] == pytest.approx(0.446429, abs=1e-6) and yates["dof"] == 1


def test_chi_squared_with_empty_cells(spark):
    df = spark.createDataFrame([("a", "x", "1")] * 3 + [("b", "y", "1")] * 2, "p string, q string, r string")
    got = {(r["var_a"], r["var_b"]): r["chi2"] for r in assoc.phi_squared(df, ["p", "q", "r"]).collect()}
    # all four cells deviate by 1.2; Yates leaves 0.7
    assert got["p", "q"] == pytest.approx(0.49 * (1 / 1.8 + 2 / 1.2 + 1 / 0.8))
    assert got["p", "r"] == 0.0


def test_eta_squared_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 5.0, 5.0), (None, 9.0, 5.0), ("b", None, 5.0)],
                               "g string, x double, flat double").selectExpr("*", "'k' AS same")
    got = {(r["num_var"], r["cat_var"]): r["eta2"] for r in assoc.eta_squared(df, ["x", "flat"], ["g", "same"]).collect()}
    assert got["x", "g"] == pytest.approx(6 / 8)  # means 2, 5 around 3
    assert got["flat", "g"] == 0.0 and got["x", "same"] == 0.0


def test_many_pairs_span_several_aggregates(spark, monkeypatch):
    monkeypatch.setattr(assoc, "PAIRS_PER_JOB", 4)
    x = np.random.default_rng(0).normal(size=(60, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"v{i}" for i in range(5)])
    m = {(r["row_var"], r["col_var"]): r["r"] for r in assoc.correlation_matrix(df, df.columns).collect()}
    want = np.corrcoef(x.T)
    assert len(m) == 25 and all(m[f"v{i}", f"v{j}"] == pytest.approx(want[i, j]) for i in range(5) for j in range(5))
    assert assoc.top_correlated_pair(assoc.correlation_matrix(df, df.columns)).first()["r"] == pytest.approx(
        max((want[i, j] for i in range(5) for j in range(5) if i != j), key=abs))


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 5, 1), (1, 1, 3, 1), (1, 2, 3, 1)], "a int, b int, c int, d int")
    ari = lambda x, y: adjusted_rand(df, x, y).first()["ari"]
    assert ari("a", "b") == pytest.approx(4 / 7) and ari("b", "a") == pytest.approx(4 / 7)
    assert ari("a", "c") == 1.0 and ari("d", "d") == 1.0 and ari("a", "d") == 0.0


def test_small_clusters(spark):
    rows = [(i, 0 if i < 95 else 1 if i < 99 else 2) for i in range(100)]
    got = merge_small_clusters(spark.createDataFrame(rows, "customer_id int, cluster int"), 0.05)
    counts = {(r["cluster"], r["cluster_final"]): r["count"] for r in got.groupBy("cluster", "cluster_final").count().collect()}
    assert counts == {(0, 0): 95, (1, -1): 4, (2, -1): 1}
    tiny = merge_small_clusters(spark.createDataFrame(rows[:3], "customer_id int, cluster int"), 0.05)
    assert tiny.filter("cluster_final = -1").count() == 0


def test_size_outer_join(spark):
    size = lambda d: spark.createDataFrame(list(d.items()), "cluster int, n_customers long")
    got = {r["cluster"]: r["delta"] for r in size_outer_join(size({0: 3, 1: 2}), size({0: 5})).collect()}
    assert got == {0: 2, 1: None}
