import numpy as np
import pytest
from pyspark.sql import functions as F

from factorseg.operators import famd
from factorseg.operators.encode import ordinal_codes, zscore
from factorseg.plans import report
from factorseg.sources.tables import literal_table

SIX = [(1, 2.0, 4.5, 4.0, "A", "B", "C"), (2, 5.0, 4.5, 4.0, "C", "B", "C"), (3, 3.0, 1.0, 2.0, "B", "B", "B"),
       (4, 4.0, 1.0, 2.0, "B", "B", "B"), (5, 1.0, 1.0, 1.0, "A", "A", "A"), (6, 6.0, 1.0, 2.0, "C", "A", "A")]
CATS, NUMS = ["q1", "q2", "q3"], ["k1", "k2", "k3"]


@pytest.fixture(scope="module")
def six(spark):
    return literal_table(spark, SIX, "id int, k1 double, k2 double, k3 double, q1 string, q2 string, q3 string")


@pytest.fixture(scope="module")
def model(six):
    return famd.fit_famd(six, CATS, NUMS)


def test_published_table(six, model):
    assert model.total_inertia == 8 and model.n_keep == 3
    assert model.eigenvalues == pytest.approx([3.466804, 2.5, 1.971105, 0.055853, 0.006238], abs=1e-6)
    s = np.array([[r["Factor_1"], r["Factor_2"]] for r in model.transform(six, ["id"]).orderBy("id").collect()])
    assert np.abs(s[:, 0]) == pytest.approx(np.abs([2.4125, 2.7075, -.8748, -.8319, -2.1351, -1.2783]), abs=1e-4)
    assert np.abs(s[:, 1]) == pytest.approx(np.abs([-.4226, -.4226, 2.1129, 2.1129, -1.6903, -1.6903]), abs=1e-4)
    want = {"k1": 16.4477, "k2": 9.8542, "k3": 9.5288, "q1": 29.3237, "q2": 11.7870, "q3": 23.0587}
    got = model.total_contribution_pct()
    assert all(got[v] == pytest.approx(want[v], abs=1e-4) for v in want)


def test_published_relationships(model):
    b = model.relationship_blocks()
    for (x, y), v in {("k2", "k3"): .9, ("q1", "k1"): .9143, ("q2", "q3"): 1, ("q1", "q1"): 2, ("k1", "k1"): 1,
                      ("q1", "q2"): .25, ("k3", "q3"): .9333}.items():
        assert b[x, y] == pytest.approx(v, abs=1e-4)


def dense(rows, cats, nums):
    """The same analysis from the full standardised matrix."""
    cols = []
    for c in nums:
        x = np.array([r[c] for r in rows], dtype=float)
        cols.append((x - x.mean()) / x.std())
    for c in cats:
        v = np.array([r[c] for r in rows])
        for lev in sorted(set(v)):
            p = (v == lev).mean()
            cols.append(((v == lev) - p) / np.sqrt(p))
    z = np.array(cols).T
    u, s, vt = np.linalg.svd(z / np.sqrt(len(rows)), full_matrices=False)
    return s ** 2, z @ vt.T


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        g = int(rng.integers(0, 3))
        rows.append((i, float(rng.normal(g)), float(rng.exponential()), f"g{g}", f"h{int(rng.integers(0, 4)) if g else 0}",
                     f"u{int(rng.integers(0, 80))}"))
    return spark.createDataFrame(rows, "customer_id long, x double, y double, a string, b string, c string").persist()


def test_against_dense_matrix(mixed):
    m = famd.fit_famd(mixed, ["a", "b"], ["x", "y"], n_components=4)
    values, scores = dense([r.asDict() for r in mixed.orderBy("customer_id").collect()], ["a", "b"], ["x", "y"])
    assert m.eigenvalues == pytest.approx(values[:4], abs=1e-9)
    got = np.array([r["f"] for r in m.transform(mixed, n=4, as_array="f").orderBy("customer_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(scores[:, :4]), abs=1e-8)


def test_both_counting_ways_agree(mixed, monkeypatch):
    cats = ["a", "b", "c"]  # c has many levels: the broadcast path of the scores
    one = famd.mixed_stats(mixed, cats, ["x", "y"])
    monkeypatch.setattr(famd, "CELLS_PER_ROW", 0.0)
    two = famd.mixed_stats(mixed, cats, ["x", "y"])
    monkeypatch.setattr(famd, "CELLS_PER_ROW", 1e9)
    three = famd.mixed_stats(mixed, cats, ["x", "y"])
    assert one.matrix == pytest.approx(two.matrix, abs=1e-12) and two.matrix == pytest.approx(three.matrix, abs=1e-12)
    m = famd.decompose(one, cats + ["x", "y"])
    assert len(one.levels["c"]) > famd.LITERAL_LEVELS
    row = m.transform(mixed).agg(F.avg("Factor_1"), F.var_pop("Factor_1"), F.corr("Factor_1", "Factor_2")).first()
    assert tuple(row) == pytest.approx((0, m.eigenvalues[0], 0), abs=1e-9)


def test_shape_of_the_fit(spark, mixed):
    m = famd.fit_famd(mixed, ["a", "b"], ["x", "y"])
    trace = np.trace(m.stats.matrix)
    assert trace == pytest.approx(m.total_inertia)
    for j in range(len(m.eigenvalues)):
        assert sum(c[j] for c in m.contribution().values()) == pytest.approx(1)
    t = m.explained_table(spark).orderBy("component").collect()
    assert t[-1]["cumulative_variance"] == pytest.approx(1) and sum(r["retained"] for r in t) == m.n_keep


def test_closed_form_tables_match_the_rows(spark, mixed):
    m = famd.fit_famd(mixed, ["a", "b"], ["x", "y"])
    scored = m.transform(mixed, ["customer_id", "a", "b", "x", "y"])
    coded = ordinal_codes(ordinal_codes(scored, "a", "ca"), "b", "cb").persist()
    loads = {(r["variable"], r["component"]): r["loading"] for r in m.loadings_table(spark).collect()}
    for v, col in (("x", "x"), ("y", "y"), ("a", "ca"), ("b", "cb")):
        for j in (1, 2):
            assert loads[v, j] == pytest.approx(coded.agg(F.corr(col, f"Factor_{j}")).first()[0], abs=1e-9)
    means = {(r["a"]): r["m"] for r in scored.groupBy("a").agg(F.avg("Factor_2").alias("m")).collect()}
    for r in m.centroids_table(spark).filter("variable = 'a' and component = 2").collect():
        assert r["centroid"] == pytest.approx(means[r["level"]], abs=1e-9)
    quality = {r["variable"]: r["contribution"] for r in report.variable_quality(m, spark).collect()}
    assert quality["x"] == pytest.approx(m.contribution()["x"][:2].sum())
    assert report.category_map(m, spark).count() == 7 and report.correlation_circle(m, spark).count() == 4


def test_rescaling_changes_nothing(mixed):
    a = famd.fit_famd(mixed, ["a", "b"], ["x", "y"])
    b = famd.fit_famd(zscore(mixed, ["x", "y"], ddof=1), ["a", "b"], ["x", "y"])
    assert a.eigenvalues == pytest.approx(b.eigenvalues)
    sa = np.array([r["f"] for r in a.transform(mixed, as_array="f").orderBy("customer_id").collect()])
    sb = np.array([r["f"] for r in b.transform(zscore(mixed, ["x", "y"], ddof=1), as_array="f").orderBy("customer_id").collect()])
    assert np.abs(sa) == pytest.approx(np.abs(sb), abs=1e-8)


def test_refit_from_the_same_statistics(mixed):
    full = famd.mixed_stats(mixed, ["a", "b", "c"], ["x", "y"])
    part = famd.decompose(famd.restrict(full, ["b", "y"]), ["b", "y"])
    fresh = famd.fit_famd(mixed, ["b"], ["y"])
    assert part.eigenvalues == pytest.approx(fresh.eigenvalues)


def test_components_to_target():
    assert famd.components_to_target([.5, .85, 1], .85) == 2
    assert famd.components_to_target([.9, 1], .85) == 2
    assert famd.components_to_target([.2, .4, .6], .85) == 3


def test_variance_and_prune_tables(spark):
    t = spark.createDataFrame([(1, 5.0), (2, 3.5), (3, 1.5)], "component int, eigenvalue double")
    assert [r["retained"] for r in famd.variance_table(t).orderBy("component").collect()] == [True, True, False]
    shares = spark.createDataFrame([(f"v{i:02d}", 10.0 - i if i < 13 else 0.3) for i in range(14)],
                                   "variable string, total_contrib_pct double")
    dropped = {r["variable"] for r in famd.prune_list(shares).filter("dropped").collect()}
    assert dropped == {"v10", "v11", "v12", "v13"}  # two last, and three more below 0.40
    ranked = famd.prune_list(shares.filter("total_contrib_pct > 1")).filter("dropped").collect()
    assert [r["variable"] for r in ranked] == ["v08"]


def test_guards(spark, mixed):
    with pytest.raises(ValueError, match="without variance"):
        famd.mixed_stats(mixed.withColumn("k", F.lit(1.0)), ["a"], ["k"])


def test_tuples_are_only_summed_first_where_tasks_combine_them(spark, monkeypatch):
    rows = [(str(i % 2), str(i // 2 % 2), float(i), float(i * i % 7)) for i in range(100)]
    df, first = spark.createDataFrame(rows, "a string, b string, x double, y double"), []
    products = famd._numeric_products
    monkeypatch.setattr(famd, "_numeric_products", lambda cells, *rest: first.append("zz0_0" in cells.columns) or products(cells, *rest))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("1", "4"):  # 100 rows and 4 tuples a task, then 25 and 4
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(famd.mixed_stats(df, ["a", "b"], ["x", "y"]).matrix)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == [True, False]
    np.testing.assert_allclose(found[0], found[1], atol=1e-12)
