import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factorseg.operators import medians
from factorseg.operators.profile import cluster_profile, modal_values
from factorseg.plans.report import persona_lines, value_comparison, value_summary


def test_medians_of_skewed_groups(spark, monkeypatch):
    # a coarse sketch makes the bracket matter on a small table
    monkeypatch.setattr(medians, "ACCURACY", 50)
    monkeypatch.setattr(medians, "RANK_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.exponential(10, 4000), 1)]
    rows += [("same", 7.0)] * 900 + [("same", 9.0)] * 100
    rows += [("few", 2.0), ("few", None), ("few", 4.0)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["median"] for r in medians.group_medians(df, ["g"], {"x": F.col("x")}).collect()}
    want = {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in {r[0] for r in rows}}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40))
def test_medians_any_rows(spark, rows):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g int, x double")
    got = {r["g"]: r["median"] for r in medians.group_medians(df, ["g"], {"x": F.col("x")}).collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: float(np.median(v)) for g, v in want.items()}


def test_profile_rules(spark):
    rows = [(0, "b", 2.0, "1", "p"), (0, "a", None, "0", "p"), (0, None, 4.0, None, "q"), (1, "z", 1.0, "1", None)]
    df = spark.createDataFrame(rows, "c int, cat string, x double, match string, promo string")
    p = cluster_profile(df, "c", ["cat", "absent"], ["x"], "match", "promo").collect()
    assert [r["n_customers"] for r in p] == [3, 1]
    assert (p[0]["cat_top"], p[0]["cat_pct"], p[0]["x_mean"], p[0]["x_median"]) == ("a", 50.0, 2.0, 3.0)
    assert (p[0]["match_pct"], p[0]["promo_1"], p[0]["promo_2"], p[0]["promo_3"]) == (33.3, "p:66.7%", "q:33.3%", None)
    assert p[1]["promo_1"] is None
    skip = cluster_profile(df, "c", ["cat"], ["x"], null_as_zero=False).collect()
    assert skip[0]["x_mean"] == 3.0


def test_modal_tie_takes_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a")], "c int, v string")
    assert modal_values(df, "c", ["v"]).first()["top"] == "a"


def test_personas_and_value_tables(spark):
    df = spark.createDataFrame([(0, 5, "r", 1.5, 10.25)], "cluster int, n_customers long, quiz_result_top string, "
                                                        "order_count_mean double, net_ltv_mean double")
    text = persona_lines(df, "T").first()["line"]
    assert text.startswith("T — Cluster 0 — 5 customers\n- Quiz result: r; Gender: —;")
    assert "avg orders 1.5, days since last order 0; Quiz-match: 0%" in text
    assert "mean LTV $10.25, mean AOV $—" in text
    assert value_summary(df, "T").columns == ["cluster", "n_customers", "net_ltv_mean", "tag"]
    both = value_comparison({"A": df, "B": df.drop("net_ltv_mean")}).collect()
    assert [r["net_ltv_mean"] for r in both] == [10.25, 0.0]
