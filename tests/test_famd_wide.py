"""Block iteration over level tables against the dense fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorseg.operators import famd_wide
from factorseg.operators.famd import fit_famd


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(1500):
        f = rng.normal()
        out.append((i, f"a{int(np.clip(f * 3 + rng.normal() + 6, 0, 11))}", None if i % 40 == 0 else f"b{int(rng.integers(0, 5) + (f > 0) * 2)}",
                    f"c{rng.integers(0, 3)}", float(f + rng.normal()), float(rng.normal() - f), None if i % 50 == 0 else float(rng.normal())))
    return spark.createDataFrame(out, "customer_id long, a string, b string, c string, x double, y double, z double").cache()


@pytest.mark.parametrize("small", [0, 10_000])
def test_axes_equal_the_dense_fit(rows, monkeypatch, small):
    monkeypatch.setattr(famd_wide, "SMALL_ROWS", small)
    cats, nums = ["a", "b", "c"], ["x", "y", "z"]
    dense = fit_famd(rows, cats, nums)
    wide = famd_wide.fit_famd_wide(rows, cats, nums, n_components=3)
    assert wide.eigenvalues == pytest.approx(dense.eigenvalues[:3], abs=1e-6)
    assert wide.total_inertia == dense.total_inertia
    got = {(r.variable, r.component): r.contribution for r in wide.contributions().collect()}
    for v, parts in dense.contribution().items():
        assert [got[v, j + 1] for j in range(3)] == pytest.approx(list(parts[:3]), abs=1e-4)
    a = np.array(wide.transform(rows, n=3).orderBy("customer_id").drop("customer_id").collect(), float)
    b = np.array(dense.transform(rows, n=3).orderBy("customer_id").drop("customer_id").collect(), float)
    for j in range(3):
        assert min(np.abs(a[:, j] - b[:, j]).max(), np.abs(a[:, j] + b[:, j]).max()) < 1e-3


def test_a_column_of_many_levels_has_its_closed_form(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, f"l{i % 3000}", float((i % 3000) % 7 + rng.normal())) for i in range(9000)], "customer_id long, c string, x double")
    model = famd_wide.fit_famd_wide(df, ["c"], ["x"], n_components=1)
    z = df.toPandas()
    z["x"] = (z.x - z.x.mean()) / z.x.std(ddof=0)
    m = z.groupby("c").x.agg(["mean", "size"])
    eta = np.sqrt((m["size"] / len(z) * m["mean"] ** 2).sum())
    assert model.eigenvalues[0] == pytest.approx(1 + eta, abs=1e-7)
    got = {r.level: r.axis[0] for r in model.weights.filter("variable = 'c'").collect()}
    want = np.sqrt(m["size"] / len(z)) * m["mean"] / eta / np.sqrt(2)
    sign = np.sign(model.weights.filter("variable = 'x'").first().axis[0])
    assert sign > 0 and all(abs(got[c] - w) < 1e-5 for c, w in want.items()) and len(got) == 3000


def test_nothing_to_learn_from_is_an_error(rows):
    with pytest.raises(ValueError):
        famd_wide.fit_famd_wide(rows.filter("false"), ["a"], ["x"])
    with pytest.raises(ValueError):
        famd_wide.fit_famd_wide(rows.withColumn("x", F.lit(1.0)), ["a"], ["x"])
