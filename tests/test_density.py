import numpy as np
import pytest

from factorseg.operators import density
from factorseg.plans import first_generation


def brute(p, eps, min_samples, min_size):
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label, n = -np.ones(len(p), dtype=int), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[k] = n
                    stack.append(k)
            n += 1
    sizes = np.bincount(label[label >= 0], minlength=n)
    return np.array([v if v >= 0 and sizes[v] >= min_size else -1 for v in label])


@pytest.mark.parametrize("eps,min_samples,limit", [(0.2, 8, 1024), (0.5, 20, 4)])
def test_same_partition_as_brute_force(spark, monkeypatch, eps, min_samples, limit):
    # a tiny pair limit sends well-filled boxes through the refinement
    monkeypatch.setattr(density, "PAIR_LIMIT", limit)
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(300, 2)) * 0.3, rng.normal(size=(200, 2)) * 0.2 + [2, 1],
                        rng.uniform(-3, 3, size=(100, 2)), np.tile([[1.5, -2.0]], (60, 1))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)],
                               "customer_id long, x double, y double")
    rows = density.density_clusters(df, "x", "y", eps, min_samples, 20).orderBy("customer_id").collect()
    got, want = np.array([r["cluster"] for r in rows]), brute(p, eps, min_samples, 20)
    assert ((got == -1) == (want == -1)).all()
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    sizes = [int((got == c).sum()) for c in sorted(set(got) - {-1})]
    assert sizes == sorted(sizes, reverse=True)


def test_long_chain_is_one_cluster(spark):
    df = spark.range(400).selectExpr("id AS customer_id", "id * 0.5D AS x", "0D AS y")
    out = density.density_clusters(df, "x", "y", 0.6, 2, 10)
    assert [tuple(r) for r in out.groupBy("cluster").count().collect()] == [(0, 400)]


def test_a_run_goes_on_from_written_tables(spark):
    rng = np.random.default_rng(3)
    raw = spark.createDataFrame([(i, "Yes", "ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))],
                                "customer_id long, quiz_taker string, quiz_result string, order_count double, symptom_count double")
    run = first_generation.density_run(raw, first_generation.EncodingSpec(), 0.5, 5, 20)
    assert run.projection.inputFiles() and run.rows.inputFiles()
    assert run.rows.count() == run.projection.count() == 200
