"""Vector operators against brute force, with odd vectors, ties, repeated rows and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorseg.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, node int"
ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
       (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (920, [], 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype("f4")
    x[100:130] = x[100]                                              # copies
    x[130:190] = x[130] + 0.03 * rng.standard_normal((60, 16))       # near copies
    x[190:200] = 2 * x[190]
    rows = [(i, [float(v) for v in r], int(i % 3) if i >= 200 else 1) for i, r in enumerate(x)]
    rows += [*ODD, (5, rows[5][1], 1), (300, rows[100][1], None)]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA).repartition(3)
    return rows, df.cache()


def good(v):
    return v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)


def test_nearest(spark, vectors):
    rows, df = vectors
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    ids = np.array([r[0] for r in rows if r[0] is not None and good(r[1])])
    x = np.array([r[1] for r in rows if r[0] is not None and good(r[1])], float)
    hits = total = 0
    asked = sorted({i for i in ids if i % 20 == 0})
    for q in asked:
        own = [r for r in out if r.query_id == q]
        best = {}
        for a in np.flatnonzero(ids == q):
            for b in np.flatnonzero(ids != q):
                s = (x[a] * x[b]).sum()
                best[ids[b]] = max(s, best.get(ids[b], -np.inf))
        want = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        assert [r.rank for r in own] == list(range(1, 11)) or sorted(r.rank for r in own) == list(range(1, 11))
        for r in own:
            assert r.score == pytest.approx(best[r.vec_id], abs=1e-12)
        ranked = sorted(own, key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in ranked] == sorted((-r.score, r.vec_id) for r in ranked)
        hits += len({r.vec_id for r in own} & {i for i, _ in want})
        total += 10
    assert {r.query_id for r in out} == set(asked) and hits / total >= 0.9


def test_nearest_gives_all_of_few(spark, vectors):
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    out = ann.nearest(few, F.col("vec_id") == 0, k=20).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(1, 4, 6.0), (2, 3, 5.0), (3, 2, 4.0), (4, 1, 3.0)]
    assert ann.nearest(few.filter("false"), F.col("vec_id") == 0).count() == 0


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((4, 8)), 50, axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    for r in out:
        assert r.vec_id // 50 == r.query_id // 50
    for q in range(0, 200, 20):
        low = q // 50 * 50
        assert sorted(r.vec_id for r in out if r.query_id == q) == [i for i in range(low, low + 7) if i != q][:5]


@pytest.mark.parametrize("cell_rows", [2048, 16])
def test_near_duplicates(spark, vectors, monkeypatch, cell_rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    rows, df = vectors
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    use = [r for r in rows if good(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in use], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([[a[2] == b[2] for b in use] for a in use])
    near = (x @ x.T >= 0.98) & same
    np.fill_diagonal(near, False)
    group = np.arange(len(use))
    while True:
        low = np.array([min([group[i], *group[near[i]]]) for i in range(len(use))])
        if (low == group).all():
            break
        group = low
    names = {g: min([use[i][0] for i in range(len(use)) if group[i] == g and use[i][0] is not None], default=None) for g in set(group)}
    want = sorted([(r[0], int(near[i].sum()), names[group[i]] if r[0] is not None else None) for i, r in enumerate(use)]
                  + [(r[0], 0, r[0]) for r in rows if not (good(r[1]) and r[2] is not None)], key=str)
    found = sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str)
    lost = sum(a != b for a, b in zip(found, want))
    assert lost <= 2 and sum(n for _, n, _ in found) >= 0.97 * sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0
