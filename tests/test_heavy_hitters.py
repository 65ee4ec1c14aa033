from collections import Counter

import numpy as np
import pytest

from factorseg.operators import heavy_hitters
from factorseg.operators.heavy_hitters import frequent_values


def brute(rows, names, top):
    out = set()
    for i, c in enumerate(names):
        counts = Counter(None if r[i] is None else str(r[i]) for r in rows)
        order = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
        out |= {(c, k + 1, v, n) for k, (v, n) in enumerate(order[:top])}
    return out


def table(df):
    return {(r["column"], r["rank"], r["value"], r["n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(6000) < 0.7, rng.integers(0, 8, 6000), rng.integers(100, 100000, 6000))
    return [(i, int(h), None if i % 3 == 0 else "abc"[i % 2], f"v{i % 40}") for i, h in enumerate(hot)]


@pytest.mark.parametrize("counters,most", [(512, 2048), (60, 2048), (60, 0), (5, 2048)])
def test_equals_plain_counts(spark, monkeypatch, rows, counters, most):
    # unique, hot among many, few with nulls, flat: the summary's three ways, and no candidates at all
    monkeypatch.setattr(heavy_hitters, "CANDIDATES", most)
    names = ["key", "hot values", "few", "flat"]
    df = spark.createDataFrame(rows, "key long, `hot values` long, few string, flat string").repartition(7)
    assert table(frequent_values(df, 5, counters=counters)) == brute(rows, names, 5)


def test_hot_column_is_not_counted_whole(spark, monkeypatch, rows):
    asked, cells = [], heavy_hitters._cells
    monkeypatch.setattr(heavy_hitters, "_cells", lambda df, columns, at: asked.append(list(at)) or cells(df, columns, at))
    df = spark.createDataFrame([(r[1], r[0]) for r in rows], "hot long, key long").repartition(3)
    plan = frequent_values(df, 5, counters=60)._jdf.queryExecution().executedPlan().toString()
    # the hot column is read again through the broadcast of its candidates, the unique one is counted whole
    assert asked == [[0], [1]] and plan.count("BroadcastExchange") == 1


def test_types_empty_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(None, "x" * 100000), (None, ""), (1.5, "")], "a double, rank string")
    got = {(r["column"], r["data_type"], r["rank"], r["value"], r["n"]) for r in frequent_values(df, 2, counters=2).collect()}
    assert got == {("a", "double", 1, None, 2), ("a", "double", 2, "1.5", 1),
                   ("rank", "string", 1, "", 2), ("rank", "string", 2, "x" * 100000, 1)}
    assert frequent_values(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        frequent_values(df, 10, counters=5)
