"""Inner queries leave no shuffle files behind, and their plans are described in short."""

import time

import numpy as np
from pyspark.sql import functions as F

from factorseg.llm import graph, words
from factorseg.operators import lineage

SETTINGS = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxPlanStringLength"]


def _shuffle_files(spark) -> set:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def _left(spark, work) -> set:
    """Shuffle files that the work has left a little after its end."""
    before = _shuffle_files(spark)
    work()
    for _ in range(20):
        new = _shuffle_files(spark) - before
        if not new:
            break
        time.sleep(0.1)
    return new


def _summed(spark, n: int = 1000):
    return spark.range(n).withColumn("k", F.col("id") % 100).groupBy("k").agg(F.sum("id").alias("s"))


def test_written_tables_leave_no_shuffle_files(spark):
    frame, out = _summed(spark), []
    assert not _left(spark, lambda: out.append(lineage.cut_lineage(frame)))
    assert out[0].agg(F.sum("s")).first()[0] == frame.agg(F.sum("s")).first()[0] == 499500


def test_components_leave_no_shuffle_files(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    out = []
    assert not _left(spark, lambda: out.append(graph.components(edges)))
    assert {(r.node, r.component) for r in out[0].collect()} == {(i, 0) for i in range(1, 21)} | {(101, 100)}


def test_merged_cells_leave_no_shuffle_files(spark):
    def rows(batches):
        for batch in batches:
            cells = np.bincount(batch.column(0).to_numpy() % 64, minlength=64).astype(np.uint32)
            yield from words.cell_rows(cells)

    out = []
    parts = spark.range(0, 640, 1, 3).mapInArrow(rows, "chunk int, cells binary")
    assert not _left(spark, lambda: out.append(words.merged_cells(parts, 6)))
    assert np.frombuffer(out[0], np.uint32).tolist() == [10] * 64


def test_long_plans_are_described_in_short(spark):
    frame = _summed(spark)
    for i in range(60):
        frame = frame.join(_summed(spark), "k", "left_semi") if i < 4 else frame.filter(f"s <> {-i} or length(concat(k, '{'x' * 200}')) > {i}")
    full = len(frame._jdf.queryExecution().toString())
    with lineage.lean(spark):
        short = len(frame._jdf.queryExecution().toString())
    assert short < 10_000 < full == len(frame._jdf.queryExecution().toString())


def test_settings_come_back(spark):
    def now():
        return [spark.conf.get(name, None) for name in SETTINGS]

    assert now() == [None, None]
    spark.conf.set(SETTINGS[1], "20k")
    try:
        with lineage.lean(spark):
            assert now() == ["true", lineage.PLAN_CHARS]
        assert now() == [None, "20k"]
        try:
            with lineage.lean(spark):
                raise ValueError
        except ValueError:
            pass
        assert now() == [None, "20k"]
    finally:
        spark.conf.unset(SETTINGS[1])
