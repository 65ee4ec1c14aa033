import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factorseg.plans import catalogue
from factorseg.plans.outputs import schema_lines


def tables(spark, n):
    return {"numbers": spark.range(n).withColumn("odd name", F.col("id") % 2), "none": spark.createDataFrame([], "a int")}


def lines(spark):
    return {"summary": spark.createDataFrame([(1, "second"), (0, "first")], "line_no int, line string")}


def test_newest_run_is_read_and_older_ones_stay(spark, tmp_path):
    folder = str(tmp_path / "runs")
    with pytest.raises(FileNotFoundError):
        catalogue.manifest(spark, folder)
    assert catalogue.publish(spark, folder, tables(spark, 3), lines(spark)) == 1
    assert catalogue.publish(spark, folder, tables(spark, 5)) == 2
    assert catalogue.table(spark, folder, "numbers").count() == 5
    assert catalogue.table(spark, folder, "numbers", 1).count() == 3
    assert [r[0] for r in catalogue.table(spark, folder, "summary", 1).collect()] == ["first", "second"]
    assert catalogue.manifest(spark, folder)["entries"]["none"]["hash"] == "0"
    assert catalogue.table(spark, folder, "none").columns == ["a"]
    with pytest.raises(KeyError):
        catalogue.table(spark, folder, "summary")
    with pytest.raises(FileNotFoundError):
        catalogue.manifest(spark, folder, 7)


def test_run_that_stops_half_way_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "runs")
    catalogue.publish(spark, folder, tables(spark, 3))
    bad = spark.range(10).select(F.raise_error(F.lit("stopped")).alias("x"))
    with pytest.raises(PySparkException):
        catalogue.publish(spark, folder, {"numbers": spark.range(9), "bad": bad})
    assert len(list((tmp_path / "runs").glob("run-*"))) == 2
    assert catalogue.table(spark, folder, "numbers").count() == 3
    assert catalogue.publish(spark, folder, tables(spark, 4)) == 2


def test_damage_is_named(spark, tmp_path):
    folder = str(tmp_path / "runs")
    catalogue.publish(spark, folder, tables(spark, 3), lines(spark))
    assert catalogue.damaged(spark, folder) == []
    entry = catalogue.manifest(spark, folder)["entries"]["numbers"]
    spark.createDataFrame([(9, 1)], "id long, `odd name` long").write.mode("append").parquet(f"{folder}/{entry['path']}")
    assert catalogue.damaged(spark, folder) == ["numbers"]


def test_schema_summary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    got = [r["line"] for r in schema_lines(df, 2).orderBy("line_no").collect()]
    assert got == ["k (int)", "  1: 1", "  2: 1", "t (string)", "  a: 2", "  null: 1"]
