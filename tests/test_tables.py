import pytest

from factorseg.sources import tables as T
from factorseg.operators.quality import column_profile, coverage_filter, coverage_report, dominance_filter, value_shares


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,x,n,flag,none\n1,a,1.5,true,NA\n2,NA,null,false,\n3,c,2,true,NaN\n")
    df = T.read_csv_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "x": "string", "n": "double", "flag": "boolean", "none": "double"}
    assert [tuple(r)[:3] for r in df.orderBy("id").collect()] == [(1, "a", 1.5), (2, None, None), (3, "c", 2.0)]
    assert dict(T.read_csv_table(spark, str(path), dtypes={"id": "string"}).dtypes)["id"] == "string"


def test_csv_quoting(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('id,name,v\n1,"say ""hi"", you",2\n2,"line\nbreak",3\n3,"a,b",4\n4,plain\n')
    rows = T.read_csv_table(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", you', 2.0), (2, "line\nbreak", 3.0), (3, "a,b", 4.0), (4, "plain", None)]
    one_line = tmp_path / "lines.csv"
    one_line.write_text('id,name\n1,"x ""y"""\n2,"a,b"\n')
    assert [r["name"] for r in T.read_csv_table(spark, str(one_line), multiline=False).orderBy("id").collect()] == ['x "y"', "a,b"]
    long = tmp_path / "long.csv"
    long.write_text("id,v\n1,2\n2,3,4\n")
    with pytest.raises(Exception, match="more cells than the header"):
        T.read_csv_table(spark, str(long)).collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5]), (2, [2.0, 3.0])], "customer_id long, features array<double>")
    T.write_table(df, str(tmp_path / "scores"))
    assert T.read_optional(spark, str(tmp_path / "scores")).orderBy("customer_id").collect() == df.collect()
    T.write_table(df.select("customer_id"), str(tmp_path / "csv"), "csv")
    assert T.read_csv_table(spark, str(tmp_path / "csv")).count() == 2
    assert T.read_optional(spark, str(tmp_path / "absent")) is None
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "line_no long, line string")
    T.write_report(lines, str(tmp_path / "text"))
    parts = sorted(p for p in (tmp_path / "text").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nc\n"


def test_contracts(spark):
    df = spark.range(1).selectExpr("id AS a", "id AS b", "id AS Factor_1")
    with pytest.raises(ValueError, match="customer_id"):
        T.require_columns(df, ["customer_id"])
    with pytest.raises(IndexError):
        T.select_positions(df, [0, 3])
    assert T.select_positions(df, [1, 0]).columns == ["b", "a"]
    assert T.select_prefix(df, "Factor_") == ["Factor_1"]
    assert T.drop_present(df, ["a", "zz"]).columns == ["b", "Factor_1"]


def test_cluster_column():
    f = T.find_cluster_column
    assert f(["id", "cluster_A"], "A") == "cluster_A"
    assert f(["id", "cluster"], "A") == "cluster"
    assert f(["id", "cluster_B"], "A") == "cluster_B"
    assert f(["id", "cluster_B"], "A", strict=True) == "cluster_B"
    with pytest.raises(ValueError):
        f(["cluster_B", "cluster_C"], "A", strict=True)
    with pytest.raises(ValueError):
        f(["id"], "A")


def test_coverage(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 2.0, "a"), (4, float("nan"), "b"), (5, 3.0, None)],
                               "id long, x double, y string")
    got = {r["column"]: (r["non_null"], r["kept"]) for r in coverage_report(df, 0.6).collect()}
    assert got == {"id": (5, True), "x": (3, True), "y": (2, False)}
    assert coverage_filter(df, 0.6, strict=True).columns == ["id"]


def test_dominance(spark):
    df = spark.createDataFrame([("a", "k", 1.0, 5.0)] * 999 + [("b", "k", 1.0, 6.0)],
                               "d string, c string, flat double, n double")
    assert dominance_filter(df, ["d", "c"], ["flat", "n"]) == ([], ["n"])
    assert dominance_filter(df, ["d", "c"], ["flat", "n"], 0.999) == (["d"], ["n"])


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    assert {(r["value"], r["n"]): r["share"] for r in value_shares(df, "x").collect()} == {("a", 2): 2 / 3, ("b", 1): 1 / 3}
    top = column_profile(df, 2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == [("a", 2), (None, 1)]
