from pyspark.sql import functions as F

from factorseg.functions import columns as C


def values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def one(spark, rows, expr, schema="x string"):
    return [r[0] for r in values(spark, [(r,) for r in rows], schema, expr)]


def test_normalize_map(spark):
    assert one(spark, [" Foo® ", "bar", "  ", None, "\tFoo® "], C.normalize_map("x", {"Foo®": "foo"})) == \
        ["foo", "bar", None, None, "foo"]
    assert one(spark, ["Foo®", " Foo®", None], C.replace_map("x", {"Foo®": "foo"})) == ["foo", " Foo®", None]


def test_bucket_lookup(spark):
    got = one(spark, ["Foo®", "foo", "bar", None], C.bucket_lookup("x", {"Foo®": "foo"}, {"foo": "b1"}))
    assert got == ["b1", "b1", None, None]


def test_token_buckets_and_collapse(spark):
    m = {"A": "x", "B": "x", "C": "y"}
    rows = ["A, B", "A,C", "Z", "a", "", None]
    assert one(spark, rows, C.token_buckets("x", m)) == [["x"], ["x", "y"], [], [], [], []]
    assert one(spark, rows, C.collapse_buckets(C.token_buckets("x", m))) == ["x", "multi", "none", "none", "none", "none"]
    assert one(spark, ["A"], C.token_buckets("x", {})) == [[]]


def test_bucket_match(spark):
    rows = [("x", ["x", "y"]), ("z", ["x"]), (None, ["x"]), ("x", []), ("x", None)]
    assert values(spark, rows, "b string, s array<string>", C.bucket_match("b", "s")) == [(1,), (0,), (0,), (0,), (0,)]


def test_code_group(spark):
    assert one(spark, [" K1 ", "q", " ", None], C.code_group("x", ["K1"])) == ["k1", "other", "none", "none"]
    assert one(spark, ["k1", "K1", None], C.code_group_exact("x", ["k1"])) == ["k1", "other", "none"]


def test_fallback_category(spark):
    rows = [(" F ", 1), (None, 1), ("", 0), (None, None)]
    df = spark.createDataFrame(rows, "g string, f int")
    assert [r[0] for r in df.select(C.fallback_category(df, "g", "f")).collect()] == ["f", "male", "female", "missing"]
    df = spark.createDataFrame([(None, "x"), (None, "1"), (None, "1.0"), (None, " 0 ")], "g string, f string")
    assert [r[0] for r in df.select(C.fallback_category(df, "g", "f")).collect()] == ["missing", "male", "missing", "female"]
    df = spark.createDataFrame([(1.7,), (float("nan"),)], "f double")
    assert [r[0] for r in df.select(C.fallback_category(df, "g", "f")).collect()] == ["male", "missing"]


def test_numbers(spark):
    df = spark.createDataFrame([("3.5",), ("x",), (None,), ("1d",), (" 2 ",), ("nan",)], "x string")
    assert [r[0] for r in df.select(C.number_filled(df, "x")).collect()] == [3.5, 0.0, 0.0, 0.0, 2.0, 0.0]
    assert [r[0] for r in df.select(C.to_number("x")).collect()] == [3.5, None, None, None, 2.0, None]


def test_small_expressions(spark):
    assert one(spark, ["-", "a", None], C.sentinel_replace("x", "-")) == ["missing", "a", None]
    assert one(spark, ["Ab-C 1!"], C.slugify("x")) == ["abc1"]
    assert one(spark, [None, "a"], C.category_filled("x")) == ["missing", "a"]
    assert one(spark, [0.25, 0.35, 2.5], C.round_even("x", 1), "x double") == [0.2, 0.4, 2.5]
    assert one(spark, [0.5, 2 / 3], C.share_label(F.lit("c"), "x"), "x double") == ["c:50.0%", "c:66.7%"]
    assert one(spark, [3.25, 3.2, 3.0, 12345678.9, None], C.plain_number("x"), "x double") == \
        ["3.25", "3.2", "3.0", "12345678.9", "nan"]
    assert one(spark, [0.1, -0.5, 0.7, None], C.correlation_band("x"), "x double") == ["low", "moderate", "high", None]
