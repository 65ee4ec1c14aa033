from pyspark.sql import functions as F

from factorseg.functions.columns import token_buckets
from factorseg.operators.dictionary import table_lookup, token_buckets_from


def test_large_dictionary_equals_literal_map(spark):
    """A 200,000-code table, with a hot cell and a hot token, against the literal map of the codes that occur."""
    table = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("code"), F.concat(F.lit("b"), F.col("id") % 7).alias("bucket"))
    cells = [None, "", " , ", "nope", "c1", "c1, c2 ,c8", "c199999,c1,c1", "C1"] + ["c5,c6"] * 300 + [f"c1,c{i}" for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(i, c, "x", 1) for i, c in enumerate(cells)], "id long, cell string, key string, v int")
    mapping = {f"c{i}": f"b{i % 7}" for i in [*range(9), *range(0, 3000, 7), 199_999]}
    want = {r.id: r.b for r in df.select("id", token_buckets("cell", mapping).alias("b")).collect()}
    got = token_buckets_from(df, "cell", table, "code", "bucket", "hot")
    assert got.columns == ["id", "cell", "key", "v", "hot"]
    rows = got.collect()
    assert len(rows) == len(cells) and {r.id: r.hot for r in rows} == want


def test_lookup_of_odd_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("z", 3), ("b", 4)], "k string, out int")
    table = spark.createDataFrame([("a", "y"), ("a", "x"), (None, "n"), ("b", None)], "key string, value string")
    got = table_lookup(df, "k", table, "key", "value", "out")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "x"), ("a", "x"), (None, None), ("z", None), ("b", None)], key=str)
    assert table_lookup(df.filter("false"), "k", table, "key", "value", "out").count() == 0
    assert token_buckets_from(df, "k", table.filter("false"), "key", "value", "b").filter("size(b) = 0").count() == 5
