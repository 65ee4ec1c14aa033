import random

from factorseg.operators.encode import with_file_row_index


def test_equals_line_numbers_of_many_files(spark, tmp_path):
    rng, lines = random.Random(5), []
    for name, n in (("b.csv", 3000), ("a.csv", 1), ("c.csv", 0), ("d.csv", 700)):
        part = [f"{rng.randint(0, 9)},{'x' * rng.randint(0, 30)}{i}" for i in range(n)]
        (tmp_path / name).write_text("".join(line + "\n" for line in ["digit,file", *part]))
        lines.append((name, part))
    want = [tuple(x.split(",")) for _, part in sorted(lines) for x in part]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = spark.read.csv(str(tmp_path), header=True)
        assert df.rdd.getNumPartitions() > 5
        rows = with_file_row_index(df, "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["at"] for r in rows) == list(range(len(want)))
    assert [(r["digit"], r["file"]) for r in sorted(rows, key=lambda r: r["at"])] == want


def test_empty_table_and_replaced_column(spark, tmp_path):
    spark.range(5).selectExpr("id AS at", "'a' AS block").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(tuple(r) for r in with_file_row_index(df, "at").collect()) == [("a", i) for i in range(5)]
    assert with_file_row_index(df.filter("false"), "at").count() == 0
