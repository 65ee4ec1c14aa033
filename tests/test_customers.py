import datetime as dt

from factorseg.queries import QUERIES
from factorseg.sources.customers import customer_frame


def day(n):
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


def tables(spark):
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, None)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double",
                     [(1, 0, "A", 1.0), (1, 0, "A", 1.0), (2, 1, None, None), (3, None, "B", 2.0), (4, 0, "B", 3.0), (None, 0, "C", 0.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(10, 1, "F", 5.0, day(3), "p"), (11, 1, "O", 7.0, day(2), "q"), (11, 1, "O", 7.0, day(2), "q"), (12, 2, "P", None, None, None),
                    (13, 2, "F", 1.0, day(1), "r"), (14, 3, "F", 1.0, day(1), "r"), (15, None, "F", 1.0, day(1), "r"), (None, 3, "F", 4.0, day(5), "s")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_extendedprice double, l_discount double, l_returnflag string",
                     [(10, 1, 100.0, 0.5, "R"), (11, 2, 10.0, 0.0, "R"), (11, 2, 20.0, 0.0, "N"), (11, 3, 40.0, None, None), (12, 4, 8.0, 0.25, "R"),
                      (15, 1, 9.0, 0.0, "R"), (None, 1, 9.0, 0.0, "R"), (13, None, 1.0, 0.0, "N")]),
        "part": ("p_partkey long, p_type string", [(1, "x"), (2, "z"), (2, "y"), (3, "z"), (4, None), (None, "n")]),
    }
    made = {name: spark.createDataFrame(data, schema) for name, (schema, data) in rows.items()}
    return made.__getitem__


def test_odd_rows_keep_their_place(spark):
    frame = customer_frame(tables(spark)).drop("days_since_last_order")
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    one = (1, "A", "ASIA", "q", "O", "y,z", 3.0, 1.0, 3.0, 110.0, 19.0 / 3, 240.0)
    assert got == sorted([
        one, one, (2, None, None, None, "P", "", 2.0, None, 1.0, 7.0, 1.0, 9.0),
        (3, "B", None, "r", "F", None, 2.0, 2.0, None, None, 2.5, None),
        (4, "B", "ASIA", None, None, None, None, 3.0, None, None, None, None),
        (None, "C", "ASIA", None, None, None, None, 0.0, None, None, None, None)], key=str)


def test_part_keys_do_not_travel_with_the_sums(spark):
    plan = customer_frame(tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(l_partkey" not in plan


def test_lines_are_summed_after_their_shuffle(spark):
    plan = customer_frame(tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan


def test_queries_hold_only_the_columns_they_use(spark, tmp_path):
    made = tables(spark)
    for name in ("region", "nation", "customer", "orders", "lineitem", "part"):
        made(name).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("zscore_pop", "ordinal_codes", "one_hot_drop_first"):
        out = QUERIES[query](spark, str(tmp_path))
        assert out.count() == 6
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and "l_extendedprice" not in plan, query
        spark.catalog.clearCache()
