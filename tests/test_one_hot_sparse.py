import numpy as np

from factorseg.operators import encode


def test_sparse_equals_dense(spark):
    rows = [(i, f"a{i % 5}" if i % 7 else None, i % 40 if i % 9 else None, "only", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, level int, code string, v double")
    columns = ["a", "level", "code"]
    dense = encode.one_hot_drop_first(df, columns).toPandas().set_index("id").sort_index().drop(columns="v")
    sparse, width = encode.one_hot_sparse(df, columns)
    assert width == dense.shape[1] and sparse.columns == [*df.columns, "indices"]
    matrix = np.zeros(dense.shape, int)
    for r in sparse.collect():
        assert r.indices == sorted(r.indices)
        matrix[r.id, r.indices] = 1
    assert (matrix == dense.to_numpy()).all()
    gram = np.zeros((width, width), int)
    for r in encode.sparse_cross_products(sparse).collect():
        gram[r.i, r.j] = r.n
    assert (gram == np.triu(matrix.T @ matrix)).all()
    empty, width = encode.one_hot_sparse(df.filter("false"), columns)
    assert width == 0 and empty.count() == 0
