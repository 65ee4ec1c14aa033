import numpy as np
import pytest

from factorseg.operators import encode, kmeans, lineage, silhouette
from factorseg.plans.segmentation import choose_k, extend_starts
from factorseg.plans.stability import seed_stability


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    centers = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [8, 8, 8]])
    x = np.concatenate([rng.normal(c, 1.0, size=(n, 3)) for c, n in zip(centers, (300, 60, 80, 100))])
    x = np.concatenate([x, np.tile(x[:1], (40, 1))])  # copies of one point
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "customer_id long, features array<double>").repartition(6).persist()
    return df, x


def brute_silhouette(x, label, square=False):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if square else np.sqrt(d)
    out = []
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_search_finds_the_blobs(spark, blobs):
    df, x = blobs
    k, score, curve, models = choose_k(df, range(2, 7), starts=4, metric="euclidean")
    assert k == 4 and [c[0] for c in curve] == [2, 3, 4, 5, 6]
    rows = kmeans.assign_clusters(df, "features", models[4]).orderBy("customer_id").collect()
    label = np.array([r["cluster"] for r in rows])
    assert sorted(np.bincount(label)) == [60, 80, 100, 340]
    centers = np.array([x[label == c].mean(axis=0) for c in range(4)])
    assert models[4].centers == pytest.approx(centers, abs=0.05)
    assert list(models[4].centers[:, 0]) == sorted(models[4].centers[:, 0])
    inertia = sum(((x[label == c] - models[4].centers[c]) ** 2).sum() for c in range(4))
    assert models[4].inertia == pytest.approx(inertia)
    assert score == pytest.approx(brute_silhouette(x, label), abs=1e-9)


def test_summing_ways_agree(blobs, monkeypatch):
    df, x = blobs
    models = [x[:2], x[5:9]]
    monkeypatch.setattr(kmeans, "TASK_WORK", 100)
    few = kmeans._pass(df, "features", models, len(x), 6)
    monkeypatch.setattr(kmeans, "DIRECT_ROWS", 0)
    many = kmeans._pass(df, "features", models, len(x), 6)
    assert all(np.allclose(a, b) for a, b in zip(few, many)) and few[0].sum() == 2 * len(x)


def test_more_starts_extend_the_search(blobs):
    df, _ = blobs
    six = kmeans.fit_kmeans(df, "features", [5], 6)[5]
    three = kmeans.fit_kmeans(df, "features", [5], 3)[5]
    assert extend_starts(df, three, 3, 6, 42).inertia == pytest.approx(six.inertia)
    with pytest.raises(ValueError, match="cannot form"):
        kmeans.fit_kmeans(df, "features", [1000], 1)


def test_starts_find_a_cluster_of_one_row_in_ten_thousand(spark):
    """Starting centres come from all rows: three rows of thirty thousand, far from the rest, get a centre."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (15_000, 2)), rng.normal(8, 1, (14_997, 2)), rng.normal(400, 1, (3, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "customer_id long, features array<double>")
    df = df.repartition(4).cache()
    pool, weight = kmeans.seed_candidates(df, "features", "customer_id", 3, 42, len(x), 4)
    assert (pool[:, 0] > 300).sum() == 3 and weight.sum() == len(x)
    centers = kmeans.fit_kmeans(df, "features", [3], 2)[3].centers
    assert (np.abs(centers - [400, 400]).max(axis=1) < 2).sum() == 1
    df.unpersist()


def test_silhouette_fixture(spark):
    df = spark.createDataFrame([([0.0], 0), ([1.0], 0), ([10.0], 1), ([11.0], 1)], "x array<double>, g int")
    assert silhouette.silhouette(df, "x", "g", "euclidean") == pytest.approx(0.899749, abs=1e-6)
    lone = spark.createDataFrame([([0.0], "a"), ([1.0], "a"), ([10.0], "b")], "x array<double>, g string")
    assert silhouette.silhouette(lone, "x", "g", "euclidean") == pytest.approx(brute_silhouette(np.array([[0], [1], [10.]]), np.array([0, 0, 1])))


def test_silhouette_over_many_blocks(blobs, monkeypatch):
    df, x = blobs
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 60)
    monkeypatch.setattr(silhouette, "ROW_BYTES", 300)
    rng = np.random.default_rng(1)
    models = [kmeans.KMeansModel(k, x[rng.choice(len(x), k, replace=False)], 0.0, 0, 0) for k in (2, 5)]
    labelled = kmeans.assign_all(df, "features", models)
    rows = labelled.collect()
    pts, lab = np.array([r["features"] for r in rows]), np.array([r["labels"] for r in rows])
    exact = silhouette.silhouettes(labelled, "features", "labels", "euclidean")
    square = silhouette.silhouettes(labelled, "features", "labels", "squared_euclidean")
    for i in range(2):
        assert exact[i] == pytest.approx(brute_silhouette(pts, lab[:, i]), abs=1e-9)
        assert square[i] == pytest.approx(brute_silhouette(pts, lab[:, i], True), abs=1e-9)
    with pytest.raises(ValueError, match="metric"):
        silhouette.silhouettes(labelled, "features", "labels", "cosine")


@pytest.mark.parametrize("block_rows", [37, 100, 110, 10 ** 6])  # whole rounds of blocks, an even and an odd number, few
@pytest.mark.parametrize("cells", [0, 4])                        # sums by cluster at once, and by runs of equal labels first
def test_each_distance_is_taken_once_and_serves_both_points(spark, blobs, monkeypatch, block_rows, cells):
    _, x = blobs
    rng = np.random.default_rng(3)
    lab = np.stack([rng.integers(0, k, len(x)) for k in (2, 7, 60)], axis=1)
    lab[-40:] = lab[0]  # copies of one point
    df = spark.createDataFrame([([float(v) for v in f], [int(v) for v in l]) for f, l in zip(x, lab)], "features array<double>, labels array<int>")
    for name, value in (("BLOCK_ROWS", block_rows), ("ROW_BYTES", 700), ("TILE_ROWS", 16), ("CHUNK_ROWS", 5), ("CELLS_PER_CLUSTER", cells)):
        monkeypatch.setattr(silhouette, name, value)
    taken, inner = spark.sparkContext.accumulator(0), silhouette._meet

    def meet(a, b, *rest):
        taken.add(len(a.x) * len(b.x))
        inner(a, b, *rest)

    monkeypatch.setattr(silhouette, "_meet", meet)
    found = silhouette.silhouettes(df, "features", "labels", "euclidean")
    assert found == pytest.approx([brute_silhouette(x, lab[:, i]) for i in range(3)], abs=1e-9)
    n = len(x) - 40  # copies are one point with a weight
    assert n * n / 2 < taken.value <= n * (n + 16) / 2


@pytest.mark.parametrize("far", [0, 150])  # points that lie apart from the near ones
def test_silhouette_of_points_nearer_than_rounding(spark, far):
    rng = np.random.default_rng(5)
    x = np.concatenate([1000 + rng.normal(0, 1e-7, (50, 2)), rng.normal(-500, 100, (far, 2))])
    label = np.arange(len(x)) % 3
    df = spark.createDataFrame([([float(v) for v in f], [int(l)]) for f, l in zip(x, label)], "features array<double>, labels array<int>")
    assert silhouette.silhouettes(df, "features", "labels", "euclidean") == pytest.approx([brute_silhouette(x, label)], abs=1e-9)


def test_silhouette_of_a_point_without_coordinates_is_an_error(spark):
    rows = [([float(i), float(i % 5), 0.0, 1.0], [i % 2]) for i in range(3)] + [(None, [0])]
    df = spark.createDataFrame(rows, "features array<double>, labels array<int>").coalesce(1)
    with pytest.raises(Exception, match="cannot reshape|NoneType"):
        silhouette.silhouettes(df, "features", "labels", "euclidean")


def test_written_points_of_all_pairs_are_dropped(spark, blobs, monkeypatch, tmp_path):
    df, x = blobs
    monkeypatch.setattr(lineage, "checkpoint_folder", lambda spark: str(tmp_path))
    labelled = kmeans.assign_all(df, "features", [kmeans.KMeansModel(2, x[:2], 0.0, 0, 0)])
    silhouette.silhouettes(labelled, "features", "labels", "euclidean")
    assert not list(tmp_path.iterdir())


def test_seed_stability(blobs):
    df, _ = blobs
    model = kmeans.fit_kmeans(df, "features", [4], 3)[4]
    s = seed_stability("T", df, kmeans.assign_clusters(df, "features", model), starts=3)
    row = s.summary.first()
    assert (row["ari"], row["n_clusters"], row["n_samples"]) == (1.0, 4, 580)
    assert {r["delta"] for r in s.sizes.collect()} == {0} and s.comparison.count() == 580


def test_encodings(spark, monkeypatch):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 3.0, 1.0), (None, None, None), ("c", 5.0, 2.0)],
                               "k string, x double, is_f double")
    codes = lambda: {r["k"]: r["k_code"] for r in encode.ordinal_codes(df, "k").collect()}
    assert codes() == {"a": 0, "b": 1, "c": 2, None: -1}
    monkeypatch.setattr(encode, "SMALL_ROWS", 1)
    assert codes() == {"a": 0, "b": 1, "c": 2, None: -1}
    hot = encode.one_hot_drop_first(df.select("k"), ["k"]).collect()
    assert [tuple(r) for r in hot] == [(1, 0), (0, 0), (0, 0), (0, 1)] and hot[0].__fields__ == ["k_b", "k_c"]
    x = np.array([1, 3, 0, 5.0])
    got = [r["x"] for r in encode.zscore(df, ["x"]).collect()]
    assert got == pytest.approx((x - x.mean()) / x.std())
    skip = [r["x"] for r in encode.zscore(df, ["x"], ddof=1, null_as_zero=False).collect()]
    assert skip == [-1.0, 0.0, None, 1.0]
    assert [r["is_f"] for r in encode.flag_fill(df).collect()] == [0, 1, 0, 2]


def test_row_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(7)
    rows = encode.with_row_index(df, ["v"]).collect()
    assert len(rows) == 1000 and all(r["v"] == r["customer_index"] for r in rows)
    assert encode.with_row_index(df.filter("v < 0"), ["v"]).count() == 0


def test_projection_matches_svd(spark, blobs):
    df, x = blobs
    flat = df.selectExpr("customer_id", "features[0] AS a", "features[1] AS b", "features[2] AS c")
    got = np.array([[r["pc1"], r["pc2"]] for r in encode.pca_projection(flat, "customer_id", ["a", "b", "c"])
                    .orderBy("customer_id").collect()])
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2].T
    assert np.abs(got) == pytest.approx(np.abs(want[:, :2]), abs=1e-8)


def test_packed_rows_give_the_same_sums_and_ties_go_to_the_first_centre(blobs):
    df, x = blobs
    models = [x[:3], np.array([[0.0, 0, 0], [2.0, 0, 0], [0.0, 0, 0]])]
    plain = kmeans._pass(df, "features", models, len(x), 6)
    packed = kmeans._pass(kmeans.packed_rows(df, "features"), "p", models, len(x), 6)
    assert all(np.allclose(a, b) for a, b in zip(plain, packed))
    square = ((x[:, None] - np.concatenate(models)[None]) ** 2).sum(axis=2)
    for lo in (0, 3):
        label = square[:, lo:lo + 3].argmin(axis=1)
        assert (plain[0][lo:lo + 3] == np.bincount(label, minlength=3)).all()
        assert plain[1][lo:lo + 3].sum() == pytest.approx(square[:, lo:lo + 3].min(axis=1).sum())
    assert plain[0][5] == 0
    ties = kmeans._pass(df.limit(0).union(df.sparkSession.createDataFrame([(1, [1.0, 0.0, 0.0])], df.schema)), "features", [models[1]], 1, 2)
    assert list(ties[0]) == [1, 0, 0] and list(ties[1]) == [1, 0, 0]


def test_little_work_takes_few_tasks_and_much_work_whole_rounds():
    assert kmeans._tasks(90_000, 100, 12) == 1
    assert kmeans._tasks(90_000, 15_000, 12) % 12 == 0
    assert kmeans._tasks(10 ** 9, 15_000, 12) % 12 == 0


def test_linear_silhouette_does_not_shuffle_points(spark, blobs, monkeypatch):
    df, x = blobs
    seen = []
    inner = silhouette._squared
    monkeypatch.setattr(silhouette, "_squared", lambda points, *rest: seen.append(points._jdf.queryExecution().optimizedPlan().toString()) or inner(points, *rest))
    labelled = kmeans.assign_all(df, "features", [kmeans.KMeansModel(2, x[:2], 0.0, 0, 0)])
    silhouette.silhouettes(labelled, "features", "labels")
    assert seen and "Aggregate" not in seen[0]


def test_a_fit_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    x = np.random.default_rng(5).normal(size=(60, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "customer_id long, features array<double>")
    kmeans.fit_kmeans(df.mapInArrow(counted, df.schema), "features", [3], 2)
    assert read.value == 60
