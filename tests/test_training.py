"""Scalers, models and fold-wise training, held against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors
from corvane.operators import geometry, models, reduce, training
from corvane.session import checkpointed
from tests.test_rules import sequential

SCHEMA = "id int, v array<double>, y int"


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 240)
    x = rng.normal(size=(240, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * [2.0, -1.0, 0.5, 0.0]
    return x, y, spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], SCHEMA).cache()


def test_discriminants(spark, clouds):
    x, y, df = clouds
    half = np.arange(240) < 160
    means = [x[half & (y == k)].mean(0) for k in (0, 1)]
    scatter = [np.cov(x[half & (y == k)].T, bias=True) * (half & (y == k)).sum() for k in (0, 1)]
    prior = np.log([(half & (y == k)).sum() / 160 for k in (0, 1)])
    for name, covs in (("LinearDiscriminantAnalysis", [sum(scatter) / 160] * 2), ("QuadraticDiscriminantAnalysis", [s / ((half & (y == k)).sum() - 1) for k, s in enumerate(scatter)])):
        score = np.stack([prior[k] - 0.5 * np.einsum("ij,jk,ik->i", x - means[k], np.linalg.inv(covs[k]), x - means[k]) - 0.5 * np.linalg.slogdet(covs[k])[1] for k in (0, 1)])
        got = {r.id: r.prediction for r in training.fitted(df.where("id < 160"), df.where("id >= 160"), "v", "y", name).collect()}
        assert [got[i] for i in range(160, 240)] == (score[1] > score[0])[160:].astype(int).tolist()
    with pytest.raises(ValueError):
        models.Discriminant(True).fit(df.where("y = 1"), "v", "y")


def test_neighbours(spark, clouds):
    x, y, df = clouds
    for weights in ("uniform", "distance"):
        got = {r.id: r.prediction for r in training.fitted(df.where("id < 160"), df.where("id >= 160"), "v", "y", "KNeighborsClassifier", key="id", k=5, weights=weights).collect()}
        apart = np.linalg.norm(x[160:, None] - x[None, :160], axis=2)
        near = np.argsort(apart, axis=1, kind="stable")[:, :5]
        w = np.ones((80, 5)) if weights == "uniform" else 1 / np.take_along_axis(apart, near, 1)
        assert [got[i] for i in range(160, 240)] == ((w * y[near]).sum(1) * 2 > w.sum(1)).astype(int).tolist()


def test_one_search_serves_all_folds_and_configurations(spark, clouds, monkeypatch):
    """Neighbours of the same metric and scaler are searched once, whatever the number of configurations, with the results that each has alone."""
    _, _, df = clouds
    rows = df.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.when(F.col("id") % 2 == F.col("fold"), "test").when(F.col("id") % 5 == 0, "val").otherwise("train"))
    configurations = training.configurations({"KNeighborsClassifier": {"n_neighbors": [1, 4, 7], "metric": ["cosine"], "weights": ["uniform", "distance"]}})
    searches, tiles = [], geometry.over_tiles
    monkeypatch.setattr(geometry, "over_tiles", lambda *args, **more: searches.append(1) or tiles(*args, **more))
    done, failed = training.trained_by_fold(rows, "id", "v", "y", [*configurations, {"algorithm": "KNeighborsClassifier", "params": {"metric": "nonesuch"}}], checkpointed, ["none", "standard"])
    assert len(searches) == 2 and {r.cfg_idx for r in failed.collect()} == {6}
    got = {(r.fold, r.scaler, r.cfg_idx): (r.accuracy_val, r.accuracy_test) for r in done.collect()}
    assert len(got) == 2 * 2 * 6
    for (fold, scaler, at), accuracies in got.items():
        if at not in (1, 4):
            continue
        own, params = rows.where(F.col("fold") == fold), configurations[at]["params"]
        alone = training.fitted(own.where("part = 'train'"), own.where("part <> 'train'"), "v", "y", "KNeighborsClassifier", scaler, "id", k=params["n_neighbors"], metric="cosine", weights=params["weights"])
        share = {r.part: r.a for r in alone.groupBy("part").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a")).collect()}
        assert accuracies == pytest.approx((share["val"], share["test"]), abs=1e-12)


def test_kernel_models_tell_a_ring_from_its_core(spark):
    rng = np.random.default_rng(0)
    angle, r = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 3.0, 0.5) + rng.normal(scale=0.2, size=300)
    df = spark.createDataFrame([(i, [float(a), float(b)], i % 2) for i, (a, b) in enumerate(zip(r * np.cos(angle), r * np.sin(angle), strict=True))], SCHEMA)
    for name in ("SVC", "GaussianProcessClassifier"):
        out = training.fitted(df.where("id < 200"), df.where("id >= 200"), "v", "y", name, regParam=1e-3, maxIter=30)
        assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.95


def test_every_model_of_the_grid_trains(spark, clouds):
    _, _, df = clouds
    rows = df.withColumns({"fold": F.lit(0), "part": F.when(F.col("id") < 150, "train").when(F.col("id") < 190, "val").otherwise("test")})
    settings = {"RandomForestClassifier": {"n_estimators": 5, "max_depth": None, "bootstrap": True, "n_jobs": 8}, "HistGradientBoostingClassifier": {"max_iter": 3, "learning_rate": 0.1}, "LogisticRegression": {"C": 1.0, "penalty": "l2", "max_iter": 20}, "ExtraTreesClassifier": {"n_estimators": 5}, "BaggingClassifier": {"n_estimators": 3, "max_samples": 0.8}, "XGBClassifier": {"n_estimators": 3, "max_depth": 3}, "LGBMClassifier": {"n_estimators": 3}, "LinearSVC": {"C": 1.0}, "MLPClassifier": {}}
    configurations = [{"algorithm": a, "params": settings.get(a, {})} for a in models.PARAMETERS if a not in ("MLPClassifier", "GradientBoostingClassifier")]
    done, failed = training.trained_by_fold(rows, "id", "v", "y", [*configurations, {"algorithm": "Nonesuch"}, {"algorithm": "SVC", "params": {"gamma": "wrong"}}], checkpointed, ["standard"], seed=3)
    assert {r.algorithm for r in failed.collect()} == {"Nonesuch", "SVC"} and len(configurations) == 16
    got = {r.algorithm: r for r in done.collect()}
    assert set(got) == {c["algorithm"] for c in configurations} and all((r.n_train, r.n_val, r.n_test, r.n_features, r.seed) == (150, 40, 50, 4, 3) for r in got.values())
    assert all(0.6 < r.accuracy_test <= 1 for r in got.values())
    assert models.unused("RandomForestClassifier", settings["RandomForestClassifier"]) == ["n_jobs"]
    with pytest.raises(RuntimeError):
        training.trained_by_fold(rows, "id", "v", "y", [{"algorithm": "Nonesuch"}], checkpointed)


def test_grids():
    document = {"param_grids": {"SVC": [{"C": 1}, {"C": 2}], "KNN": {"k": [1, 2], "w": ["a"]}}}
    assert training.grids(document, "SVC") == [{"algorithm": "SVC", "params": {"C": 1}}, {"algorithm": "SVC", "params": {"C": 2}}] and len(training.grids(document)) == 4
    with pytest.raises(ValueError):
        training.grids(document, "LDA")


def test_power_scaling(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([np.exp(rng.normal(size=300)), -np.exp(rng.normal(size=300) * 0.5), rng.normal(size=300)])

    def turned(c, p):
        with np.errstate(all="ignore"):
            return np.where(c >= 0, ((np.abs(c) + 1) ** p - 1) / p, -((np.abs(c) + 1) ** (2 - p) - 1) / (2 - p))

    def fit(c):
        grid = np.arange(-4, 6, 0.001) + 1e-7
        likelihood = [-150 * np.log(turned(c, p).var()) + (p - 1) * (np.sign(c) * np.log1p(np.abs(c))).sum() for p in grid]
        return grid[int(np.argmax(likelihood))]

    expected = np.column_stack([turned(c, fit(c)) for c in x.T])
    expected = (expected - expected.mean(0)) / expected.std(0)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = np.array([r.v for r in training.scaled(df, "v", "power").orderBy("id").collect()])
    assert np.abs(got - expected).max() < 0.02
    assert [r.v for r in training.scaled(df, "v", "normalizer_l2").collect()] == [r.v for r in training.scaled(df, "v", "l2").collect()]


def test_encoders(spark):
    df = spark.createDataFrame([("ACDX",), ("",)], "s string")
    got = [r.x for r in df.select(vectors.physicochemical(F.col("s"), 5).alias("x")).collect()]
    assert got[0] == [1.8, 2.5, -3.5, 0.0, 0.0, 88.6, 108.5, 111.1, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0] and got[1] == [0.0] * 15
    row = df.limit(1).select(vectors.fourier(vectors.property_of(F.col("s"), 5, vectors.HYDROPATHY), 5).alias("x")).first()
    assert row.x == pytest.approx(np.abs(np.fft.rfft([1.8, 2.5, -3.5, 0, 0])).tolist())


def test_the_reduction_that_leaves_so_many(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    for metric in ("euclidean", "cosine"):
        limit, removed, history = reduce.matched_reduction(df, "id", "v", 40, *((0.01, 1.0) if metric == "euclidean" else (0.5, 0.99999)), checkpointed, metric, within=3, steps=12)
        def close(a, b, limit=limit, metric=metric):
            value = float(np.linalg.norm(a - b)) if metric == "euclidean" else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
            return (value if value <= limit else None) if metric == "euclidean" else (-value if value >= limit else None)
        gone = sequential(x, close)
        assert {r.removed_id: r.representative_id for r in removed.collect()} == gone
        rows = [tuple(r) for r in history.collect()]
        assert rows[0][1] == limit and rows[0][2] == 80 - len(gone) and [r[3] for r in rows] == sorted(r[3] for r in rows) and len(rows) <= 12


def test_maps_are_checked_and_summed(spark):
    df = spark.createDataFrame([(f"s{i}", [0.0], i % 2) for i in range(6)], "id string, v array<double>, y int")
    good = spark.createDataFrame([("s1", "s0", "s0"), ("s3", "s2", "s2")], "removed_id string, representative_id string, cluster_id string")
    assert reduce.checked_map(good, df, "id").count() == 2
    for bad in ([("s1", "s0", "s0"), ("s1", "s2", "s2")], [("s9", "s0", "s0")], [("s1", "s0", "s0"), ("s2", "s1", "s1")], [("s1", "s0", None)]):
        with pytest.raises(ValueError):
            reduce.checked_map(spark.createDataFrame(bad, good.schema), df, "id")
    rows = spark.createDataFrame([(0.3, "s1"), (0.3, "s3"), (0.7, "s1"), (0.7, "s1")], "min_seq_id double, removed_id string")
    assert {tuple(r) for r in reduce.homology_rows(rows, df, "id", "y").collect()} == {(0.3, 6, 4, 2, 4 / 6, 3, 1), (0.7, 6, 5, 1, 5 / 6, 3, 2)}


def test_spaces_by_configuration(spark):
    wide = spark.createDataFrame([(" a ", 3.0, 0.0, 4.0, "t"), ("b", 0.0, 1.0, 0.0, "t")], "id string, p_10 double, p_2 double, p_1 double, text string")
    read = lambda spark, path: {"w": wide, "z": wide.withColumn("p_1", F.lit(0.0)).withColumn("p_10", F.lit(0.0)), "n": wide.withColumn("id", F.lit(None).cast("string"))}[path]
    got = geometry.embedding_spaces(spark, {"x": {"path": "w", "prefix": "p_"}, "e": {"path": "w", "metric": "euclidean"}}, read)
    assert {(r.id, tuple(r.features)) for r in got["x"].collect()} == {("a", (0.8, 0.0, 0.6)), ("b", (0.0, 1.0, 0.0))}
    assert {(r.id, tuple(r.features)) for r in got["e"].collect()} == {("a", (4.0, 0.0, 3.0)), ("b", (0.0, 1.0, 0.0))}
    for path in ("z", "n"):
        with pytest.raises(ValueError):
            geometry.embedding_space(spark, {"path": path, "prefix": "p_"}, read)
    ones = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>")
    assert geometry.checked(ones, "id", "v", binary=True).count() == 2
    with pytest.raises(ValueError):
        geometry.checked(ones, "id", "v", binary=True, least_rows=3)


def test_geometry_over_folds(spark):
    found = spark.createDataFrame([("m", 1, 0, 0.9), ("m", 1, 0, 0.5), ("m", 2, 0, 0.8)], "space string, seed int, fold int, value double")
    folds = geometry.fold_geometry(found, ["space", "seed", "fold"])
    assert {(r.seed, r.n_test, round(r.distance_mean, 9), round(r.similarity_mean, 9)) for r in folds.collect()} == {(1, 2, 0.3, 0.7), (2, 1, 0.2, 0.8)}
    r = geometry.geometry_of_folds(folds, ["space"], "seed").first()
    assert (r.n_seeds, r.n_folds, r.n_test, round(r.similarity_mean, 9), r.similarity_maximum) == (2, 2, 3, 0.75, 0.9)
    far = geometry.fold_geometry(found, ["space"], "euclidean").first()
    assert far.similarity_mean is None and round(far.distance_maximum, 9) == 0.9
