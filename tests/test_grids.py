"""Training grids: every parameter is used, replaced and listed, or raised."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import models, training
from corvane.session import checkpointed


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + y[:, None] * [1.5, -1.0, 0.5]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y int").cache()
    return x, y, df


# One configuration of each shape that grids of these models have, with few trees.
GRID = {
    "RandomForestClassifier": [{"n_estimators": 3, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "bootstrap": True, "n_jobs": 8}],
    "DecisionTreeClassifier": [{"max_depth": 30, "min_samples_split": 5, "min_samples_leaf": 2, "criterion": "entropy"}],
    "ExtraTreesClassifier": [{"n_estimators": 3, "max_depth": 30, "min_samples_split": 5, "min_samples_leaf": 1, "n_jobs": 8}],
    "ExtraTreeClassifier": [{"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 2}],
    "BaggingClassifier": [{"n_estimators": 3, "max_samples": 0.5, "max_features": 0.5, "bootstrap": True, "n_jobs": -1}, {"n_estimators": 2, "max_samples": 1.0, "max_features": 1.0, "bootstrap": False}],
    "HistGradientBoostingClassifier": [{"max_iter": 3, "learning_rate": 0.1, "max_depth": None, "max_leaf_nodes": 7, "l2_regularization": 1.0}],
    "XGBClassifier": [{"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.8, "gamma": 0.5, "reg_alpha": 0.1, "reg_lambda": 1.0, "scale_pos_weight": 2, "n_jobs": -1, "random_state": 0, "eval_metric": "logloss"}],
    "LGBMClassifier": [{"n_estimators": 3, "num_leaves": 5, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_samples": 10, "reg_alpha": 0.1, "reg_lambda": 0.5, "class_weight": "balanced", "random_state": 0}],
    "LogisticRegression": [{"C": 0.1, "penalty": "l2", "solver": "lbfgs", "max_iter": 20}],
    "SVC": [{"C": 1.0, "kernel": "rbf", "gamma": "scale"}, {"C": 1.0, "kernel": "linear", "gamma": "scale"}],
    "LinearSVC": [{"C": 1.0, "loss": "hinge", "max_iter": 20}, {"C": 1.0, "loss": "squared_hinge", "max_iter": 50}],
    "KNeighborsClassifier": [{"n_neighbors": 5, "weights": "distance", "p": 2, "n_jobs": 8}],
    "GaussianNB": [{"var_smoothing": 1e-8}],
    "LinearDiscriminantAnalysis": [{"solver": "lsqr", "shrinkage": "auto"}, {"solver": "svd", "shrinkage": None}],
    "QuadraticDiscriminantAnalysis": [{"reg_param": 0.5}],
    "GaussianProcessClassifier": [{"max_iter_predict": 100, "n_restarts_optimizer": 2, "n_jobs": -1}],
    "MLPClassifier": [{"hidden_layer_sizes": [4], "max_iter": 30}],
}
LOST = {
    "RandomForestClassifier": {"min_samples_split,n_jobs,max_depth=20"}, "DecisionTreeClassifier": {"min_samples_split"}, "ExtraTreesClassifier": {"n_jobs"}, "BaggingClassifier": {"n_jobs", ""}, "XGBClassifier": {"eval_metric,n_jobs"},
    "LGBMClassifier": {"subsample=1.0"}, "LogisticRegression": {"solver"}, "KNeighborsClassifier": {"n_jobs"}, "LinearDiscriminantAnalysis": {"solver"}, "GaussianProcessClassifier": {"max_iter_predict,n_jobs,n_restarts_optimizer"},
}


def test_a_grid_of_all_models(spark, clouds):
    _, _, df = clouds
    rows = df.withColumns({"fold": F.lit(0), "part": F.when(F.col("id") < 130, "train").when(F.col("id") < 160, "val").otherwise("test")})
    wrong = [("SVC", {"kernel": "poly"}), ("KNeighborsClassifier", {"metric": "manhattan"}), ("KNeighborsClassifier", {"p": 1}), ("LinearSVC", {"loss": "log"}), ("LogisticRegression", {"penalty": "none?"}), ("LGBMClassifier", {"class_weight": {"1": 2}})]
    every = [*training.grids({"param_grids": GRID}), *({"algorithm": a, "params": p} for a, p in wrong)]
    done, failed = training.trained_by_fold(rows, "id", "v", "y", every, checkpointed)
    assert [r.algorithm for r in failed.collect()] == [a for a, _ in wrong]
    lost: dict[str, set] = {}
    for r in done.collect():
        lost.setdefault(r.algorithm, set()).add(r.lost_params)
        assert 0.55 < r.accuracy_test <= 1, r
    assert lost == {a: LOST.get(a, {""}) for a in GRID}


def test_kernels_differ(spark):
    rng = np.random.default_rng(0)
    angle, r = rng.uniform(0, 2 * np.pi, 200), np.where(np.arange(200) % 2, 3.0, 0.5)
    df = spark.createDataFrame([(i, [float(a), float(b)], i % 2) for i, (a, b) in enumerate(zip(r * np.cos(angle), r * np.sin(angle), strict=True))], "id int, v array<double>, y int")
    right = lambda **how: training.fitted(df, df, "v", "y", "SVC", regParam=1e-3, maxIter=30, **how).where("prediction = y").count()
    assert right(kernel="rbf") > 190 and right(kernel="linear") < 150


def test_squared_hinge_is_at_its_least(spark, clouds):
    x, y, df = clouds
    m = models.SquaredHinge(regParam=1 / 200, tol=1e-6).fit(df, "v", "y")
    v, s = np.hstack([x, np.ones((200, 1))]), np.where(y > 0, 1.0, -1.0)
    assert np.abs(-2 * v.T @ (np.maximum(1 - s * (v @ m.w), 0) * s) / 200 + m.w / 200).max() < 1e-6
    got = {r.id: r.prediction for r in m.predicted(df, "v").collect()}
    assert [got[i] for i in range(200)] == (v @ m.w > 0).astype(int).tolist()


def test_naive_bayes(spark, clouds):
    x, y, df = clouds
    for smoothing in (1e-9, 0.5):
        eps = smoothing * x.var(axis=0).max()
        score = []
        for k in (0, 1):
            own = x[y == k]
            var = own.var(axis=0) + eps
            score.append(np.log(len(own) / 200) - 0.5 * (np.log(2 * np.pi * var) + (x - own.mean(axis=0)) ** 2 / var).sum(axis=1))
        m = models.NaiveBayes(smoothing).fit(df, "v", "y")
        assert np.abs(m.decide(x) - (score[1] - score[0])).max() < 1e-8


def test_estimated_shrinkage(spark, clouds):
    """Against the formula on whole matrices."""
    x, y, df = clouds
    common = np.zeros((3, 3))
    for k in (0, 1):
        own = x[y == k]
        z, n, p = (own - own.mean(0)) / own.std(0), (y == k).sum(), 3
        cov = z.T @ z / n
        mu = np.trace(cov) / p
        delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
        beta = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / n**2 / p
        share = min(beta, delta) / delta
        assert 0 < share < 1
        common += n / 200 * ((1 - share) * cov + share * mu * np.eye(p)) * np.outer(own.std(0), own.std(0))
    m = models.Discriminant(True, "auto").fit(df, "v", "y")
    means = [x[y == k].mean(0) for k in (0, 1)]
    score = [np.log((y == k).mean()) - 0.5 * np.einsum("ij,jk,ik->i", x - means[k], np.linalg.inv(common), x - means[k]) for k in (0, 1)]
    assert np.abs(m.decide(x) - (score[1] - score[0])).max() < 1e-8


def test_linear_models_of_all_folds_at_once(spark, clouds):
    """Each is at its least, and jobs don't grow with configurations."""
    x, y, df = clouds
    folds = df.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).where("id % 3 <> fold")
    settings = [("logistic", 0.02, True, 200, 1e-8), ("squared_hinge", 0.5, True, 200, 1e-8), ("logistic", 1.0, False, 200, 1e-8)]
    m = models.Linear({0: settings, 1: settings}).fit(folds, "v", "y", "fold")
    assert len(m.models) == 6
    for (f, i), w in m.models.items():
        own = np.arange(200) % 3 != f
        v, s = np.hstack([x[own], np.ones((own.sum(), 1))]), np.where(y[own] > 0, 1.0, -1.0)
        loss, penalty, intercept, _, _ = settings[i]
        z = s * (v @ w)
        by_margin = -s / (1 + np.exp(z)) if loss == "logistic" else -2 * s * np.maximum(1 - z, 0)
        slope = v.T @ by_margin / own.sum() + penalty * w * [1, 1, 1, float(loss == "squared_hinge")]
        assert np.abs(slope[: 4 if intercept else 3]).max() < 1e-6 and (intercept or w[-1] == 0)
    rows = df.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.when(F.col("id") % 3 == F.col("fold"), "test").otherwise("train"))

    def jobs(n):
        spark.sparkContext.setJobGroup(f"linear{n}", "")
        grid = [{"algorithm": "LogisticRegression", "params": {"C": 0.1 * (k + 1), "max_iter": 15}} for k in range(n)]
        done, failed = training.trained_by_fold(rows, "id", "v", "y", grid, checkpointed)
        assert failed.count() == 0 and done.count() == 2 * n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"linear{n}"))

    assert jobs(8) <= 1.5 * jobs(2)
