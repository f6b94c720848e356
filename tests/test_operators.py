from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cluster, curate, delta, geometry, insight, reduce, report, results, split, training
from corvane.session import checkpointed


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1), ("c", 1), ("d", None), ("d", 1)], "s string, label int")
    out = curate.duplicates(df, "s", "label")
    assert rows(out["consistent"], "s", "label", "n_duplicates") == [("a", 1, 2)]
    assert rows(out["conflicts"], "s", "labels") == [("b", ["0", "1"]), ("d", ["1"])]
    assert rows(out["unique"], "s", "label") == [("c", 1)]


def test_consensus(spark):
    df = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 1, 2), ("a", "z", None, 3), ("b", "x", 0, 4), ("b", "y", 1, 5), ("c", "x", 0, 6), ("c", "x", 1, 7)], "s string, source string, label int, n int")
    out = curate.consensus(curate.votes(df, "s", "source", "label", "n"))
    assert {r.s: (r.label, r.n_valid_sources) for r in out.collect()} == {"a": (1, 2), "b": (None, 2), "c": (0, 1)}
    wide = {r.s: (r.x, r.y, r.z) for r in curate.source_pivot(df, "s", "source", "label", "n", ["x", "y", "z"]).collect()}
    assert wide == {"a": (1, 1, 999), "b": (0, 1, 999), "c": (0, 999, 999)}


def test_sequential_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = {r.k: r.id for r in curate.sequential_ids(df, ["k"], "x").collect()}
    assert got == {k: f"seq_x_{k + 1}" for k in range(1000)}


def test_paired_delta(spark):
    df = spark.createDataFrame([(1, "base", None, 0.0), (1, "new", None, 0.5), (2, "base", "k", 0.4), (2, "base", "k", 0.6), (2, "new", "k", 0.25), (3, "new", "k", 1.0)], "seed int, kind string, key string, m double")
    out = delta.paired_delta(df, F.col("kind") == "base", F.col("kind") == "new", ["seed", "key", "absent"], ["kind"], ["m"], "c")
    got = {r.seed: (r.delta__m, r.loss__m, r.retention__m, r.key) for r in out.collect()}
    assert got == {"1": (0.5, -0.5, None, "not_applicable"), "2": (-0.25, 0.25, 0.5, "k")}


def test_reference_delta_matches_missing_keys_and_fans_out(spark):
    df = spark.createDataFrame([(None, "r", 1.0), (None, "r", 2.0), (None, "c", 5.0)], "k string, kind string, m double")
    out = delta.reference_delta(df, F.col("kind") == "r", ["k"], "m", F.col("kind") == "c")
    assert rows(out, "delta_m") == [(3.0,), (4.0,)]


def test_decision_ranking(spark):
    made = [("x", g, s, b, b + d) for g, b, d in (("p", 0.5, -0.1), ("q", 0.9, -0.1), ("r", 0.8, -0.3)) for s in range(3)] + [("y", "p", 0, 0.5, 0.4)]
    df = spark.createDataFrame(made, "ctx string, g string, seed int, m__baseline double, m__candidate double")
    df = df.withColumns({"delta__m": F.col("m__candidate") - F.col("m__baseline"), "loss__m": F.col("m__baseline") - F.col("m__candidate"), "retention__m": F.col("m__candidate") / F.col("m__baseline")})
    out = {(r.ctx, r.g): r for r in delta.decision_ranking(df, ["ctx", "g"], "m", context=["ctx"], min_pairs=2).collect()}
    assert [out["x", g].rank_by_lowest_loss for g in "qpr"] == [1, 2, 3]
    assert [out["x", g].decision_rank for g in "qpr"] == [1, None, 2]
    y = out["y", "p"]
    assert (y.rank_by_lowest_loss, y.decision_rank, y.decision_class, y.performance_threshold) == (None, None, "Insufficient pairs", None)
    assert out["x", "p"].n_seeds == 3 and out["x", "p"].delta_std__m == pytest.approx(0)
    fixed = delta.decision_ranking(df, ["ctx", "g"], "m", context=["ctx"], min_pairs=2, performance=0.7).collect()
    assert {r.g for r in fixed if r.decision_rank} == {"q"}


def vectors_of(spark, n=60, d=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)], "id long, v array<double>, label int")


def test_pairs_and_nearest(spark):
    x, df = vectors_of(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.key_a, r.key_b): (r.value, r.same_label) for r in geometry.pairs(df, "id", "v", "cosine", label="label", block=16).collect()}
    assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert all(v == pytest.approx(float(unit[i] @ unit[j])) and s == (i % 3 == j % 3) for (i, j), (v, s) in got.items())
    far = geometry.pairs(df, "id", "v", "euclidean", where=("<=", 2.0), block=16).collect()
    assert {(r.key_a, r.key_b) for r in far} == {(i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(x[i] - x[j]) <= 2.0}
    near = {r.key: (r.nearest_key, r.value) for r in geometry.nearest(df.where("id < 20"), df.where("id >= 20"), "id", "v", block=16).collect()}
    best = unit[:20] @ unit[20:].T
    assert all(k == 20 + best[i].argmax() and v == pytest.approx(best[i].max()) for i, (k, v) in near.items()) and len(near) == 20
    with pytest.raises(ValueError):
        geometry.checked(df.unionByName(df.limit(1)), "id", "v")


def test_greedy_is_the_sequential_rule(spark):
    x, df = vectors_of(spark, 80, 3)
    close = geometry.pairs(df, "id", "v", "cosine", where=(">=", 0.6), block=32).select("key_a", "key_b", "value")
    removed = {r.removed_id: r.representative_id for r in reduce.greedy(close, checkpointed).collect()}
    unit, kept = x / np.linalg.norm(x, axis=1, keepdims=True), []
    for i in range(80):
        if not any(unit[i] @ unit[j] >= 0.6 for j in kept):
            kept.append(i)
    assert set(range(80)) - set(removed) == set(kept) and set(removed.values()) <= set(kept)
    assert len({r.removed_id for r in reduce.one_pass(close).collect()}) >= len(removed)


def test_bisection():
    calls = []
    at, history = reduce.matched_threshold(lambda t: calls.append(t) or int(t * 1000), 0.0, 1.0, 700, within=5)
    assert abs(int(at * 1000) - 700) <= 5 and len(history) == len(calls) <= 16


def test_clusters(spark):
    ids = spark.createDataFrame([(i,) for i in "1234"], "id string")
    removed = spark.createDataFrame([("2", "1", "k")], "removed_id string, representative_id string, cluster_id string")
    assert rows(cluster.assignments(ids, removed, "m"), "id", "cluster_id", "is_representative") == [("1", "k", True), ("2", "k", False), ("3", "3", True), ("4", "4", True)]
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1)], "id string, ref int, cand int")
    r = cluster.agreement(df, "ref", "cand").first()
    assert (r.shared_pairs, r.reference_pairs, r.candidate_pairs) == (1, 1, 3) and (r.precision, r.recall, r.f1, r.jaccard) == pytest.approx((1 / 3, 1, 0.5, 1 / 3))
    same = cluster.agreement(df, "ref", "ref").first()
    assert (same.adjusted_rand, same.normalized_mutual_info, same.f1) == pytest.approx((1, 1, 1))


def test_folds(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(103)], "id int, label boolean")
    for label in (None, "label"):
        folds = split.kfold(df, "id", 3, 5, label).collect()
        assert len({r.id for r in folds}) == len(folds) == 103 and {r.fold for r in folds} == set(range(5))
        sizes = [sum(r.fold == f for r in folds) for f in range(5)]
        assert max(sizes) - min(sizes) <= (2 if label else 1)
    parts = split.assignments(split.kfold(df, "id", 3, 5, "label"), "id", 5, 3)
    each = parts.groupBy("fold").pivot("part", ["train", "val", "test"]).count().collect()
    assert all(r.train + r.val + r.test == 103 for r in each)
    assert parts.where("part = 'test'").groupBy("id").count().where("count <> 1").count() == 0
    assert split.validate(parts, "label", 5).where("status <> 'kept'").count() == 0
    assert split.validate(parts.where("fold <> 2"), "label", 5).where("status <> 'kept'").count() == 3
    bad = spark.createDataFrame([(1, 1), (2, 1)], "id int, label int")
    assert split.precheck(bad, "label", 5).first().reason == "single_class"
    assert split.precheck(bad.limit(0), "label", 5).first().reason == "empty_input"


def test_distance_folds_lie_apart(spark):
    x, df = vectors_of(spark, 200, 2, 5)
    out = {r.id: r.fold for r in split.distance_folds(df, "id", "v", 1).collect()}
    assert sorted(out) == list(range(200)) and [list(out.values()).count(f) for f in range(5)] == [40] * 5
    far = np.linalg.norm(x - x.mean(0), axis=1)
    assert all(far[[i for i in out if out[i] == f]].max() <= far[[i for i in out if out[i] == f + 1]].min() + 1e-6 for f in range(4))


def test_insight(spark):
    df = spark.createDataFrame([("g", float(v), 0.0) for v in (1, 2, 3, 4, 100)], "g string, d double, b double")
    out = insight.outliers(df, ["g"], "d")
    assert rows(out, "d", "lower_bound", "upper_bound", "outlier_type") == [(100.0, -1.0, 7.0, "high")]
    assert insight.positive_outliers(out, ["g"], "d", "b").first().n_zero_baseline == 1
    assert insight.bootstrap(np.array([3.0])) == (3.0, 3.0) and np.isnan(insight.bootstrap(np.array([]))[0])
    low, high = insight.bootstrap(np.arange(50.0))
    assert low < 24.5 < high
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "x")], "k int, s string")
    assert rows(insight.venn3(sets, "k", F.col("s") == "a", F.col("s") == "b", F.col("s") == "c"), "region", "n") == [("AB", 1), ("C", 1)]


def test_results(spark):
    df = spark.createDataFrame([("u", "10", 0.5, 0.1), ("u", "9", 0.5, 0.2), ("u", "x", 0.5, 0.3), ("u", "1", None, 0.9)], "unit string, cfg string, val double, test double")
    assert results.best_per_fold(df, ["unit"], "cfg", "val", "test").first().cfg == "9"
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9, "n"), (None, 8, "n")], "k string, v int, note string")
    got = sorted((r.k or "", r.v, r.origin, r.note) for r in results.corrected_master(base, new, ["k"]).collect())
    assert got == [("", 8, "replacement", "n"), ("a", 9, "replacement", "n"), ("b", 2, "original", None)]
    h = results.histogram(spark.createDataFrame([(0.5,), (1.0,)], "x double"), F.col("x"), 0.0, 1.0, bins=10).collect()
    assert sum(r.n for r in h) == 2 and len(h) == 10 and max(r.density for r in h) == 1.0


def test_training(spark):
    x, df = vectors_of(spark, 120, 4, 9)
    got = np.array([r.v for r in training.scaled(df, "v", "standard").orderBy("id").collect()])
    assert got == pytest.approx((x - x.mean(0)) / x.std(0))
    l2 = np.array([r.v for r in training.scaled(df, "v", "l2").orderBy("id").collect()])
    assert np.linalg.norm(l2, axis=1) == pytest.approx(np.ones(120))
    q = np.array([r.v for r in training.scaled(df, "v", "quantile").collect()])
    assert q.min() >= 0 and q.max() <= 1
    linear = df.withColumn("label", (F.get("v", F.lit(0)) > 0).cast("int")).withColumn("part", F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train"))
    done, failed = training.evaluated(linear, "v", "label", 0, [{"algorithm": "LogisticRegression", "params": {"maxIter": 20}}, {"algorithm": "Unknown"}], "standard")
    assert done[0]["mcc_test"] > 0.6 and failed[0]["cfg_idx"] == 1
    assert len(training.configurations({"a": {"x": [1, 2], "y": [3]}, "b": {}})) == 3


def test_reports(spark):
    summary = spark.createDataFrame([(0.3, 50.0), (0.9, 100.0)], "threshold double, kept_frac double")
    got = rows(report.reduction_summary(summary, "x", "homology"), "parameter_type", "parameter_value", "retained_fraction", "removed_percent")
    assert got == [("min_seq_id", 0.3, 0.5, 50.0), ("min_seq_id", 0.9, 1.0, 0.0)]
    with pytest.raises(ValueError):
        report.reduction_summary(summary.drop("kept_frac"), "x", "homology")
    df = spark.createDataFrame([(1, "3", 3), (1, "3.0", 3), (2, "4", 5), (2, None, 5)], "k int, seed string, path_seed int")
    assert tuple(report.disagreements(df, {"seed": "path_seed"}).first()) == (1,)
    with pytest.raises(ValueError):
        report.one_to_many(df, df, ["k"])
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert report.one_to_many(one, df, ["k"]).count() == 4 and report.one_to_one(one, one, ["k"]).count() == 2
    with pytest.raises(ValueError):
        report.side_by_side(one, one.limit(1), "k")
    with pytest.raises(ValueError):
        report.rows_of(one.where("k = 1"), "k", one)
    assert report.evaluation_unit(spark.createDataFrame([("r", None)], "representation string, seed int")).first().evaluation_unit == "r|nan"
    assert report.test_rows(one).count() == 2 and report.as_metric(one).columns == ["k", "v"]
    ladder = spark.createDataFrame([("m", 90.0, 453, 250, 203)], "model string, percentile double, n_reduced int, n_0 int, n_1 int")
    assert report.coverage(ladder, 90.0, 4193).first().coverage == pytest.approx(453 / 4193)


def test_pairwise_bootstrap_takes_every_resample(spark, monkeypatch):
    import inspect

    from corvane.operators import insight
    from corvane.plans import results as plans

    usual, seen = insight.bootstrap_ci, []
    monkeypatch.setattr(plans, "_top_differences", lambda *_: None)
    monkeypatch.setattr(plans.insight, "bootstrap_ci", lambda *a, **k: seen.append(inspect.signature(usual).bind(*a, **k)))
    plans.pairwise_bootstrap(spark, "")
    seen[0].apply_defaults()
    assert seen[0].arguments["n_boot"] == 2000


def test_quantiles_of_all_kinds_of_numbers(spark, monkeypatch):
    """Exact beside numpy's, by few values at last and by many; a plain column takes two passes."""
    rng = np.random.default_rng(2)
    kinds = {"normal": rng.normal(size=700), "tiny": rng.normal(size=300) * 1e-300, "wide": np.exp(rng.normal(size=400) * 40) * rng.choice([-1, 1], 400), "one": np.full(50, 0.25), "zero": np.r_[np.zeros(40), -np.zeros(3), 1.0, -1.0], "near": 1 + rng.normal(size=500) * 1e-9}
    df = spark.createDataFrame([(k, float(v)) for k, own in kinds.items() for v in own] + [("normal", None), (None, 3.0)], "k string, x double")
    shares = [0, 0.003, 0.25, 0.5, 0.77, 0.999, 1]
    for few in (100_000, 5):
        monkeypatch.setattr(geometry, "FEW", few)
        got = geometry.quantiles(df, "x", shares, ["k"])
        assert set(got) == {(k,) for k in kinds} | {(None,)} and got[None,] == [3.0] * 7
        for k, own in kinds.items():
            assert got[k,] == pytest.approx(list(np.quantile(own, shares)), rel=1e-12, abs=0)
    assert geometry.quantiles(df.limit(0), "x", shares) == {}
