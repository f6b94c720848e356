"""Rules that results hang on, held against worked cases or plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import naming
from corvane.operators import curate, geometry, insight, reduce, results, split
from corvane.session import checkpointed
from corvane.sources import sequences, tables

TEXT_ID = "id string, v array<double>, label int"


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_text_ids_meet_ties_by_the_smaller(spark):
    rows = [("seq_2", [1.0, 0.0], 1), ("seq_10", [1.0, 0.0], 0), ("seq_3", [0.9, 0.1], 1), ("bad", [float("nan"), 1.0], 0), ("none", None, 1), ("hole", [None, 1.0], 1)]
    train = spark.createDataFrame(rows, TEXT_ID)
    test = spark.createDataFrame([("t1", [1.0, 0.0], 1), ("t2", [float("inf"), 0.0], 1)], TEXT_ID)
    assert [(r.key, r.nearest_key, round(r.value, 9)) for r in geometry.nearest(test, train, "id", "v").collect()] == [("t1", "seq_10", 1.0)]
    found = geometry.nearest(test, train, "id", "v", "euclidean").collect()
    assert [(r.key, r.nearest_key, r.value) for r in found] == [("t1", "seq_10", 0.0)]
    close = geometry.pairs(train, "id", "v", where=(">=", 0.9))
    assert {(r.key_a, r.key_b) for r in close.collect()} == {("seq_10", "seq_2"), ("seq_10", "seq_3"), ("seq_2", "seq_3")}
    for removed in (reduce.one_pass(close), reduce.greedy(close, checkpointed)):
        assert {(r.removed_id, r.representative_id) for r in removed.collect()} == {("seq_2", "seq_10"), ("seq_3", "seq_10")}
    assert geometry.knn_vote(test, train, "id", "v", "label", 2).collect()[0].score == 0.5


def test_the_closest_representative_of_distances(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [0.3]), (3, [0.4])], "id int, v array<double>")
    close = geometry.pairs(points, "id", "v", "euclidean", where=("<=", 0.45))
    assert {(r.removed_id, r.representative_id) for r in reduce.one_pass(close, distance=True).collect()} == {(2, 1), (3, 2)}
    assert {(r.removed_id, r.representative_id) for r in reduce.greedy(close, checkpointed, distance=True).collect()} == {(2, 1), (3, 1)}


def sequential(x: np.ndarray, close) -> dict[int, int]:
    """Removed row to its closest kept earlier one, row by row."""
    kept, gone = [], {}
    for i in range(len(x)):
        near = [(close(x[i], x[j]), j) for j in kept]
        near = [(round(v, 9), j) for v, j in near if v is not None]
        if near:
            gone[i] = min(near)[1]
        else:
            kept.append(i)
    return gone


def test_a_ladder_of_greedy_reductions(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) * 0.2))
    df = spark.createDataFrame([(f"seq_{i:03d}", v.tolist(), i % 2) for i, v in enumerate(x)], TEXT_ID)
    ladder = [(90.0, 0.2), (30.0, 1.5), (60.0, 0.7)]
    maps, summary = reduce.reduction_ladder(df, "id", "v", "label", ladder, checkpointed, "euclidean")
    for percent, limit in ladder:
        gone = sequential(x, lambda a, b, limit=limit: d if (d := float(np.linalg.norm(a - b))) <= limit else None)
        assert {r.removed_id: r.representative_id for r in maps.where(F.col("percentile") == percent).collect()} == {f"seq_{i:03d}": f"seq_{j:03d}" for i, j in gone.items()}
        row = summary.where(F.col("percentile") == percent).first()
        assert (row.n_original, row.n_reduced, row.threshold) == (120, 120 - len(gone), limit)
        assert (row.n_0, row.n_1) == tuple(sum(1 for i in range(120) if i not in gone and i % 2 == y) for y in (0, 1))
    with pytest.raises(ValueError):
        reduce.reduction_ladder(df, "id", "v", "label", [(30.0, 0.2), (60.0, 0.7)], checkpointed, "euclidean")


def test_long_chains_of_decisions_end(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "key_a int, key_b int, value double")
    assert {r.removed_id for r in reduce.greedy(links, checkpointed).collect()} == set(range(1, 41, 2))
    assert reduce.greedy(links.where("key_a < 0"), checkpointed).collect() == []


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(geometry, "FEW", 5)
    monkeypatch.setattr(geometry, "BINS", 7)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 50), "c": np.array([3.0]), None: np.exp(rng.normal(size=77) * 9)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None)], "g string, x double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = geometry.quantiles(df, "x", shares, ["g"])
    assert set(got) == {(g,) for g in groups}
    for g, x in groups.items():
        assert got[(g,)] == pytest.approx(np.quantile(x, shares).tolist())
    assert values(geometry.percentile_ladder(df.where("g = 'none'"), "x", [50.0]), "threshold") == [None]


def test_high_support_is_three_sources_or_more(spark):
    row = curate.support_summary(spark.createDataFrame([(n,) for n in (1, 1, 2, 3, 4, 6, 9)], "n int"), "n").first()
    assert (row.n_total, row.n_single, row.n_multi, row.n_high) == (7, 2, 5, 4)


def test_labels_are_recovered_only_where_lost(spark):
    original = spark.createDataFrame([("a", "AA", 1, 2), ("a", "AA", 0, 1), ("b", "BB", 1, 3), (None, "CC", 1, 4)], "id string, sequence string, label int, n int")
    there, missing = curate.recovered_labels(spark.createDataFrame([("a", 7), ("z", None)], "id string, label int"), original, "label", ["id", "sequence"])
    assert {(r.id, r.label) for r in there.collect()} == {("a", 7), ("z", None)} and missing.first().n_missing == 1
    by_id, missing = curate.recovered_labels(spark.createDataFrame([("a", "BB"), ("z", "BB"), (None, "CC")], "id string, sequence string"), original, "label", ["id", "sequence"], ["n"])
    assert {(r.id, r.label) for r in by_id.collect()} == {("a", 0), ("z", None), (None, None)} and tuple(missing.first()) == (3, 2)
    by_text, _ = curate.recovered_labels(spark.createDataFrame([("BB",), ("XX",)], "sequence string"), original, "label", ["id", "sequence"])
    assert {(r.sequence, r.label) for r in by_text.collect()} == {("BB", 1), ("XX", None)}
    with pytest.raises(ValueError):
        curate.recovered_labels(spark.createDataFrame([(1,)], "x int"), original, "label", ["id", "sequence"])


def test_the_last_name_counts(spark):
    names = spark.createDataFrame([(0, "Gene", "zzz"), (1, " gene ", "bbb"), (2, "other", "c"), (3, "OTHER", None)], "n int, name string, s string")
    got = curate.mapped_by_name(spark.createDataFrame([("GENE",), ("Other",), ("x",)], "g string"), names, "g", "name", "s", "sequence", "n")
    assert {(r.g, r.sequence) for r in got.collect()} == {("GENE", "bbb"), ("Other", None), ("x", None)}


def test_pairs_are_compared_by_the_bootstrap(spark):
    rng = np.random.default_rng(3)
    x = {("a", "b"): rng.normal(0.3, 1, 40), ("a", "c"): rng.normal(2, 0.1, 25), ("b", "c"): np.array([-0.5]), ("c", "d"): np.array([])}
    rows = [(*k, float(v)) for k, own in x.items() for v in own] + [("c", "d", None)]
    got = {(r["first"], r["second"]): r for r in insight.compared_pairs(spark.createDataFrame(rows, "first string, second string, difference double")).collect()}
    assert set(got) == {k for k, own in x.items() if len(own)}
    for k, own in x.items():
        if not len(own):
            continue
        r, draws = got[k], np.random.default_rng(123)
        means = [own[draws.integers(0, len(own), len(own))].mean() for _ in range(2000)] if len(own) > 1 else [own[0]]
        low, high = np.percentile(means, [2.5, 97.5])
        assert (r.ci_low, r.ci_high) == pytest.approx((low, high)) and r.ci_crosses_zero == (low <= 0 <= high)
        assert r.first_higher == (own.mean() > 0) and r["std"] == pytest.approx(own.std(ddof=1) if len(own) > 1 else 0.0)


def test_repeated_identities_are_no_master(spark):
    one = spark.createDataFrame([(1, 0.5), (2, 0.6)], "id int, x double")
    new = spark.createDataFrame([(2, 0.9)], "id int, x double")
    assert {(r.id, r.x, r.origin) for r in results.corrected_master(one, new, ["id"]).collect()} == {(1, 0.5, "original"), (2, 0.9, "replacement")}
    for a, b in ((one.union(one), new), (one, new.union(new))):
        with pytest.raises(ValueError):
            results.corrected_master(a, b, ["id"])


def test_numbers_of_any_length_in_names(spark):
    names = ["p9", "p10", "p009", "p" + "1" * 25, "p" + "1" * 24 + "2", "p" + "9" * 30, "q1", "p1x2", "p1x10", "", "7"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", naming.natural_key(F.col("n")))
    keys = {r.n: r.k for r in df.collect()}
    assert keys["p9"] == keys["p009"] and len(set(keys.values())) == len(names) - 1
    assert sorted((n for n in names if n.startswith("p") and "x" not in n and n != "p009"), key=lambda n: int(n[1:])) == sorted((n for n in names if n.startswith("p") and "x" not in n and n != "p009"), key=keys.get)
    assert keys["p1x2"] < keys["p1x10"] < keys["p9"]
    got = spark.createDataFrame([("p12345678901234",), ("p90_5",), ("0.7",), ("100",)], "t string").select(naming.normal_threshold(F.col("t")).alias("x"))
    assert values(got) == ["p12345678901234", "p90_5", "p70", "p100"]


def test_reasons_read_as_they_should(spark):
    raw = {
        "log ERROR:  Unknown parameters for DistanceAwareKFoldSplitter: ['feature_prefix']": "Distance-aware split failed because params_split.yaml contains unsupported parameter(s) ['feature_prefix']. For descriptor-based splits, use 'descriptor_prefix' instead of 'feature_prefix'.",
        "Unknown parameters for DistanceAwareKFoldSplitter, sorry": "Distance-aware split failed because params_split.yaml contains unsupported parameter(s) one or more parameters. For descriptor-based splits, use 'descriptor_prefix' instead of 'feature_prefix'.",
        "x ids_path not found y": naming.NO_ARRAYS + "x ids_path not found y",
        "fold has only\n1 class(es)": naming.FEW_CLASSES + "fold has only 1 class(es)",
        "Invalid split input: ids_path not found": "Invalid split input: ids_path not found",
        "anything  else": "anything else",
    }
    df = spark.createDataFrame([(k,) for k in raw], "r string").select("r", naming.clean_reason(F.col("r")).alias("x"))
    assert {r.r: r.x for r in df.collect()} == raw


def test_nothing_of_a_source_is_cut(spark):
    wide = tables.wide_features(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "id int, features array<double>"))
    assert {(r.id, r.p_0, r.p_1) for r in wide.collect()} == {(1, 1.0, None), (2, 1.0, 2.0), (3, None, None)}
    head = ">" + "h" * 1_500_000
    lines = spark.createDataFrame([("f", 0, head), ("f", 1, "ACD")], "file string, n int, line string")
    assert [(len(r.id), r.sequence) for r in sequences.running_headers(lines, "file", "n", "line").collect()] == [(1_500_000, "ACD")]


def test_failed_fetches_say_why(spark):
    def fetch(key):
        if key == "down":
            raise OSError("no route")
        return None if key == "empty" else key.upper()

    got = tables.fetched(spark.createDataFrame([("a",), ("down",), ("empty",)], "id string"), "id", fetch, at_once=1).collect()
    assert {(r.id, r.content, r.error) for r in got} == {("a", "A", None), ("down", "", "OSError: no route"), ("empty", "", None)}


@pytest.mark.parametrize("metric, standardize", [("euclidean", False), ("cosine", False), ("euclidean", True)])
def test_distance_folds_cut_the_order_of_distances(spark, metric, standardize):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4)) * [1, 2, 3, 30]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {r.id: r.fold for r in split.distance_folds(df, "id", "v", 1, 5, metric, standardize).collect()}
    y = (x - x.mean(0)) / x.std(0) if standardize else x
    c = y.mean(0)
    far = np.linalg.norm(y - c, axis=1) if metric == "euclidean" else 1 - y @ c / np.linalg.norm(y, axis=1) / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else np.zeros(50)
    assert [got[i] for i in np.argsort(far, kind="stable")] == [k // 10 for k in range(50)]


def test_repeated_texts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), (None, "x")], "text string, source string")
    assert {(r.text, r.n_duplicates, tuple(r.labels)) for r in curate.repeated_texts(df, "text", "source").collect()} == {("a", 2, ("x", "y")), (None, 2, ("x",))}


def test_draws_by_key(spark):
    """Poisson numbers, alike for no two resamples or rows; intervals as wide as the deviation says, however rows are dealt out."""
    rng = np.random.default_rng(1)
    w = insight.draws(rng.integers(0, 1 << 52, 400), np.arange(2000), 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01
    # rows whose keys follow one another
    assert abs(np.corrcoef((v := insight.draws(np.arange(400), np.arange(2000), 7))[:-1].ravel(), v[1:].ravel())[0, 1]) < 0.01
    x = rng.normal(0.3, 1, 300)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 2.0), ("c", 0, None), (None, 1, 1.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {r.g: r for r in insight.bootstrap_ci(df.repartition(5), ["g"], "x", key=["i"]).collect()}
    again = {r.g: r for r in insight.bootstrap_ci(df.coalesce(1), ["g"], "x", key=["i"]).collect()}
    assert set(got) == {"a", "b", None} and (got["b"].low, got["b"].high, got["b"].n) == (2.0, 2.0, 1)
    assert got["a"].low == pytest.approx(again["a"].low) and got["a"].estimate == pytest.approx(x.mean())
    half = 1.96 * x.std(ddof=1) / np.sqrt(300)
    assert got["a"].low == pytest.approx(x.mean() - half, abs=0.15 * half) and got["a"].high == pytest.approx(x.mean() + half, abs=0.15 * half)
    with pytest.raises(ValueError):
        insight.bootstrap_ci(df, ["g"], "x", statistic=np.median, key=["i"])
