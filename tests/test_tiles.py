"""What tiles of all pairs tell without a table of the pairs, held against that table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import geometry, neighbourhood, reduce
from corvane.session import checkpointed

METRICS = [("cosine", 0.35), ("euclidean", 2.6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(110, 6)), *[[1, 1, 0, 0, 0, 0]] * 5, [0] * 6, [2, 2, 0, 0, 0, 0]]
    some = [(f"k{i * 7 % 131}", [float(a) for a in v], None if i == 3 else i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame([*some, ("none", None, 1), ("nan", [float("nan")] * 6, 1)], "id string, v array<float>, label int").repartition(3).cache()


def near(one, two):
    plain = lambda df: sorted(tuple(round(x, 7) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect())
    return plain(one) == plain(two)


@pytest.mark.parametrize("metric,limit", METRICS)
def test_the_closest_earlier_row(rows, metric, limit):
    pairs = geometry.pairs(rows, "id", "v", metric, where=(">=" if metric == "cosine" else "<=", limit), block=40)
    expected = {(r.removed_id, r.representative_id) for r in reduce.one_pass(pairs, metric != "cosine").collect()}
    found = geometry.closest_earlier(rows, "id", "v", limit, metric, block=40).collect()
    assert {(r.removed_id, r.representative_id) for r in found} == expected and len(found) == len(expected) > 60


@pytest.mark.parametrize("metric,limit", METRICS)
def test_a_tile_tells_a_row_a_vector(rows, metric, limit):
    """However many pairs are close: one tile of 117 vectors."""
    seen = rows.sparkSession.sparkContext.accumulator(0)
    tiles = geometry.over_tiles

    def counted(both, metric, run, schema, *rest, **more):
        def each(a, b, same, group):
            for columns in run(a, b, same, group):
                seen.add(len(columns[0]))
                yield columns

        return tiles(both, metric, each, schema, *rest, **more)

    geometry.over_tiles = counted
    try:
        geometry.closest_earlier(rows, "id", "v", -1.0 if metric == "cosine" else 100.0, metric, block=1000).count()
    finally:
        geometry.over_tiles = tiles
    assert 0 < seen.value <= 117


@pytest.mark.parametrize("metric,limit", METRICS)
@pytest.mark.parametrize("first,degree", [(8192, 32), (20, 0), (20, 6), (20, 1000)])
def test_greedy_by_vectors_is_greedy_by_pairs(rows, monkeypatch, metric, limit, first, degree):
    monkeypatch.setattr(reduce, "FIRST", first)
    monkeypatch.setattr(reduce, "DEGREE", degree)
    pairs = geometry.pairs(rows, "id", "v", metric, where=(">=" if metric == "cosine" else "<=", limit))
    expected = {tuple(r) for r in reduce.greedy(pairs, checkpointed, metric != "cosine").collect()}
    assert {tuple(r) for r in reduce.greedy_of(rows, "id", "v", limit, checkpointed, metric).collect()} == expected and len(expected) > 40


@pytest.mark.parametrize("metric,limit", METRICS)
def test_summaries_and_quantiles(rows, monkeypatch, metric, limit):
    pairs = geometry.pairs(rows, "id", "v", metric, label="label").cache()
    how = {"metric": metric, "block": 40}
    assert near(geometry.pair_summary_of(rows, "id", "v", **how), geometry.pair_summary(pairs, "value"))
    assert near(geometry.pair_thresholds(rows, "id", "v", [0.1, limit], **how), geometry.threshold_counts(pairs, "value", [0.1, limit]))
    for few in (100_000, 3):  # 3: passes until bins are as narrow as values
        monkeypatch.setattr(geometry, "FEW", few)
        assert near(geometry.pair_percentiles(rows, "id", "v", [0.0, 3.3, 50.0, 99.9, 100.0], **how), geometry.percentile_ladder(pairs, "value", [0.0, 3.3, 50.0, 99.9, 100.0]))
    types = pairs.fillna(False, ["same_label"])
    assert near(geometry.pair_types(rows, "id", "v", "label", **how), geometry.pair_type_summary(types, "value"))
    assert geometry.pair_percentiles(rows.limit(0), "id", "v", [50.0]).collect()[0].threshold is None
    assert geometry.pair_summary_of(rows.limit(0), "id", "v").collect()[0].n_pairs == 0


def test_the_nearest_of_another_fold(rows):
    folds = {"one": F.col("label"), "two": F.length("id") % 2}
    found = geometry.nearest_of_other_folds(rows, "id", "v", folds, block=40).collect()
    flat = rows.withColumn("length", F.length("id") % 2)
    for name, fold in (("one", "label"), ("two", "length")):
        for f in (0, 1, 2):
            expected = geometry.nearest(flat.where(f"{fold} = {f}"), flat.where(f"{fold} <> {f}"), "id", "v").collect()
            assert {(r.key, r.nearest_key, round(r.value, 9)) for r in found if r.strategy == name and r.fold == f} == {(r.key, r.nearest_key, round(r.value, 9)) for r in expected}
    assert len(found) == 116 + 117  # one row has no label


def test_scattered_vectors_travel_as_tiles(rows, monkeypatch):
    """Where all cells would be visited, the pairs come from tiles."""
    monkeypatch.setattr(neighbourhood, "VISITS", 0)
    monkeypatch.setattr(neighbourhood, "_met", None)
    got = neighbourhood.close_pairs(rows, "id", "v", 0.35)
    assert near(got, geometry.pairs(rows, "id", "v", where=(">=", 0.35)))


def test_more_than_a_strip(spark):
    """1,300 vectors in one group, against numpy."""
    x = np.random.default_rng(6).normal(size=(1300, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    value, i = unit @ unit.T, np.arange(1300)
    earlier = np.where(i[:, None] < i[None, :], value, -2)
    found = {r.removed_id: r.representative_id for r in geometry.closest_earlier(df, "id", "v", 0.9, block=2000).collect()}
    assert found == {j: earlier[:, j].argmax() for j in range(1300) if earlier[:, j].max() >= 0.9}
    pairs = value[np.triu_indices(1300, 1)]
    got = geometry.pair_quantiles(df, "id", "v", [0.01, 0.5, 0.999], block=2000)[()]
    assert got == pytest.approx(np.quantile(pairs, [0.01, 0.5, 0.999]).tolist(), abs=1e-12)
    assert geometry.pair_summary_of(df, "id", "v", block=2000).first().std == pytest.approx(pairs.std(), abs=1e-12)
    folds = geometry.nearest_of_other_folds(df, "id", "v", {"f": F.col("id") % 5}, block=2000).collect()
    other = np.where(i[:, None] % 5 != i[None, :] % 5, value, -2)
    assert {r.key: r.nearest_key for r in folds} == {j: other[j].argmax() for j in range(1300)}
    gone = {r.removed_id for r in reduce.greedy_of(df, "id", "v", 0.9, checkpointed).collect()}
    kept: list[int] = []
    for j in range(1300):
        if not (value[kept, j] >= 0.9).any():
            kept.append(j)
    assert gone == set(range(1300)) - set(kept)
    near = np.argsort(-other, axis=1, kind="stable")
    votes = geometry.knn_vote(df.where("id % 5 = 0").withColumn("y", F.lit(0)), df.where("id % 5 <> 0").withColumn("y", (F.col("id") % 2).cast("int")), "id", "v", "y", 7, block=2000).collect()
    assert {r.key: round(r.score * 7) for r in votes} == {j: int((near[j, :7] % 2).sum()) for j in range(0, 1300, 5)}


@pytest.mark.parametrize("kind", ["scattered", "huddled", "copies"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_votes_where_single_precision_cannot_tell(spark, kind, metric):
    """Neighbours closer to each other than single precision tells, and equal ones, against numpy; several settings of one search, with by."""
    rng = np.random.default_rng(8)
    x = {"scattered": rng.normal(size=(1500, 6)), "huddled": 1 + 1e-4 * rng.normal(size=(1500, 6)), "copies": np.repeat(rng.normal(size=(15, 6)), 100, axis=0)}[kind]
    i, k = np.arange(1500), 5
    y, test, by = (i // 7) % 2, i % 3 == 0, i % 2
    df = spark.createDataFrame([(int(n), [float(a) for a in v], int(c), int(b)) for n, v, c, b in zip(i, x, y, by, strict=True)], "id long, v array<double>, y int, b int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    square = (x * x).sum(1)
    value = np.einsum("ik,jk->ij", unit, unit) if metric == "cosine" else -np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    value = np.where((by[:, None] == by[None, :]) & ~test[None, :], np.round(value, 12), -np.inf)
    got = geometry.knn_votes(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), "id", "v", "y", [(k, "uniform"), (1, "uniform")], metric, ["b"], block=2000).collect()
    assert {(r.b, r.key) for r in got} == {(int(by[n]), int(n)) for n in i[test]}
    far = 0
    for r in got:
        order = np.argsort(-value[r.key], kind="stable")
        if metric == "euclidean" and value[r.key][order[k - 1]] - value[r.key][order[k]] < 1e-8:
            continue  # the difference of squares can't tell these, in whatever order it is summed up
        if metric == "cosine" and 0 < value[r.key][order[k - 1]] - value[r.key][order[k]] < 2e-12:
            continue  # on either side of the twelfth digit
        far += 1
        assert round(r.votes[0].score * k) == y[order[:k]].sum()
    assert far > 200 or (kind, metric) == ("copies", "euclidean")
