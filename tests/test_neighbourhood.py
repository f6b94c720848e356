"""Close pairs by cells, and the greedy rule by ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import geometry, neighbourhood, reduce
from corvane.session import checkpointed

SCHEMA = "id string, v array<double>"


def frame(spark, x):
    return spark.createDataFrame([(f"k{i:05d}", None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], SCHEMA)


def as_set(df):
    return {(r.key_a, r.key_b, round(r.value, 9)) for r in df.collect()}


@pytest.mark.parametrize("metric,limit", [("cosine", 0.9), ("cosine", 0.2), ("cosine", -0.1), ("euclidean", 0.4), ("euclidean", 3.0)])
def test_pairs_equal_those_of_all(spark, monkeypatch, metric, limit):
    monkeypatch.setattr(neighbourhood, "GROUP", 16)
    rng = np.random.default_rng(1)
    x = [*(rng.normal(size=(12, 4))[rng.integers(0, 12, 180)] + 0.05 * rng.normal(size=(180, 4))), *rng.normal(size=(40, 4)), [0, 0, 0, 0], [0, 0, 0, 0], *[[1, 1, 0, 0]] * 9, [2, 2, 0, 0], None, [float("nan")] * 4]
    df = frame(spark, x).repartition(3)
    got = neighbourhood.close_pairs(df, "id", "v", limit, metric)
    expected = geometry.pairs(df, "id", "v", metric, where=(">=" if metric == "cosine" else "<=", limit))
    assert got.count() == len(as_set(got)) and {(a, b) for a, b, _ in as_set(got)} == {(a, b) for a, b, _ in as_set(expected)} and len(as_set(got)) > 30
    assert got.columns == ["key_a", "key_b", "value"] and neighbourhood.close_pairs(df.limit(0), "id", "v", limit, metric).collect() == []


def test_clusters_are_told_apart(spark):
    """Fewer than a tenth of all pairs of clustered vectors are compared."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 24))
    df = frame(spark, x)
    met = neighbourhood.meetings(df, "id", "v", "cosine", 0.9)
    compared = met.agg(F.sum(F.size("items_a").cast("long") * F.size("items_b"))).first()[0]
    assert compared < 0.1 * 3000 * 3000 / 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert neighbourhood.close_pairs(df, "id", "v", 0.9).count() == int(np.triu(unit @ unit.T >= 0.9, 1).sum())


def rule(pairs, n):
    near = {i: [] for i in range(n)}
    for a, b in pairs:
        near[b].append(a)
    kept = set()
    for i in range(n):
        if not any(a in kept for a in near[i]):
            kept.add(i)
    return {i for i in range(n) if i not in kept}


@pytest.mark.parametrize("size", [1 << 19, 40])
def test_greedy_by_ranges_is_the_sequential_rule(spark, monkeypatch, size):
    monkeypatch.setattr(reduce, "RANGE", size)
    rng = random.Random(3)
    for text in (False, True):
        pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(220)})
        name = (lambda i: f"r{i:04d}") if text else int
        close = spark.createDataFrame([(name(a), name(b), 1.0 - (b - a) / 1000) for a, b in pairs], f"key_a {'string' if text else 'int'}, key_b {'string' if text else 'int'}, value double")
        got = reduce.greedy(close, checkpointed).collect()
        gone = rule(pairs, 120)
        assert {r.removed_id for r in got} == {name(i) for i in gone}
        near = {b: max((a for a, c in pairs if c == b and a not in gone), default=None) for b in gone}  # the closest is the latest here
        assert {r.removed_id: r.representative_id for r in got} == {name(b): name(a) for b, a in near.items()}
    empty = spark.createDataFrame([], "key_a int, key_b int, value double")
    assert reduce.greedy(empty, checkpointed).collect() == []


def test_a_long_chain_takes_few_jobs(spark):
    close = spark.range(9999).select(F.col("id").alias("key_a"), (F.col("id") + 1).alias("key_b"), F.lit(0.9).alias("value"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.removed_id for r in reduce.greedy(close, checkpointed).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(range(1, 10000, 2)) and len(jobs) < 30
