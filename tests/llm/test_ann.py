from __future__ import annotations

import os

import numpy as np
import pytest

from corvane.llm import ann, queries

TABLES = "/root/testdata/sf0.1"

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string"


def brute(ids, x, queries, k):
    x = x.astype(float)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        score = (x * x[i]).sum(1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q]
        out[q] = [(int(ids[j]), float(score[j])) for j in order[:k]]
    return out


def rows_of(ids, x):
    return [(int(i), [float(a) for a in v], 0, "s", "v") for i, v in zip(ids, x, strict=True)]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 512)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[100:160] = x[100]  # a very common vector
    ids = np.arange(3000)
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA).repartition(5)
    got: dict[int, list] = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(ids, x, [i for i in range(3000) if i % 50 == 0], 5)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in got)
    assert hits / (5 * len(got)) >= 0.9
    exact = {(q, v): s for q, vs in brute(ids, x, list(got), 3000).items() for v, s in vs}
    assert all(s == pytest.approx(exact[q, v], abs=1e-12) for q, vs in got.items() for v, s in vs)


@pytest.mark.parametrize("spread", [9.0, 0.05])
def test_pigeonhole_finds_every_code_in_the_radius(spread):
    """Far neighbours, whose substrings are compared with those held; and near ones, whose substrings are enumerated."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40))[rng.integers(0, 200, 2000)] + spread * rng.normal(size=(2000, 40))
    codes = ann.Codes(x, 5)
    assert (codes.radius < 12) == (spread < 1)
    block = ann.Block(codes, np.arange(2000), x)
    again = ann.Block(codes, np.arange(2000), x, block.order)
    for i in range(40):
        near = np.flatnonzero(np.bitwise_count(block.code ^ block.code[i]) <= codes.radius)
        assert block.within(block.code[i]).tolist() == near.tolist() == again.within(block.code[i]).tolist()


@pytest.mark.skipif(not os.path.exists(f"{TABLES}/embeddings.parquet"), reason="no test tables here")
def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").toPandas()
    expected = brute(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list()), [i for i in rows["vec_id"] if i % 50 == 0], 5)
    got: dict[int, set] = {q: set() for q in expected}
    for r in queries.op4_nearest_neighbours(spark, TABLES).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in near}) for q, near in expected.items()) >= 0.95 * sum(map(len, expected.values()))


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 0, "", ""), (50, [0.0, 2.0], 0, "", ""), (1, [1.0, 1.0], 0, "", ""), (2, None, 0, "", ""), (3, [0.0, 0.0], 0, "", ""), (4, [1.0, None], 0, "", ""), (5, [float("nan"), 1.0], 0, "", ""), (6, [float("inf"), 1.0], 0, "", ""), (None, [1.0, 0.0], 0, "", ""), (1, [1.0, 0.9], 0, "", ""), (7, [1.0], 0, "", ""), (8, [], 0, "", ""), (50, [0.0, 2.0], 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, empty).collect() == []
    assert ann.nearest(df, empty).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.0], 0, "", "")], SCHEMA)
    assert ann.nearest(alone, alone).collect() == []


def test_rows_stored_by_cluster(spark, monkeypatch):
    """Neighbours that are near make the radius small, and no query is compared with all rows where its cluster has enough."""
    monkeypatch.setattr(ann, "ROWS", 1024)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(100, 48)), 80, axis=0) + 0.02 * rng.normal(size=(8000, 48))
    ids = np.arange(8000)
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA).repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    whole, best, radius = [], ann._best, []

    def seen(blocks, codes, some, k, every):
        if every:
            whole.append(len(some))
        else:
            radius.append(codes.radius)
        return best(blocks, codes, some, k, every)

    monkeypatch.setattr(ann, "_best", seen)
    got: dict[int, set] = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(ids, np.array(x, np.float32).astype(float), list(got), 5)
    assert len(got) == 160 and sum(len(got[q] & {v for v, _ in near}) for q, near in expected.items()) >= 0.95 * 800
    assert whole[0] == 64 and sum(whole[1:]) <= 16  # the look for the radius, and few others
    codes = ann.Codes(ann.scaled(x[rng.permutation(8000)[:4000]]), 5)
    codes.radius = radius[0]
    block = ann.Block(codes, ids, ann.scaled(x))
    opened = [len(block.within(block.code[q])) for q in range(0, 8000, 400)]
    assert np.mean(opened) < 0.05 * 8000


def test_lengths_and_sizes(spark):
    """Each length is searched for itself; the largest finite numbers have exact cosines."""
    rows = [(0, [1.0, 1.0]), (50, [1e200, 0.0]), (1, [1e300, 1e300]), (2, [1e-300, 0.0]), (100, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()}
    half = 0.5**0.5
    assert {k: v for k, (v, _) in got.items()} == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (50, 1): 2, (50, 2): 0, (50, 3): 1, (100, 1): 3}
    assert {k: s for k, (_, s) in got.items()} == pytest.approx({(0, 1): 1.0, (0, 2): half, (0, 3): half, (50, 1): 1.0, (50, 2): half, (50, 3): half, (100, 1): 1.0}, abs=1e-12)
