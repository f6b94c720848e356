from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ngram_jaccard
from corvane.llm.ngram_jaccard import JaccardJoin, jaccard_components, least_overlap, may_link, one_of_each, parities, prefix, prefix_length, sketch
from tests.llm.conftest import low, table, words


def shingles(text):
    own = words(low(text or ""))
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def brute(rows):
    rows = [(d, shingles(t)) for d, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(x), least[root(i)] if d is not None else None) for i, (d, x) in enumerate(rows))


@pytest.mark.parametrize("frequent", [64, 2])
def test_components(spark, edge_rows, frequent):
    got = jaccard_components(table(spark, edge_rows), frequent=frequent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(edge_rows)


def test_one_of_each(spark, edge_rows):
    kept = one_of_each(table(spark, edge_rows))
    assert kept.columns == table(spark, edge_rows).columns
    got = Counter(r.doc_id for r in kept.collect())
    groups = brute(edge_rows)
    expected = Counter({d: n for (d, k, c), n in groups.items() if d is None or not k})
    for key in {(c,) for (d, k, c) in groups if d is not None and k}:
        expected[key[0]] += 1
    expected[None] = sum(n for (d, _, _), n in groups.items() if d is None)
    assert got == expected


def test_sets_that_share_half_a_digest(spark, edge_rows, monkeypatch):
    full = ngram_jaccard.digest
    monkeypatch.setattr(ngram_jaccard, "digest", lambda tokens: (full(tokens)[0] & 3, full(tokens)[1]))
    join = JaccardJoin(table(spark, edge_rows))
    sets = join.sets().where("n > 0")
    assert join.renamed and sets.select("set").distinct().count() == len({shingles(t) for _, t, *_ in edge_rows} - {frozenset()})
    assert sets.groupBy("set").agg(F.count_distinct("guard").alias("k")).where("k > 1").count() == 0


def test_a_group_is_opened_by_the_least_need_of_its_tokens(spark):
    """Six shared prefix tokens, of which the sixth lies too late to count, and a larger member of the group that lessens what is asked for there."""
    shared = np.sort(np.random.default_rng(9).integers(0, 2**63, 46).astype(np.uint64))
    own = lambda k, n: np.sort(np.concatenate((shared, np.arange(k, k + n, dtype=np.uint64))))
    one, two, third = own(10, 5), own(20, 5), np.arange(100, 152, dtype=np.uint64)
    join = JaccardJoin(spark.createDataFrame([], "doc_id long, text string"))
    each = spark.createDataFrame([(i, len(s), bytearray(sketch(s)), i, *parities(s)) for i, s in ((1, one), (2, two), (3, third))], "set long, n int, sketch binary, doc_id long, q0 long, q1 long, q2 long, q3 long")
    rows = [(t, i, rest, 40, 9) for t, rest in ((1, 51), (2, 50), (3, 49), (4, 48), (5, 47), (6, 41)) for i in (1, 2)] + [(6, 3, 42, 41, 9)]
    rows = spark.createDataFrame(rows, "token long, set long, rest int, behind int, leader long")
    groups = spark.createDataFrame([(2, 2), (3, 2)], "node long, component long")
    assert (1, 2) in {(r.a, r.b) for r in join.opened(rows, each, groups).collect()}


def test_empty_table(spark):
    assert jaccard_components(table(spark, [])).collect() == []


def test_prefixes_of_linked_sets_share_tokens():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**60, n).astype(np.uint64))
        swap = int(rng.integers(0, max(1, len(a) // 6) + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[swap:], rng.integers(0, 2**60, swap).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        frequent = np.sort(rng.permutation(a)[: len(a) // 2])
        if linked:
            assert both >= max(least_overlap(len(a), 80), least_overlap(len(b), 80))
            p, q = prefix(a, frequent, 80), prefix(b, frequent, 80)
            assert len(p) >= prefix_length(len(a), 80)
            least = -(-80 * (len(a) + len(b)) // 180)
            assert len(np.intersect1d(p, q)) >= max(1, least - max(len(a) - len(p), len(b) - len(q)))
            assert sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(parities(a), parities(b), strict=True)) <= len(a) + len(b) - 2 * both
            assert may_link(sketch(a), sketch(b), len(a), len(b), 80)


def test_more_frequent_tokens_than_fit(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "MOST_FREQUENT_TOKENS", 8)
    got = jaccard_components(table(spark, edge_rows), frequent=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(edge_rows)
