from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from corvane.llm import quality_gam
from tests.llm.conftest import prose, table


def corpus(n=400):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(rng, 80) if good else rng.choice([" | ".join(prose(rng, 40).split()), prose(rng, 40).upper() + "!!!", "buy buy buy " * 20])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, edge_rows):
    rows, labels = corpus()
    labelled = spark.createDataFrame([*[(d, q, 0, "z") for d, q in labels], (None, 1, 0, "z"), (5, None, 0, "z"), (9999, 0, 0, "z")], "doc_id long, quality int, toxic int, text string")
    documents = table(spark, rows)
    model = quality_gam.train(documents, labelled)
    scores = quality_gam.scores(documents, model)
    out = {r.doc_id: (r.score, r.held_out) for r in scores.select("doc_id", "score", quality_gam.held_out().alias("held_out")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, (_, h) in out.items())
    held = [(out[d][0] >= 0.5) == bool(q) for d, q in labels if out[d][1]]
    assert len(held) > 80 and np.mean(held) > 0.95
    again = quality_gam.train(documents.repartition(3), labelled)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    edges = quality_gam.scores(table(spark, edge_rows), model).collect()
    assert len(edges) == len(edge_rows) and all(0 <= r.score <= 1 for r in edges)
    kept = quality_gam.accepted(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {d for d, (s, _) in out.items() if s >= 0.5}


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_gam.train(table(spark, [(1, "a b c")]), none)
    assert [r.score for r in quality_gam.scores(table(spark, [(1, "a b c"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert quality_gam.scores(table(spark, []), model).collect() == []


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(3000, 2)), np.zeros(3000)])
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    plain = quality_gam.Gam(pairs=0).fit(x[:2000], y[:2000])
    paired = quality_gam.Gam(pairs=2).fit(x[:2000], y[:2000])
    right = lambda m: ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean()
    assert right(plain) < 0.65 and right(paired) > 0.8


def test_features_are_finite():
    x = quality_gam.features(pa.array([None, "", " \n", "a", "A!\n\nb", "é" * 10000]))
    assert x.shape == (6, len(quality_gam.NAMES)) and np.isfinite(x).all()


def plain_score(model, text):
    """Features from split strings, and table entries summed one by one."""
    from bisect import bisect_right
    from collections import Counter
    from math import exp, log1p, sqrt

    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in re.split(rb"[\n\r]+", raw) if x]
    n, sizes = len(words), [len(w) for w in words]
    per = max(n, 1)
    mean = sum(sizes) / per
    x = [log1p(n), log1p(len(raw)), mean, sqrt(max(sum(a * a for a in sizes) / per - mean * mean, 0))]
    x += [sum(b in set(c) for b in raw) / max(len(raw), 1) for c in quality_gam._CLASSES.values()]
    x += [len(set(words)) / per, max(Counter(words).values(), default=0) / per, sum(a == b for a, b in zip(words, words[1:], strict=False)) / per]
    x += [sum(a <= 2 for a in sizes) / per, sum(a > 12 for a in sizes) / per, log1p(len(lines)), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1)]
    x = [round(float(a), 9) for a in x]
    logit = model.constant + sum(t[bisect_right(list(c), a)] for t, c, a in zip(model.tables, model.fine, x, strict=True))
    for (f, k), grid in zip(model.pairs, model.grids, strict=True):
        logit += grid[bisect_right(list(model.rough[f]), x[f])][bisect_right(list(model.rough[k]), x[k])]
    return 1 / (1 + exp(-logit))


def test_scores_are_sums_of_table_entries(spark, edge_rows):
    rows, labels = corpus(150)
    model = quality_gam.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.pairs and any(t.any() for t in model.tables)
    every = [(i, t) for i, (_, t, *_) in enumerate([*rows[:60], *edge_rows])]
    got = {r.doc_id: r.score for r in quality_gam.scores(table(spark, every), model).collect()}
    for i, text in every:
        assert abs(got[i] - plain_score(model, text)) < 1e-9, (i, (text or "")[:60])
