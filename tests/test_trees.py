"""Trees over binned features, held against plain versions on one table."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.operators import trees
from corvane.session import checkpointed


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(400, 5)).astype(float)
    x[:, 3] = rng.normal(size=400)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3) | (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y int").repartition(3).cache()
    return x, y, df


def twin(x, y, bounds, features, trees_, rate, l1=0.0, l2=0.0, gamma=0.0, depth=None, leaves=None, rows=1, weight=1e-3, positive=1.0):
    """Boosting, one node after the other, on the whole table."""
    b = trees.binned(x, bounds)
    w = np.where(y > 0, positive, 1.0)
    m = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    shrink = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    score = lambda g, h: 0.5 * shrink(g) ** 2 / (h + l2)
    for t in range(trees_):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)

        def best(own, d, g=g, h=h, t=t):
            out = None
            if depth is not None and d >= depth:
                return None
            for f in features(t):
                for c in range(len(bounds[f])):
                    left = own & (b[:, f] <= c)
                    right = own & ~left
                    if min(left.sum(), right.sum()) < max(rows, 1) or min(h[left].sum(), h[right].sum()) < weight:
                        continue
                    gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[own].sum(), h[own].sum()) - gamma
                    if gain > 1e-12 and (out is None or gain > out[0] + 1e-9 * max(1, abs(gain))):
                        out = gain, left, right, d + 1
            return out

        open_, done = [(np.ones(len(y), bool), best(np.ones(len(y), bool), 0))], []
        while open_ and len(open_) + len(done) < (leaves or 10**9):
            at = max(range(len(open_)), key=lambda i: open_[i][1][0] if open_[i][1] else -1)
            own, cut = open_.pop(at)
            if not cut:
                done += [own, *(o for o, _ in open_)]
                open_ = []
                break
            open_ += [(cut[1], best(cut[1], cut[3])), (cut[2], best(cut[2], cut[3]))]
        for own in [*done, *(o for o, _ in open_)]:
            m[own] -= rate * shrink(g[own].sum()) / (h[own].sum() + l2)
    return m


CASES = [
    dict(rate=0.3, max_depth=3, l2=1.0),
    dict(rate=0.3, max_leaves=6),
    dict(rate=0.2, max_leaves=9, max_depth=3, l1=2.0, l2=0.5, gamma=0.3, min_rows=15),
    dict(rate=0.3, max_depth=4, positive_weight=3.0, min_weight=4.0),
    dict(rate=0.3, max_depth=2, columns=0.5),
]


@pytest.mark.parametrize("how", CASES)
def test_boosting_equals_its_twin(spark, table, monkeypatch, how):
    x, y, df = table
    monkeypatch.setattr(trees, "CHUNK", 2)
    monkeypatch.setattr(trees, "SUMS", 5 * 256 * 3 * 2)
    model = trees.Boosted(trees=4, **how).fit(df, "id", "v", "y", checkpointed)
    names = {"max_depth": "depth", "max_leaves": "leaves", "min_rows": "rows", "min_weight": "weight", "positive_weight": "positive"}
    k = max(1, round(how.get("columns", 1) * 5))
    features = lambda t: np.sort(np.random.default_rng([0, t]).permutation(5)[:k])
    plain = twin(x, y, model.bounds, features, 4, **{names.get(a, a): v for a, v in how.items() if a != "columns"})
    assert np.abs(model.margins(trees.binned(x, model.bounds)) - plain).max() < 1e-6
    got = {r.id: r.prediction for r in model.predicted(df, "v").collect()}
    assert [got[i] for i in range(400)] == (plain > 0).astype(int).tolist()


def test_every_setting_changes_the_fit(spark, table):
    x, _, df = table
    base = dict(trees=2, rate=0.3, max_leaves=8)
    margins = lambda **more: (m := trees.Boosted(**(base | more)).fit(df, "id", "v", "y", checkpointed)).margins(trees.binned(x, m.bounds))
    plain = margins()
    for more in (dict(max_leaves=4), dict(l1=1.0), dict(l2=5.0), dict(gamma=2.0), dict(columns=0.4), dict(rows=0.5), dict(positive_weight=2.0), dict(balanced=True), dict(min_rows=80), dict(rate=0.1), dict(max_depth=2)):
        assert np.abs(margins(**more) - plain).max() > 1e-6, more
    with pytest.raises(ValueError):
        trees.Boosted().fit(df.where("y = 1"), "id", "v", "y", checkpointed)


def grown(x, y, w, bounds, forest, t):
    """One tree of a forest, node after node in the order of numbers."""
    b, tree = trees.binned(x, bounds), trees.Tree()
    tree.value[0] = (w * y).sum() / w.sum()
    level = [(0, w > 0)]
    while level:
        later = []
        for node, own in level:
            n, k = w[own].sum(), (w * y)[own].sum()
            if not 0 < k < n or n < forest.min_split or forest.max_depth is not None and tree.depth[node] >= forest.max_depth:
                continue
            features = forest._features(x.shape[1], t, node)
            sums = np.zeros((len(features), max(len(e) for e in bounds) + 1, 3))
            for i, f in enumerate(features):
                for c, v in enumerate((w * y, w, w)):
                    sums[i, :, c] = np.bincount(b[own, f], v[own], sums.shape[1])
            only = forest._only(sums, features, t, node, bounds) if forest.splitter == "random" else None
            best = None
            for i, f in enumerate(features):
                for c in range(sums.shape[1] - 1):
                    if only is not None and c != only[i]:
                        continue
                    left = own & (b[:, f] <= c)
                    right = own & ~left
                    if min(w[left].sum(), w[right].sum()) < max(forest.min_leaf, 1):
                        continue
                    impurity = lambda s: (p := (w * y)[s].sum() / w[s].sum(), w[s].sum() * (2 * p * (1 - p) if forest.criterion == "gini" else -sum(q * np.log2(q) for q in (p, 1 - p) if q > 0)))[1]
                    gain = impurity(own) - impurity(left) - impurity(right)
                    if best is None or gain > best[0] + 1e-9 * max(1, abs(gain)):
                        best = gain, f, c, left, right
            if best and (forest.splitter == "random" or best[0] > 1e-12):
                later.append((node, *best[1:]))
        level = []
        for node, f, c, left, right in later:
            for child, own in zip(tree.cut(node, int(f), c), (left, right), strict=True):
                tree.value[child] = (w * y)[own].sum() / w[own].sum()
                level.append((child, own))
    return tree


@pytest.mark.parametrize("how", [dict(splitter="random", node_features="sqrt"), dict(splitter="random", max_depth=3, min_leaf=4, criterion="entropy"), dict(bootstrap=True, rows=0.7, tree_features=0.6, min_split=10), dict(rows=0.5, max_depth=4), dict(node_features=0.5, criterion="entropy", max_depth=5, bootstrap=True)])
def test_forests_equal_plain_trees(spark, table, monkeypatch, how):
    x, y, df = table
    monkeypatch.setattr(trees, "SUMS", 5 * 256 * 3 * 3)
    forest = trees.Forest(trees=3, seed=4, **how).fit(df, "id", "v", "y", checkpointed)
    ids = np.array([r[0] for r in df.selectExpr("xxhash64(id, v) as h", "id").orderBy("id").collect()])
    for t in range(3):
        w = trees.poisson(ids.view(np.uint64), t, 4, forest.part).astype(float) if forest.bootstrap else (trees._uniform(ids, 4, t) < forest.part).astype(float)
        plain = grown(x, y, w, forest.bounds, forest, t)
        own = forest.model[t]
        assert (own.feature, own.last) == (plain.feature, plain.last) and np.abs(np.array(own.value) - plain.value).max() < 1e-9
    got = {r.id: r.prediction for r in forest.predicted(df, "v").collect()}
    assert [got[i] for i in range(400)] == (forest.shares(trees.binned(x, forest.bounds)) > 0.5).astype(int).tolist()


def test_draws():
    ids = np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.int64)
    for mean in (0.5, 1.0):
        drawn = trees.poisson(ids.view(np.uint64), 1, 0, mean)
        assert abs(drawn.mean() - mean) < 0.01 and abs(drawn.var() - mean) < 0.02
    assert abs(np.corrcoef(trees.poisson(ids.view(np.uint64), 1, 0, 1.0), trees.poisson(ids.view(np.uint64), 2, 0, 1.0))[0, 1]) < 0.01
    assert abs(trees._uniform(ids, 1, 2).mean() - 0.5) < 0.01


def test_missing_values_and_one_value(spark):
    rows = [(i, [float("nan") if i % 3 == 0 else float(i % 7), 1.0], int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    model = trees.Boosted(trees=3, max_depth=2, rate=0.5).fit(df, "id", "v", "y", checkpointed)
    assert len(model.bounds[1]) == 0 and model.predicted(df, "v").where("prediction <> y").count() <= 9
    with pytest.raises(ValueError):
        trees.Forest(criterion="other")
