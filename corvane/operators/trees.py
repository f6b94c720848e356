"""Trees over binned features, grown by sums over rows: boosted trees, and ensembles of random ones.

Rows stay where they are.  A feature's values are cut at quantiles of the train rows into at most BINS bins.  In a wave each task sends its rows down the trees
there are and sums gradients, curvatures and rows by node, feature and bin; the sums of tasks are added by Spark, and the driver cuts nodes from them.
A wave holds as many nodes as SUMS numbers allow, whatever the number of rows, so memory doesn't grow with data and waves grow
with nodes alone.

*Boosted* trees take the logistic loss.  A cut's gain is that of its children's scores, T(G)^2 / (H + l2) with T shrinking G by l1, less the parent's, halved, less gamma.  A tree with
`max_leaf_nodes` grows best first: nodes that the best-first order reaches are cut wave by wave, and those that it doesn't reach in the end are closed again.
*Random* trees take squared distance from the mean (gini) or entropy.  Bagged rows are weighted by Poisson draws from a hash of key, features and tree;
`best` cuts are the best of all bins, `random` ones one random threshold a feature; a node looks at a random choice of features.

Everything drawn is drawn from the seed and ids, so a lost task gives the same rows again.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bins of a feature; numbers summed in a wave; trees of a boosted model between two writings of its margins.
BINS, SUMS, CHUNK = 255, 4_000_000, 20
ROWS = "id long, y double, w double, m double, bins binary"


def edges(train: DataFrame, x: str, bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, at quantiles of the train rows; values above the last are a bin of their own."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    long = train.select(F.posexplode(x).alias("i", "v")).where("v is not null and not isnan(v)")
    rows = long.groupBy("i").agg(F.percentile_approx("v", shares, F.lit(20 * bins)).alias("q"), F.max("v").alias("top")).collect()  # one a feature
    found = {r["i"]: np.unique([q for q in r["q"] if q < r["top"]]) for r in rows}
    return [found.get(i, np.zeros(0)) for i in range(max(found, default=-1) + 1)]


def binned(v: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of features; a missing value falls in the first bin."""
    out = np.zeros(v.shape, np.uint8)
    for i, b in enumerate(bounds):
        out[:, i] = np.where(np.isnan(v[:, i]), 0, np.searchsorted(b, v[:, i], "left"))
    return out


@dataclass
class Tree:
    """Nodes as lists: feature (-1: a leaf), the last bin that goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def cut(self, node: int, feature: int, last: int) -> tuple[int, int]:
        for _ in "ab":
            for x, v in ((self.feature, -1), (self.last, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.depth, self.depth[node] + 1)):
                x.append(v)
        self.feature[node], self.last[node], self.left[node], self.right[node] = feature, last, len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]

    def of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, feature, last, left, right = np.zeros(len(bins), np.int64), *map(np.array, (self.feature, self.last, self.left, self.right))
        rows = np.arange(len(bins))
        while len(rows := rows[feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= last[at], left[at], right[at])
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.of(bins)]


def poisson(keys: np.ndarray, tree: int, seed: int, mean: float) -> np.ndarray:
    """A Poisson number of each key and tree, at most 15."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(seed + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x = x ^ (x >> np.uint64(33))
    steps = np.cumsum(np.exp(-mean) * np.cumprod(np.concatenate(([1.0], mean / np.arange(1, 16)))))
    return np.searchsorted(steps, (x >> np.uint64(11)).astype(float) / 2.0**53, "right").clip(0, 15)


class Frame:
    """Binned train rows in a written table: id (a hash of key and features), y (0 or 1), weight, margin, bins."""

    def __init__(self, train: DataFrame, key: str, x: str, y: str, keep: Callable[[DataFrame], DataFrame], weight: Callable[[np.ndarray], np.ndarray] | None = None):
        self.bounds, self.keep = edges(train, x), keep
        self.width, self.size = len(self.bounds), max((len(b) for b in self.bounds), default=0) + 1
        bounds = self.bounds

        def run(batches):
            for batch in batches:
                v = np.asarray(batch.column(2).flatten(), float).reshape(len(batch), -1)
                label = np.asarray(batch.column(1))
                w = np.ones(len(batch)) if weight is None else weight(label)
                bins = [r.tobytes() for r in binned(v, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w), pa.array(np.zeros(len(batch))), pa.array(bins, pa.binary())], ["id", "y", "w", "m", "bins"])

        rows = train.select(F.xxhash64(key, x).alias("id"), F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"))
        self.rows = keep(rows.mapInArrow(run, ROWS))

    def sums(self, jobs: dict[tuple[int, int], np.ndarray], weigh) -> dict[tuple[int, int], np.ndarray]:
        """For each (tree, node) of jobs, by its features, sums by bin: an array (features, bins, 3).

        weigh(ids, y, w, margin, bins, trees) gives for each tree the rows' nodes and the three numbers that are summed.
        """
        features, size, trees = jobs, self.size, sorted({t for t, _ in jobs})

        def run(batches):
            total = {j: np.zeros((len(f), size, 3)) for j, f in features.items()}
            for batch in batches:
                if not len(batch):
                    continue
                ids, y, w, m = (np.asarray(batch.column(i)) for i in range(4))
                bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(batch), -1)
                for t, (node, numbers) in weigh(ids, y, w, m, bins, trees).items():
                    order = np.argsort(node, kind="stable")
                    at = np.flatnonzero(np.diff(node[order], prepend=-1))
                    for a, b in zip(at, [*at[1:], len(order)], strict=True):
                        own = total.get((t, int(node[order[a]])))
                        if own is None:
                            continue
                        rows = order[a:b]
                        for k, f in enumerate(features[t, int(node[order[a]])]):
                            for c in range(3):
                                own[k, :, c] += np.bincount(bins[rows, f], numbers[rows, c], size)
            for (t, n), own in total.items():
                if own[:, :, 2].any():
                    for k, f in enumerate(features[t, n]):
                        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([n]), pa.array([int(f)]), pa.array([own[k].ravel().tolist()], pa.list_(pa.float64()))], ["tree", "node", "feature", "s"])

        kept = self.rows.mapInArrow(run, "tree long, node long, feature long, s array<double>")
        added = kept.select("tree", "node", "feature", F.posexplode("s").alias("i", "v")).groupBy("tree", "node", "feature", "i").agg(F.sum("v").alias("v"))
        lists = added.groupBy("tree", "node", "feature").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("tree", "node", "feature", F.transform("s", lambda x: x["v"]).alias("s"))
        out = {j: np.zeros((len(f), size, 3)) for j, f in jobs.items()}
        place = {j: {int(x): k for k, x in enumerate(f)} for j, f in jobs.items()}
        for r in lists.collect():  # SUMS numbers at most
            j = r["tree"], r["node"]
            out[j][place[j][r["feature"]]] = np.array(r["s"]).reshape(size, 3)
        return out

    def waves(self, jobs: dict[tuple[int, int], np.ndarray]) -> list[dict]:
        """Jobs in parts of a bounded number of sums."""
        out, room = [], 0
        for j, f in jobs.items():
            need = len(f) * self.size * 3
            if not out or need > room:
                out.append({})
                room = max(SUMS, need)
            out[-1][j] = f
            room -= need
        return out


def _uniform(ids: np.ndarray, *what: int) -> np.ndarray:
    """Numbers from 0 to 1, drawn from ids and numbers."""
    x = ids.view(np.uint64).copy()
    for k in what:
        x ^= np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def _best(sums: np.ndarray, features: np.ndarray, score: Callable, allowed: Callable, only: np.ndarray | None = None) -> tuple | None:
    """Gain, feature and last bin of the best cut of a node, and the sums of both sides; the first of those that are equal but for rounding.  only: one cut a feature."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    total = sums[0].sum(axis=0)
    right = total - left
    gain = np.where(allowed(left) & allowed(right), score(left) + score(right) - score(total), -np.inf)
    if only is not None:
        kept = np.full(gain.shape, -np.inf)
        some = np.flatnonzero(only >= 0)
        kept[some, only[some]] = gain[some, only[some]]
        gain = kept
    if not gain.size or not np.isfinite(most := gain.max()):
        return None
    k, at = np.unravel_index(int(np.argmax(gain >= most - 1e-9 * max(1.0, abs(most)))), gain.shape)  # sums' last digits decide nothing
    return float(gain[k, at]), int(features[k]), int(at), left[k, at], right[k, at]


class Boosted:
    """Boosted trees of two classes by the logistic loss."""

    def __init__(self, trees: int = 100, rate: float = 0.1, max_depth: int | None = None, max_leaves: int | None = None, l1: float = 0.0, l2: float = 0.0, gamma: float = 0.0, min_weight: float = 1e-3, min_rows: int = 1, rows: float = 1.0, columns: float = 1.0, positive_weight: float = 1.0, balanced: bool = False, seed: int = 0):
        self.trees, self.rate, self.max_depth, self.max_leaves = int(trees), float(rate), max_depth, max_leaves
        self.l1, self.l2, self.gamma, self.min_weight, self.min_rows = float(l1), float(l2), float(gamma), float(min_weight), int(min_rows)
        self.part, self.columns, self.positive, self.balanced, self.seed = float(rows), float(columns), float(positive_weight), balanced, int(seed)

    def _score(self, s: np.ndarray) -> np.ndarray:
        g = np.sign(s[..., 0]) * np.maximum(np.abs(s[..., 0]) - self.l1, 0)
        return 0.5 * g * g / np.maximum(s[..., 1] + self.l2, 1e-300)

    def _value(self, s: np.ndarray) -> float:
        g = np.sign(s[0]) * max(abs(s[0]) - self.l1, 0)
        return float(-self.rate * g / max(s[1] + self.l2, 1e-300))

    def _allowed(self, s: np.ndarray) -> np.ndarray:
        return (s[..., 2] >= max(self.min_rows, 1)) & (s[..., 1] >= self.min_weight)

    def fit(self, train: DataFrame, key: str, x: str, y: str, keep: Callable[[DataFrame], DataFrame]) -> Boosted:
        n, positive = train.agg(F.count("*"), F.sum(y)).first()
        if not n or not 0 < positive < n:
            raise ValueError("two classes are needed")
        one, zero = (n / (2 * positive), n / (2 * (n - positive))) if self.balanced else (1.0, 1.0)
        one *= self.positive
        data = Frame(train, key, x, y, keep, lambda label: np.where(label > 0, one, zero))
        self.bounds, self.base, self.model = data.bounds, float(np.log(one * positive / (zero * (n - positive)))), []
        written, base = 0, self.base
        for t in range(self.trees):
            if t - written >= CHUNK:  # margins of the trees so far
                data.rows = keep(_with_margins(data.rows, self.model[written:]))
                written = t
            chunk, part, seed = self.model[written:], self.part, self.seed
            features = np.sort(np.random.default_rng([seed, t]).permutation(data.width)[: max(1, round(self.columns * data.width))])
            tree = Tree()

            def weigh(ids, y, w, m, bins, _, chunk=chunk, tree=tree, t=t, part=part, seed=seed):
                p = 1 / (1 + np.exp(-(base + m + sum((c.values(bins) for c in chunk), np.zeros(len(m))))))
                some = w if part >= 1 else w * (_uniform(ids, seed, t) < part)
                return {0: (tree.of(bins), np.stack([some * (p - y), some * p * (1 - p), some > 0], axis=1))}

            self._grow(data, tree, features, weigh)
            self.model.append(tree)
        return self

    def _grow(self, data: Frame, tree: Tree, features: np.ndarray, weigh: Callable) -> None:
        sums = {0: data.sums({(0, 0): features}, weigh)[0, 0]}
        cut: dict[int, tuple | None] = {}
        whole: dict[int, np.ndarray] = {0: sums[0][0].sum(axis=0)}
        most = self.max_leaves or np.inf

        def judged(node: int) -> None:
            deep = self.max_depth is not None and tree.depth[node] >= self.max_depth
            found = None if deep else _best(sums[node], features, self._score, self._allowed)
            cut[node] = found if found and found[0] - self.gamma > 1e-12 else None

        judged(0)
        while True:
            # The best-first order as far as it is known.
            heap, done, ask, leaves = [(-cut[0][0], 0)] if cut[0] else [], [], [], 1
            while heap and leaves < most:
                _, node = heapq.heappop(heap)
                done.append(node)
                leaves += 1
                if tree.left[node] < 0:
                    ask.append(node)
                else:
                    for child in (tree.left[node], tree.right[node]):
                        if cut[child]:
                            heapq.heappush(heap, (-cut[child][0], child))
            if not ask:
                break
            jobs = {}
            for node in ask:
                _, f, last, left, right = cut[node]
                a, b = tree.cut(node, f, last)
                whole[a], whole[b] = left, right
                if self.max_depth is not None and tree.depth[a] >= self.max_depth:
                    cut[a] = cut[b] = None
                    continue
                jobs[0, a if left[2] <= right[2] else b] = features  # the other's sums are what is left of its parent's
            for wave in data.waves(jobs):
                for (_, node), found in data.sums(wave, weigh).items():
                    parent = next(p for p in ask if node in (tree.left[p], tree.right[p]))
                    other = tree.left[parent] + tree.right[parent] - node
                    sums[node], sums[other] = found, sums[parent] - found
                    judged(node)
                    judged(other)
            for node in ask:
                sums.pop(node, None)
        kept = set(done)
        for node in range(len(tree.feature)):
            if node not in kept:
                tree.feature[node] = -1  # cut on the way, but not reached
            if node in whole:
                tree.value[node] = self._value(whole[node])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.values(bins) for t in self.model), np.zeros(len(bins)))

    def predicted(self, df: DataFrame, x: str) -> DataFrame:
        return _predicted(df, x, self, lambda m: m.margins, 0.0)


def _with_margins(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    def run(batches):
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(batch), -1)
            m = np.asarray(batch.column(3)) + sum((t.values(bins) for t in trees), np.zeros(len(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m), batch.column(4)], batch.schema.names)

    return rows.mapInArrow(run, ROWS)


class Forest:
    """Random trees: bagged ones, and those of random thresholds; their mean share of class 1 decides."""

    def __init__(self, trees: int = 100, max_depth: int | None = None, min_split: float = 2, min_leaf: float = 1, criterion: str = "gini", splitter: str = "best", bootstrap: bool = False, rows: float = 1.0, node_features: str | float | int | None = None, tree_features: float = 1.0, seed: int = 0):
        if criterion not in ("gini", "entropy") or splitter not in ("best", "random"):
            raise ValueError(f"no such rule: {criterion}, {splitter}")
        self.trees, self.max_depth, self.min_split, self.min_leaf = int(trees), max_depth, float(min_split), float(min_leaf)
        self.criterion, self.splitter, self.bootstrap, self.part = criterion, splitter, bootstrap, float(rows)
        self.node_features, self.tree_features, self.seed = node_features, float(tree_features), int(seed)

    def _score(self, s: np.ndarray) -> np.ndarray:
        """Rows times purity, so that children less the parent is what a cut gains."""
        n = np.maximum(s[..., 1], 1e-300)
        p = np.clip(s[..., 0] / n, 0, 1)
        if self.criterion == "gini":
            return -n * 2 * p * (1 - p)
        q = np.stack([p, 1 - p])
        return n * (q * np.log2(np.where(q > 0, q, 1))).sum(axis=0)

    def _allowed(self, s: np.ndarray) -> np.ndarray:
        return s[..., 2] >= max(self.min_leaf, 1)

    def _features(self, width: int, tree: int, node: int) -> np.ndarray:
        own = np.random.default_rng([self.seed, tree]).permutation(width)[: max(1, int(self.tree_features * width))]
        k = {"sqrt": int(np.sqrt(len(own))), "log2": int(np.log2(len(own)))}.get(self.node_features, self.node_features)
        k = len(own) if k is None else k if isinstance(k, int) else int(k * len(own))
        return np.sort(np.random.default_rng([self.seed, tree, node]).permutation(own)[: max(1, k)])

    def _only(self, sums: np.ndarray, features: np.ndarray, tree: int, node: int, bounds: list[np.ndarray]) -> np.ndarray:
        """A random cut of each feature between its least and greatest bin in the node, even over values; -1 where there is one bin."""
        draw, out = np.random.default_rng([self.seed, tree, node, 1]).uniform(size=len(features)), np.full(len(features), -1)
        for k, f in enumerate(features):
            held = np.flatnonzero(sums[k, :, 2])
            if len(held) > 1:
                low, high = bounds[f][held[0]], bounds[f][held[-1] - 1]
                out[k] = min(max(int(np.searchsorted(bounds[f], low + draw[k] * (high - low), "left")), held[0]), held[-1] - 1)
        return out

    def fit(self, train: DataFrame, key: str, x: str, y: str, keep: Callable[[DataFrame], DataFrame]) -> Forest:
        data = Frame(train, key, x, y, keep)
        self.bounds, self.model = data.bounds, [Tree() for _ in range(self.trees)]
        model, bootstrap, part, seed = self.model, self.bootstrap, self.part, self.seed

        def weigh(ids, y, w, m, bins, trees):
            out = {}
            for t in trees:
                w = poisson(ids.view(np.uint64), t, seed, part).astype(float) if bootstrap else (_uniform(ids, seed, t) < part).astype(float) if part < 1 else np.ones(len(y))
                out[t] = model[t].of(bins), np.stack([w * y, w, w], axis=1)
            return out

        open_ = [(t, 0) for t in range(self.trees)]
        while open_:
            later = []
            for wave in data.waves({j: self._features(data.width, *j) for j in open_}):
                for (t, node), sums in data.sums(wave, weigh).items():
                    tree, total = self.model[t], sums[0].sum(axis=0)
                    if node == 0:
                        tree.value[0] = float(total[0] / total[1]) if total[1] else 0.0
                    only = self._only(sums, wave[t, node], t, node, data.bounds) if self.splitter == "random" else None
                    pure = total[0] <= 0 or total[0] >= total[1]
                    found = None if pure or total[2] < self.min_split else _best(sums, wave[t, node], self._score, self._allowed, only)
                    if not found or self.splitter == "best" and found[0] <= 1e-12:
                        continue
                    _, f, last, left, right = found
                    later.append((t, node, f, last, left, right))
            open_ = []
            for t, node, f, last, left, right in later:
                tree = self.model[t]
                for child, s in zip(tree.cut(node, f, last), (left, right), strict=True):
                    tree.value[child] = float(s[0] / s[1])
                    if (self.max_depth is None or tree.depth[child] < self.max_depth) and 0 < s[0] < s[1] and s[2] >= self.min_split:
                        open_.append((t, child))
        return self

    def shares(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.values(bins) for t in self.model), np.zeros(len(bins))) / len(self.model)

    def predicted(self, df: DataFrame, x: str) -> DataFrame:
        return _predicted(df, x, self, lambda m: m.shares, 0.5)


def _predicted(df: DataFrame, x: str, model, rule: Callable, limit: float) -> DataFrame:
    """df with prediction (0 or 1) by a broadcast model, whose size is that of its trees."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def class_of(v: pd.Series) -> pd.Series:
        own = held.value
        if not len(v):
            return pd.Series([], dtype="int32")
        return pd.Series((rule(own)(binned(np.stack(v.to_list()).astype(float), own.bounds)) > limit).astype(np.int32))

    return df.withColumn("prediction", class_of(F.col(x)))
