"""A quality classifier of texts: a generalised additive model with pairwise interactions.

Features are shares and counts of a whole text (never its id, source or language).  Each is cut into bins at quantiles of the training
rows.  Boosting goes round the features: each turn fits a tree of three leaves to the loss's gradient over one feature's bins and adds a
small part of it to that feature's lookup table.  Then the pairs of features whose coarse grids explain most of what
is left are boosted the same way, with trees of one cut on either axis.  A score is the logistic of a sum of table entries, so scoring
is a search for bins and vectorised additions.

Training takes a bounded sample (TRAIN_ROWS) of the labelled rows, those with the least hash of doc_id, to the driver as numbers;
scoring reads every text once and deals out nothing.

Defined cases: null or empty text has features (zeros) and so a score.  Label rows with a null id or label teach nothing; an id with
several labels teaches each once, by the least features of the rows that repeat it.  Without both labels in the sample every score is the share of ones, or a half without any.  Rows
that repeat stay rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm import words as W
from corvane.llm.workspace import small_batches

#: Labelled rows a model learns from, at most.
TRAIN_ROWS = 20_000
_LINES = W.Rule(np.array([b not in (0x0A, 0x0D) for b in range(256)]), False)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "bang": b"!", "bar": b"|", "mark": b"#*%&$@~^_=<>\\{}[]+", "stop": b".,;:?", "quote": b"\"'()-/", "wide": range(128, 256)}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MEMBER[list(_c), _i] = 1
NAMES = ("words", "bytes", "word_bytes", "word_spread", *_CLASSES, "distinct", "top", "twin", "short", "long", "lines", "line_distinct", "line_words")


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    data, offsets = W.column(texts)
    out = [np.zeros((0, len(NAMES)))]
    for a, b in W.chunks(offsets):
        edge = offsets[a : b + 1]
        hist = np.stack([np.bincount(data[x:y], minlength=256) for x, y in zip(edge[:-1], edge[1:], strict=True)])
        shares = (hist @ _MEMBER) / np.maximum(np.diff(edge), 1)[:, None]
        start, end, h, first = W.words(data, edge, W.PLAIN)
        line = W.words(data, edge, _LINES)
        n, n_lines, size = np.diff(first), np.diff(line[3]), (end - start).astype(float)
        per, sums = np.maximum(n, 1), lambda x, first=first: np.diff(np.concatenate(([0.0], np.cumsum(x)))[first])
        mean = sums(size) / per
        spread = np.sqrt(np.maximum(sums(size * size) / per - mean * mean, 0))
        same = np.zeros(len(h))
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][n > 0]] = 0  # the word before belongs to another text
        distinct, top, line_distinct = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a)
        for i in range(b - a):
            own = np.sort(h[first[i] : first[i + 1]])
            if len(own):
                runs = np.diff(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))))
                distinct[i], top[i] = len(runs) / len(own), runs.max() / len(own)
            lines = line[2][line[3][i] : line[3][i + 1]]
            line_distinct[i] = len(set(lines.tolist())) / max(len(lines), 1)
        out.append(np.column_stack([np.log1p(n), np.log1p(np.diff(edge)), mean, spread, shares, distinct, top, sums(same) / per, sums(size <= 2) / per, sums(size > 12) / per, np.log1p(n_lines), line_distinct, n / np.maximum(n_lines, 1)]))
    return np.round(np.concatenate(out), 9)  # the last bits of vectorised logarithms depend on a text's place in its block


def _cut3(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of the best tree of three leaves over ordered bins with gradient sums g and curvature sums h."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        G, H = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        gain = G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    gain, first = best(0, len(g))
    edges = [0, len(g)]
    if gain > 0:
        left, right = best(0, first), best(first, len(g))
        edges = sorted({0, len(g), first, *([left[1] if left[0] >= right[0] else right[1]] if max(left[0], right[0]) > 0 else [])})
    step = np.zeros(len(g))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return step


def _cut_grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree of one cut on either axis."""

    def quadrants(x):
        c = x.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        return np.stack([a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a])

    G, H = quadrants(g), quadrants(h)
    gain = (G**2 / (H + 1)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value, step = G[:, i, j] / (H[:, i, j] + 1), np.empty(g.shape)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), step


class Gam:
    """Lookup tables of single features and of pairs; see the module's text."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 80, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.pair_rounds, self.rate = bins, coarse, rounds, pairs, pair_rounds, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = y.mean() if len(y) else 0.5
        cuts = lambda n: [np.unique(np.quantile(c, np.arange(1, n) / n)) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.fine, self.rough = cuts(self.bins), cuts(self.coarse)
        self.tables, self.pairs, self.grids = [np.zeros(len(c) + 1) for c in self.fine], [], []
        if not 0 < share < 1:
            self.constant = 40.0 if share == 1 else -40.0
            return self
        self.constant = float(np.log(share / (1 - share)))
        at = self._binned(x, self.fine)
        logit = np.full(len(y), self.constant)
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                g, h = (np.bincount(at[f], w, len(table)) for w in (y - p, p * (1 - p)))
                step = self.rate * _cut3(g, h)
                table += step
                logit += step[at[f]]
        at = self._binned(x, self.rough)
        size = [len(c) + 1 for c in self.rough]
        cell = {(f, k): at[f] * size[k] + at[k] for f in range(x.shape[1]) for k in range(f) if size[f] > 1 and size[k] > 1}

        def sums(pair):
            p = 1 / (1 + np.exp(-logit))
            shape = size[pair[0]], size[pair[1]]
            return (np.bincount(cell[pair], w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

        gains = {pair: _cut_grid(*sums(pair))[0] for pair in cell}
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[: self.n_pairs]
        self.grids = [np.zeros((size[f], size[k])) for f, k in self.pairs]
        for _ in range(self.pair_rounds):
            for pair, grid in zip(self.pairs, self.grids, strict=True):
                step = self.rate * _cut_grid(*sums(pair))[1]
                grid += step
                logit += step.ravel()[cell[pair]]
        return self

    @staticmethod
    def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.constant)
        for table, at in zip(self.tables, self._binned(x, self.fine), strict=True):
            logit += table[at]
        at = self._binned(x, self.rough)
        for (f, k), grid in zip(self.pairs, self.grids, strict=True):
            logit += grid[at[f], at[k]]
        return 1 / (1 + np.exp(-logit))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Gam:
    """A model of label (1 or 0) from at most `rows` labelled documents that aren't held out."""
    small_batches(documents.sparkSession)
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)  # so few that a broadcast is bounded

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(taught), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x array<double>, y double")
    found = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()  # as many rows as were chosen, however often an id repeats
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(NAMES)))
    order = np.lexsort([*x.T, found["y"].to_numpy(float)])  # rows arrive in any order; sums shall not
    return Gam().fit(x[order], found["y"].to_numpy(float)[order])


def scores(documents: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score of each row; texts don't come back from Python."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(features(batch.column(1))))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(documents: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose score is at least `least`."""
    small_batches(documents.sparkSession)
    held, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.score(features(batch.column(at))) >= least))

    return documents.mapInArrow(run, documents.schema)
