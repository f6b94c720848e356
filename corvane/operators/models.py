"""Classifiers that pyspark.ml doesn't have, fitted from sums over rows: discriminant analysis, naive Bayes, linear machines of squared hinge loss, and kernels
by random Fourier features; trees are in trees.py.

Names and parameters are those that training grids use.  Parameters of a grid that change nothing here are listed by losses(), which fold results carry; values that a model can't
take raise.  Models that stand in for another kind are listed in STAND_INS.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Models by the names of training grids, and for each its parameters and what the distributed model calls them.
TREE = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed", "criterion": "impurity"}
FOREST = TREE | {"n_estimators": "numTrees", "max_samples": "subsamplingRate", "bootstrap": "bootstrap", "max_features": "featureSubsetStrategy"}
BOOSTED = {"learning_rate": "rate", "max_depth": "max_depth", "random_state": "seed"}
RANDOM = {"max_depth": "max_depth", "min_samples_split": "min_split", "min_samples_leaf": "min_leaf", "criterion": "criterion", "max_features": "node_features", "random_state": "seed"}
LINEAR = {"max_iter": "maxIter", "tol": "tol", "C": "C", "fit_intercept": "fitIntercept"}
PARAMETERS = {
    "RandomForestClassifier": FOREST, "DecisionTreeClassifier": TREE,
    "ExtraTreesClassifier": RANDOM | {"n_estimators": "trees", "bootstrap": "bootstrap"}, "ExtraTreeClassifier": RANDOM,
    "BaggingClassifier": {"n_estimators": "trees", "max_samples": "rows", "max_features": "tree_features", "bootstrap": "bootstrap", "random_state": "seed"},
    "HistGradientBoostingClassifier": BOOSTED | {"max_iter": "trees", "max_leaf_nodes": "max_leaves", "l2_regularization": "l2", "min_samples_leaf": "min_rows", "class_weight": "balanced"},
    "GradientBoostingClassifier": BOOSTED | {"n_estimators": "trees", "subsample": "rows", "min_samples_leaf": "min_rows"},
    "XGBClassifier": BOOSTED | {"n_estimators": "trees", "subsample": "rows", "colsample_bytree": "columns", "gamma": "gamma", "reg_alpha": "l1", "reg_lambda": "l2", "min_child_weight": "min_weight", "scale_pos_weight": "positive_weight"},
    "LGBMClassifier": BOOSTED | {"n_estimators": "trees", "num_leaves": "max_leaves", "subsample": "rows", "colsample_bytree": "columns", "reg_alpha": "l1", "reg_lambda": "l2", "min_child_samples": "min_rows", "min_child_weight": "min_weight", "class_weight": "balanced", "scale_pos_weight": "positive_weight"},
    "LogisticRegression": LINEAR | {"penalty": "penalty", "l1_ratio": "elasticNetParam"}, "LinearSVC": LINEAR | {"loss": "loss"}, "GaussianNB": {"var_smoothing": "smoothing"},
    "KNeighborsClassifier": {"n_neighbors": "k", "metric": "metric", "weights": "weights", "p": "p"}, "LinearDiscriminantAnalysis": {"shrinkage": "shrinkage"}, "QuadraticDiscriminantAnalysis": {"reg_param": "reg_param"},
    "SVC": LINEAR | {"gamma": "gamma", "kernel": "kernel"}, "GaussianProcessClassifier": {"gamma": "gamma", "max_iter": "maxIter"}, "MLPClassifier": {"hidden_layer_sizes": "layers", "max_iter": "maxIter", "random_state": "seed"},
}
# What the models of grids take where a grid says nothing.
DEFAULTS = {
    "ExtraTreesClassifier": {"splitter": "random", "node_features": "sqrt"}, "ExtraTreeClassifier": {"trees": 1, "splitter": "random", "node_features": "sqrt"}, "BaggingClassifier": {"trees": 10, "bootstrap": True},
    "HistGradientBoostingClassifier": {"max_leaves": 31, "min_rows": 20}, "GradientBoostingClassifier": {"max_depth": 3}, "XGBClassifier": {"rate": 0.3, "max_depth": 6, "l2": 1.0, "min_weight": 1.0}, "LGBMClassifier": {"max_leaves": 31, "min_rows": 20},
}
STAND_INS = {
    "SVC": "with a Gaussian kernel, a linear machine over random Fourier features", "GaussianProcessClassifier": "a logistic model over random Fourier features of the Gaussian kernel",
    "MLPClassifier": "sigmoid units in place of rectified ones", "BaggingClassifier": "Poisson weights in place of draws of rows", "GradientBoostingClassifier": "trees over bins",
}
#: Random features of a kernel; depth of a pyspark.ml tree that a grid leaves open, and its greatest.
KERNEL_FEATURES, OPEN_DEPTH, MOST_DEPTH = 512, 20, 30


def unused(name: str, params: dict) -> list[str]:
    """Parameters of a grid that the distributed model doesn't know, by either name."""
    return sorted(set(params) - set(PARAMETERS[name]) - set(PARAMETERS[name].values()))


def losses(name: str, params: dict) -> list[str]:
    """Parameters of a grid that the distributed model doesn't know, and those whose value it can't hold and replaces (name=value used)."""
    if name not in PARAMETERS:
        return []
    out = unused(name, params)
    if PARAMETERS[name] in (TREE, FOREST) and "max_depth" in params and (params["max_depth"] is None or params["max_depth"] > MOST_DEPTH):
        out.append(f"max_depth={translated(name, params, 1)['maxDepth']}")
    if PARAMETERS[name] is FOREST and isinstance(params.get("max_samples"), int):
        out.append("max_samples=1.0")
    if name == "LGBMClassifier" and "subsample" in params and not params.get("subsample_freq"):
        out.append("subsample=1.0")  # as in the original, where no row is left out unless a frequency is given
    return out


def translated(name: str, params: dict, n_rows: int) -> dict:
    """The distributed model's parameters."""
    known = {k: v for k, v in params.items() if k in PARAMETERS[name].values()} | {PARAMETERS[name][k]: v for k, v in params.items() if k in PARAMETERS[name]}
    if name in BOOSTED_KINDS or name in RANDOM_KINDS:
        out = DEFAULTS[name] | {k: v for k, v in known.items() if v is not None or k in ("max_depth", "max_leaves", "node_features")}
        if "balanced" in out:
            if out["balanced"] != "balanced" and out["balanced"] is not True:
                raise ValueError(f"class weights are balanced or none, not {out['balanced']}")
            out["balanced"] = True
        if name == "LGBMClassifier":
            out["max_depth"] = None if (out.get("max_depth") or -1) < 0 else out["max_depth"]
            if not params.get("subsample_freq"):
                out.pop("rows", None)
        if "rows" in out and isinstance(out["rows"], int):
            out["rows"] = 1.0 if out["rows"] == 1 else min(1.0, out["rows"] / max(n_rows, 1))
        return out
    out = {k: v for k, v in known.items() if v is not None and k not in ("C", "penalty", "impurity", "featureSubsetStrategy")}
    if "C" in known:
        out["regParam"] = 1.0 / (float(known["C"]) * max(n_rows, 1))
    if known.get("penalty") not in (None, "l1", "l2", "elasticnet"):
        raise ValueError(f"no such penalty: {known['penalty']}")
    if known.get("penalty") == "l1":
        out["elasticNetParam"] = 1.0
    if known.get("impurity") in ("gini", "entropy"):
        out["impurity"] = known["impurity"]
    if known.get("featureSubsetStrategy") in ("sqrt", "log2"):
        out["featureSubsetStrategy"] = known["featureSubsetStrategy"]
    if isinstance(out.get("subsamplingRate"), int):
        out["subsamplingRate"] = 1.0  # a number of rows is no rate
    if PARAMETERS[name] in (TREE, FOREST):
        depth = out.get("maxDepth") or OPEN_DEPTH
        out["maxDepth"] = min(MOST_DEPTH, int(depth)) if depth > 0 else OPEN_DEPTH
    return out


BOOSTED_KINDS = ("HistGradientBoostingClassifier", "GradientBoostingClassifier", "XGBClassifier", "LGBMClassifier")
RANDOM_KINDS = ("ExtraTreesClassifier", "ExtraTreeClassifier", "BaggingClassifier")


def _moments(df: DataFrame, x: str, y: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class its rows, sums and sums of products of its vectors; a task gives one row a class, the sum of those is as wide as the vectors squared."""

    def run(frames):
        sums: dict[int, list] = {}
        for frame in frames:
            for label, part in frame.groupby("y"):
                v = np.stack(part["x"].to_list())
                own = sums.setdefault(int(label), [0.0, 0.0, 0.0])
                own[0], own[1], own[2] = own[0] + len(v), own[1] + v.sum(0), own[2] + v.T @ v
        for label, (n, s, q) in sums.items():
            yield pd.DataFrame({"y": [label], "n": [n], "s": [s], "q": [q.ravel()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": frame["y"].iloc[:1], "n": [frame["n"].sum()], "s": [np.sum(np.stack(frame["s"].to_list()), 0)], "q": [np.sum(np.stack(frame["q"].to_list()), 0)]})

    schema = "y int, n double, s array<double>, q array<double>"
    rows = df.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y")).mapInPandas(run, schema)
    return {r["y"]: (r["n"], np.array(r["s"]), np.array(r["q"]).reshape(len(r["s"]), -1)) for r in rows.groupBy("y").applyInPandas(add, schema).collect()}


class Discriminant:
    """Linear (one covariance) or quadratic (one a class) discriminant analysis of two classes."""

    def __init__(self, linear: bool, shrinkage: float | str | None = None, reg_param: float = 0.0):
        self.linear, self.auto, self.reg = linear, shrinkage == "auto", float(reg_param)
        self.shrinkage = 0.0 if self.auto else float(shrinkage or 0.0)

    def _estimated(self, df: DataFrame, x: str, y: str, moments: dict) -> np.ndarray:
        """The common covariance, each class's shrunk towards a multiple of one by as much as loses least (Ledoit and Wolf), at unit variances."""
        means = {k: s / n for k, (n, s, _) in moments.items()}
        sizes = {k: (np.sqrt(np.maximum(np.diag(q) / n - (s / n) ** 2, 0))) for k, (n, s, q) in moments.items()}
        sizes = {k: np.where(v > 0, v, 1.0) for k, v in sizes.items()}

        def run(frames):
            total = {0: 0.0, 1: 0.0}
            for frame in frames:
                for label, part in frame.groupby("y"):
                    z = (np.stack(part["x"].to_list()) - means[int(label)]) / sizes[int(label)]
                    total[int(label)] += float((z * z).sum(1) @ (z * z).sum(1))
            yield pd.DataFrame({"y": list(total), "b": list(total.values())})

        rows = df.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y")).mapInPandas(run, "y int, b double").groupBy("y").agg(F.sum("b").alias("b")).collect()
        fourth, out, all_ = {r["y"]: r["b"] for r in rows}, 0.0, sum(n for n, _, _ in moments.values())
        for k, (n, s, q) in moments.items():
            cov = (q / n - np.outer(means[k], means[k])) / np.outer(sizes[k], sizes[k])
            p, mu = len(s), np.trace(cov) / len(s)
            spread = (cov * cov).sum()
            delta = (spread - 2 * mu * np.trace(cov) + p * mu * mu) / p
            share = min((fourth[k] / n - spread) / (p * n), delta) / delta if delta > 0 else 0.0
            out = out + n / all_ * ((1 - share) * cov + share * mu * np.eye(p)) * np.outer(sizes[k], sizes[k])
        return out

    def fit(self, df: DataFrame, x: str, y: str) -> Discriminant:
        moments = _moments(df, x, y)
        if sorted(moments) != [0, 1]:
            raise ValueError("two classes are needed")
        total = sum(n for n, _, _ in moments.values())
        scatter = {k: q - np.outer(s, s) / n for k, (n, s, q) in moments.items()}
        self.parts = []
        common = self._estimated(df, x, y, moments) if self.linear and self.auto else sum(scatter.values()) / total
        for k in (0, 1):
            n, s, _ = moments[k]
            cov = common if self.linear else (1 - self.reg) * scatter[k] / max(n - 1, 1) + self.reg * np.eye(len(s))
            if self.linear and self.shrinkage:
                cov = (1 - self.shrinkage) * cov + self.shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
            size, axes = np.linalg.eigh(cov)
            some = size > 1e-9 * max(size.max(), 1e-300)  # directions in which rows differ
            self.parts.append((s / n, axes[:, some] / np.sqrt(size[some]), float(np.log(size[some]).sum()), float(np.log(n / total))))
        return self

    def decide(self, v: np.ndarray) -> np.ndarray:
        """Log of the odds of class 1."""
        score = [prior - 0.5 * (((v - mean) @ white) ** 2).sum(1) - (0.0 if self.linear else 0.5 * log) for mean, white, log, prior in self.parts]
        return score[1] - score[0]

    def predicted(self, df: DataFrame, x: str) -> DataFrame:
        """df with prediction (0 or 1)."""
        return _predicted(df, x, self.decide)


def _predicted(df: DataFrame, x: str, decide) -> DataFrame:
    @F.pandas_udf("int")
    def class_of(v: pd.Series) -> pd.Series:
        return pd.Series((decide(np.stack(v.to_list())) > 0).astype(np.int32))

    return df.withColumn("prediction", class_of(F.col(x)))


class NaiveBayes:
    """Gaussian naive Bayes of two classes; variances get `smoothing` of the greatest variance of a feature."""

    def __init__(self, smoothing: float = 1e-9):
        self.smoothing = float(smoothing)

    def fit(self, df: DataFrame, x: str, y: str) -> NaiveBayes:
        """One pass of sums a place and class."""
        long = df.select(F.col(y).cast("int").alias("y"), F.posexplode(x).alias("i", "v"))
        rows = long.groupBy("y", "i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()  # two a feature
        if {r["y"] for r in rows} != {0, 1}:
            raise ValueError("two classes are needed")
        n, m, s = (np.array([[r[c] for r in sorted(rows, key=lambda r: r["i"]) if r["y"] == k] for k in (0, 1)], float) for c in "nms")
        share = n / n.sum(axis=0)
        mean = (share * m).sum(axis=0)
        self.mean, self.var = m, s + self.smoothing * float((share * (s + (m - mean) ** 2)).sum(axis=0).max())
        self.prior = np.log(share[:, 0])
        return self

    def decide(self, v: np.ndarray) -> np.ndarray:
        score = [p - 0.5 * (np.log(2 * np.pi * s).sum() + ((v - m) ** 2 / s).sum(axis=1)) for p, m, s in zip(self.prior, self.mean, self.var, strict=True)]
        return score[1] - score[0]

    def predicted(self, df: DataFrame, x: str) -> DataFrame:
        return _predicted(df, x, self.decide)


class _Descent:
    """L-BFGS of one convex function, a step at a time: ask() is where to look next, tell() what is there."""

    def __init__(self, width: int, steps: int, tol: float, memory: int = 10):
        self.w, self.steps, self.tol, self.memory = np.zeros(width), min(int(steps), 200), float(tol), memory
        self.loss, self.past, self.done, self.halved = None, [], False, 0

    def _way(self) -> np.ndarray:
        way, parts = -self.slope, []
        for s, g in reversed(self.past):
            parts.append(float(s @ way) / float(s @ g))
            way = way - parts[-1] * g
        if self.past:
            s, g = self.past[-1]
            way = way * float(s @ g) / float(g @ g)
        for (s, g), a in zip(self.past, reversed(parts), strict=True):
            way = way + (a - float(g @ way) / float(s @ g)) * s
        return way

    def ask(self) -> np.ndarray:
        return self.w if self.loss is None else self.w + self.far * self.way

    def tell(self, loss: float, slope: np.ndarray) -> None:
        if self.loss is None:
            self.loss, self.slope = loss, slope
        elif loss <= self.loss + 1e-4 * self.far * float(self.slope @ self.way):
            s, g = self.far * self.way, slope - self.slope
            if float(s @ g) > 1e-14:
                self.past = [*self.past, (s, g)][-self.memory :]
            self.w, self.loss, self.slope, self.halved = self.w + s, loss, slope, 0
            self.steps -= 1
        else:
            self.far, self.halved = self.far / 2, self.halved + 1
            self.done = self.halved > 30
            return
        self.done = self.steps <= 0 or np.abs(self.slope).max() <= self.tol
        self.way = self._way()
        self.far = 1.0 if self.past else 1.0 / max(1.0, float(np.abs(self.slope).sum()))


class Linear:
    """Linear models of several folds and settings at once: an iteration is one aggregate, however many there are.

    A setting is (loss, penalty, intercept, steps, tol): logistic or squared_hinge loss, half the penalty times the squared length of coefficients; of the
    squared hinge the intercept's too.
    """

    def __init__(self, settings: dict[int, list[tuple[str, float, bool, int, float]]]):
        self.settings = {(f, i): s for f, own in settings.items() for i, s in enumerate(own)}  # by fold and place

    @staticmethod
    def _each(loss: str, sign: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss and each row's slope by its margin."""
        if loss == "logistic":
            return float(np.logaddexp(0, -sign * m).sum()), -sign / (1 + np.exp(np.clip(sign * m, -500, 500)))
        short = np.maximum(1 - sign * m, 0)
        return float(short @ short), -2 * sign * short

    def fit(self, df: DataFrame, x: str, y: str, fold: str) -> Linear:
        """df: train rows with a number of a fold, y 0 or 1."""
        about = {r["f"]: (r["n"], r["w"]) for r in df.groupBy(F.col(fold).cast("int").alias("f")).agg(F.count("*").alias("n"), F.max(F.size(x)).alias("w"), F.count_distinct(y).alias("k")).collect() if r["k"] == 2}  # few
        ways = {(f, i): _Descent(about[f][1] + 1, steps, tol) for (f, i), (_, _, _, steps, tol) in self.settings.items() if f in about}
        rows, settings, each = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(fold).cast("int").alias("f")), self.settings, self._each
        while open_ := {k: d.ask() for k, d in ways.items() if not d.done}:

            def sums(frames, open_=open_):
                total: dict = {}
                for frame in frames:
                    for f, part in frame.groupby("f"):
                        own = [(i, w) for (g, i), w in open_.items() if g == f]
                        if not own:
                            continue
                        v = np.stack(part["x"].to_list())
                        v, sign = np.hstack([v, np.ones((len(v), 1))]), np.where(part["y"].to_numpy() > 0, 1.0, -1.0)
                        at = np.stack([w * np.append(np.ones(len(w) - 1), settings[f, i][2]) for i, w in own], axis=1)
                        margins = v @ at
                        found = [each(settings[f, i][0], sign, margins[:, k]) for k, (i, _) in enumerate(own)]
                        slopes = v.T @ np.stack([s for _, s in found], axis=1)
                        for k, (i, _) in enumerate(own):
                            total[f, i] = total.get((f, i), 0) + np.append(slopes[:, k], found[k][0])
                for (f, i), s in total.items():
                    yield pd.DataFrame({"f": f, "i": i, "j": np.arange(len(s)), "v": s})

            added = rows.mapInPandas(sums, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # as many as coefficients
            for (f, i), own in added.groupby(["f", "i"]):
                s, n, w = own.sort_values("j")["v"].to_numpy(), about[f][0], open_[f, i]
                loss, penalty, intercept, _, _ = self.settings[f, i]
                held = np.append(np.ones(len(w) - 1), float(intercept and loss == "squared_hinge"))  # what is penalised
                slope = s[:-1] / n * np.append(np.ones(len(w) - 1), float(intercept))
                ways[f, i].tell(s[-1] / n + 0.5 * penalty * float((w * held) @ w), slope + penalty * w * held)
        self.models = {k: d.w * np.append(np.ones(len(d.w) - 1), float(self.settings[k][2])) for k, d in ways.items()}
        return self

    def predicted(self, df: DataFrame, x: str, fold: str) -> DataFrame:
        """df with prediction, an array of a class for each setting, null where a fold couldn't be fitted."""
        held, count = df.sparkSession.sparkContext.broadcast(self.models), 1 + max((i for _, i in self.settings), default=-1)

        @F.pandas_udf("array<int>")
        def classes(v: pd.Series, f: pd.Series) -> pd.Series:
            out: list = [None] * len(v)
            for own in f.unique():
                some = np.flatnonzero(f.to_numpy() == own)
                if (own, 0) in held.value:
                    w = np.stack([held.value[own, i] for i in range(count)], axis=1)
                    m = np.stack(v.iloc[some].to_list())
                    for at, row in zip(some, (m @ w[:-1] + w[-1] > 0).astype(np.int32), strict=True):
                        out[at] = row.tolist()
            return pd.Series(out, dtype=object)

        return df.withColumn("prediction", classes(F.col(x), F.col(fold).cast("int")))


class SquaredHinge:
    """A linear machine whose loss is the square of the hinge, with half the squared length of all coefficients."""

    def __init__(self, regParam: float = 1.0, maxIter: int = 1000, tol: float = 1e-4, fitIntercept: bool = True):  # noqa: N803
        self.model = Linear({0: [("squared_hinge", float(regParam), bool(fitIntercept), int(maxIter), float(tol) * 1e-2)]})

    def fit(self, df: DataFrame, x: str, y: str) -> SquaredHinge:
        self.model.fit(df.withColumn("_fold", F.lit(0)), x, y, "_fold")
        if not self.model.models:
            raise ValueError("two classes are needed")
        self.w = self.model.models[0, 0]
        return self

    def decide(self, v: np.ndarray) -> np.ndarray:
        return v @ self.w[:-1] + self.w[-1]

    def predicted(self, df: DataFrame, x: str) -> DataFrame:
        return _predicted(df, x, self.decide)


def linear_setting(name: str, settings: dict) -> tuple[str, float, bool, int, float] | None:
    """The setting of Linear that a configuration's parameters (translated) come to, if it is one that many can be fitted of at once."""
    known = {"regParam", "maxIter", "tol", "fitIntercept", "loss"}
    if set(settings) - known or name not in ("LogisticRegression", "LinearSVC"):
        return None
    loss = settings.get("loss", "squared_hinge") if name == "LinearSVC" else "logistic"
    if loss not in ("logistic", "squared_hinge"):
        return None
    tol = float(settings.get("tol", 1e-4 if name == "LinearSVC" else 1e-6)) * (1e-2 if name == "LinearSVC" else 1)
    return loss, float(settings.get("regParam", 0.0)), bool(settings.get("fitIntercept", True)), int(settings.get("maxIter", 1000 if name == "LinearSVC" else 100)), tol


def kernel_map(fit_on: DataFrame, x: str, gamma: float | str, n: int = KERNEL_FEATURES, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """What replaces a table's x by n random features whose products are close to the Gaussian kernel; gamma "scale" is one over width and variance."""
    width = fit_on.select(F.size(x)).first()[0]
    if gamma in ("scale", "auto", None):
        spread = 1.0
        if gamma != "auto":
            flat = fit_on.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0]
            spread = flat if flat and flat > 0 else 1.0
        gamma = 1.0 / (width * spread)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * float(gamma)), size=(width, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def turned(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2.0 / n) * np.cos(np.stack(v.to_list()) @ w + b)))

    return lambda df: df.withColumn(x, turned(F.col(x)))
