"""Scaling, models and metrics on folds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce as reduce_left
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import stats, vectors
from corvane.operators import geometry, models, trees
from corvane.session import checkpointed

#: Scalers by name; normalizer_l2 is another name of l2.
SCALERS = ("none", "standard", "minmax", "maxabs", "robust", "l1", "l2", "max", "quantile", "power", "normalizer_l2")
METRICS = ("accuracy", "precision", "recall", "f1", "mcc")


def _statistics(df: DataFrame, vector: str, scaler: str) -> DataFrame:
    """center and spread of each place, as one row of two arrays."""
    x = F.col("x")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    center, spread = {
        "standard": (F.avg(x), F.stddev_pop(x)),
        "minmax": (F.min(x), F.max(x) - F.min(x)),
        "maxabs": (F.lit(0.0), F.max(F.abs(x))),
        "robust": (F.get(q, F.lit(1)), F.get(q, F.lit(2)) - F.get(q, F.lit(0))),
    }[scaler]
    each = df.select(F.posexplode(vectors.doubles(F.col(vector))).alias("i", "x")).groupBy("i").agg(center.alias("c"), spread.alias("s"))
    each = each.withColumn("s", F.when((F.col("s") == 0) | F.col("s").isNull(), 1.0).otherwise(F.col("s")))
    return each.agg(F.array_sort(F.collect_list(F.struct("i", "c", "s"))).alias("_fit"))


def scaled(df: DataFrame, vector: str, scaler: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """df with its vector scaled; what is learned is learned from fit_on (the train rows), population deviation, a constant place left as it is."""
    v, scaler = vectors.doubles(F.col(vector)), "l2" if scaler == "normalizer_l2" else scaler
    if scaler in ("none", None):
        return df
    if scaler in ("l1", "l2", "max"):
        size = {"l1": F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), "l2": vectors.norm(v), "max": F.array_max(F.transform(v, F.abs))}[scaler]
        return df.withColumn(vector, F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(1.0)))
    if scaler == "quantile":
        return _quantile(df, vector, fit_on if fit_on is not None else df)
    if scaler == "power":
        return _power(df, vector, fit_on if fit_on is not None else df)
    fit = _statistics(fit_on if fit_on is not None else df, vector, scaler)  # one row
    return df.crossJoin(F.broadcast(fit)).withColumn(vector, F.zip_with(v, F.col("_fit"), lambda x, f: (x - f["c"]) / f["s"])).drop("_fit")


def _quantile(df: DataFrame, vector: str, fit_on: DataFrame, points: int = 1000) -> DataFrame:
    """Each number's place among the train rows' quantiles, 0 to 1: the share of points + 1 quantiles below it, found by bisection.

    Quantiles are values of train rows whose ranks are off by a ten-thousandth of the rows at most.  An empty place has none.
    """
    grid = F.percentile_approx("x", F.array(*(F.lit(i / points) for i in range(points + 1))), F.lit(10000))
    rows = fit_on.select(F.posexplode(vectors.doubles(F.col(vector))).alias("i", "x")).groupBy("i").agg(grid.alias("q")).collect()  # one a place
    found = {r["i"]: np.array(r["q"] or [], float) for r in rows}
    held = df.sparkSession.sparkContext.broadcast([found.get(i, np.zeros(0)) for i in range(max(found, default=-1) + 1)])

    @F.pandas_udf("array<double>")
    def placed(v: pd.Series) -> pd.Series:
        whole = lambda x: None if x is None else [None if n is None or n != n else np.searchsorted(q, n) / (points + 1.0) for n, q in zip(x, held.value, strict=False)]
        if not len(v) or any(x is None or len(x) != len(held.value) or not np.isfinite(np.asarray(x, float)).all() for x in v):
            return v.map(whole)
        m = np.stack(v.to_list()).astype(float)
        out = np.stack([np.searchsorted(q, m[:, i]) / (points + 1.0) for i, q in enumerate(held.value)], axis=1)
        return pd.Series(list(out))

    return df.withColumn(vector, placed(vectors.doubles(F.col(vector))))


def yeo_johnson(x: Column, power: Column) -> Column:
    """The power transform of numbers of either sign."""
    up = F.when(F.abs(power) < 1e-9, F.log1p(x)).otherwise((F.pow(1 + x, power) - 1) / power)
    down = F.when(F.abs(power - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - power) - 1) / (2 - power))
    return F.when(x >= 0, up).otherwise(down)


def _power(df: DataFrame, vector: str, fit_on: DataFrame, low: float = -4.0, high: float = 6.0, tries: int = 11, passes: int = 6) -> DataFrame:
    """Each place by its Yeo-Johnson power of greatest likelihood on the train rows, then standardised.

    A pass holds `tries` powers of each place against one another in one aggregate, and the next looks between the neighbours of the best.
    """
    long = fit_on.select(F.posexplode(vectors.doubles(F.col(vector))).alias("i", "x"))
    grid, step = long.select("i").distinct().select("i", F.lit(low).alias("lo")), (high - low) / (tries - 1)
    for turn in range(passes):
        powers = [F.col("lo") + k * step for k in range(tries)]
        drift = F.sum(F.signum("x") * F.log1p(F.abs("x")))
        fits = [(-F.count("x") / 2 * F.log(F.greatest(F.var_pop(yeo_johnson(F.col("x"), p)), F.lit(1e-300))) + (F.first(p) - 1) * drift).alias(f"fit{k}") for k, p in enumerate(powers)]
        best = long.join(F.broadcast(grid), "i").groupBy("i", "lo").agg(*fits)  # as many rows as a vector has places
        at = F.array_position(F.array(*(f"fit{k}" for k in range(tries))), F.greatest(*(f"fit{k}" for k in range(tries)))).cast("double") - 1
        found = best.select("i", (F.col("lo") + at * step).alias("power")).collect()
        if turn < passes - 1:
            grid = df.sparkSession.createDataFrame([(r["i"], max(low, r["power"] - step)) for r in found], "i int, lo double")
            step = 2 * step / (tries - 1)
    powers = F.array(*(F.lit(float(p)) for _, p in sorted((r["i"], r["power"]) for r in found)))
    turned = lambda rows: rows.withColumn(vector, F.zip_with(vectors.doubles(F.col(vector)), powers, yeo_johnson))
    return scaled(turned(df), vector, "standard", turned(fit_on))


def metrics(df: DataFrame, truth: str, predicted: str, by: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(c.alias(n) for n, c in stats.confusion(F.col(truth), F.col(predicted)).items()))


def model(name: str, features: str = "features", label: str = "label", **settings):
    """A classifier of pyspark.ml by the usual name of its kind."""
    from pyspark.ml import classification as c

    forest = c.RandomForestClassifier
    kinds = {"LogisticRegression": c.LogisticRegression, "RandomForestClassifier": forest, "DecisionTreeClassifier": c.DecisionTreeClassifier, "LinearSVC": c.LinearSVC, "SVC": c.LinearSVC, "GaussianProcessClassifier": c.LogisticRegression, "MLPClassifier": c.MultilayerPerceptronClassifier}
    if name not in kinds:
        raise ValueError(f"no distributed model of the name {name}; there are {', '.join(sorted({*kinds, *models.PARAMETERS}))}")
    if kinds[name] in (forest, c.DecisionTreeClassifier):
        settings.setdefault("seed", 0)
    if kinds[name] in (c.LogisticRegression, c.LinearSVC):
        settings.setdefault("standardization", False)  # penalties are of the coefficients as they are
    return kinds[name](featuresCol=features, labelCol=label, **settings)


def _neighbour_setting(k: int = 5, metric: str = "minkowski", weights: str = "uniform", p: float = 2) -> tuple[str, tuple[int, str]]:
    """Metric and (k, weights) that a configuration's parameters (translated) come to."""
    metric = {"minkowski": {2: "euclidean"}.get(p, f"minkowski of {p}")}.get(metric, metric)
    if metric not in ("euclidean", "cosine") or weights not in ("uniform", "distance"):
        raise ValueError(f"neighbours are by euclidean or cosine distance, weighted uniform or by distance, not {metric}, {weights}")
    if int(k) < 1:
        raise ValueError(f"one neighbour at least, not {k}")
    return metric, (int(k), weights)


def _neighbours(train: DataFrame, test: DataFrame, **settings) -> DataFrame:
    metric, (k, weights) = _neighbour_setting(**settings)
    votes = geometry.knn_vote(test, train, "_key", "_x", "_y", k, metric, weights)
    return test.join(votes.select(F.col("key").alias("_key"), F.col("predicted").alias("prediction")), "_key")


def _predicted(train: DataFrame, test: DataFrame, name: str, settings: dict) -> DataFrame:
    """test with prediction, by a model of train; both have _x (doubles), _y (0.0 or 1.0) and _key."""
    from pyspark.ml.functions import array_to_vector

    settings, dear = dict(settings), False  # dear: features that cost more to make again than to hold
    if name == "KNeighborsClassifier":
        return _neighbours(train, test, **settings)
    if name in ("LinearDiscriminantAnalysis", "QuadraticDiscriminantAnalysis"):
        return models.Discriminant(name.startswith("Linear"), **settings).fit(train, "_x", "_y").predicted(test, "_x")
    if name == "GaussianNB":
        return models.NaiveBayes(**settings).fit(train, "_x", "_y").predicted(test, "_x")
    if name in models.BOOSTED_KINDS or name in models.RANDOM_KINDS:
        kind = trees.Boosted if name in models.BOOSTED_KINDS else trees.Forest
        return kind(**settings).fit(train, "_key", "_x", "_y", checkpointed).predicted(test, "_x")
    if name == "LinearSVC":
        loss = settings.pop("loss", "squared_hinge")
        if loss not in ("hinge", "squared_hinge"):
            raise ValueError(f"no such loss: {loss}")
        if loss == "squared_hinge":
            return models.SquaredHinge(**settings).fit(train, "_x", "_y").predicted(test, "_x")
    if name == "SVC" and settings.get("kernel", "rbf") not in ("rbf", "linear"):
        raise ValueError(f"no such kernel: {settings['kernel']}")
    if name == "GaussianProcessClassifier" or name == "SVC" and settings.pop("kernel", "rbf") == "rbf":
        turned = models.kernel_map(train, "_x", settings.pop("gamma", "scale"))
        train, test, dear = turned(train), turned(test), True
    settings.pop("gamma", None)  # of no kernel
    if name == "MLPClassifier":
        hidden = settings.pop("layers", (100,))
        settings["layers"] = [train.select(F.size("_x")).first()[0], *([hidden] if isinstance(hidden, int) else hidden), 2]
        settings.setdefault("seed", 0)
    ready = train.select("_y", array_to_vector("_x").alias("_v"))
    if dear:
        ready = ready.persist(StorageLevel.MEMORY_AND_DISK)  # read by the summary of features and by the fit
    try:
        fit = model(name, "_v", "_y", **settings).fit(ready)
    finally:
        if dear:
            ready.unpersist()
    out = fit.transform(test.withColumn("_v", array_to_vector("_x")))
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def _ready(df: DataFrame, train: DataFrame, vector: str, label: str, scaler: str) -> DataFrame:
    out = scaled(df, vector, scaler, fit_on=train)
    return out.withColumns({"_x": vectors.doubles(F.col(vector)), "_y": F.coalesce((F.col(label) == 1).cast("double"), F.lit(0.0))})


def fitted(train: DataFrame, test: DataFrame, vector: str, label: str, name: str, scaler: str = "none", key: str | None = None, **settings) -> DataFrame:
    """test with prediction; scaler and model learn from train only; a label other than 1 counts as 0.  key: unique on either side, for neighbours' votes."""
    one, two = (_ready(df, train, vector, label, scaler).withColumn("_key", F.col(key) if key else F.lit(None)) for df in (train, test))
    return _predicted(one, two, name, settings).select(*test.columns, "prediction")


def _of_folds(folds: list, scaler: str, ready: dict) -> DataFrame:
    """The scaled rows of all folds, with a fold's number."""
    return reduce_left(DataFrame.unionByName, (ready[f, scaler][0].withColumn("_fold", F.lit(i)) for i, f in enumerate(folds)))


def _told(judged: DataFrame, folds: list, scaler: str, order: list[int], result: Callable) -> set:
    """Results of the configurations in order, of rows with _fold, part, _t and an array of predictions; which (fold, scaler, configuration) these are."""
    judged = judged.select("_fold", "part", "_t", F.posexplode("prediction").alias("_at", "prediction"))
    found: dict = {}
    for r in metrics(judged, "_t", "prediction", ["_fold", "_at", "part"]).collect():  # few
        found.setdefault((r["_fold"], r["_at"]), {})[r["part"]] = r
    for (i, k), parts in found.items():
        result(folds[i], scaler, order[k], parts)
    return {(folds[i], scaler, order[k]) for i, k in found}


def _linear_results(configurations: list[dict], folds: list, scalers: Iterable[str], ready: dict, result: Callable) -> set:
    """Results of the linear configurations, of all folds of a scaler fitted and judged at once; which (fold, scaler, configuration) these are."""
    done = set()
    for scaler in scalers:
        settings: dict[int, list] = {}
        for at, c in enumerate(configurations):
            try:
                own = [models.linear_setting(c["algorithm"], models.translated(c["algorithm"], c.get("params", {}), ready[f, scaler][1]["train"][0])) for f in folds]
            except Exception:
                continue  # told where configurations go one by one
            if own and all(s is not None for s in own):
                settings[at] = own
        if not settings:
            continue
        every, order = _of_folds(folds, scaler, ready), sorted(settings)
        model = models.Linear({i: [settings[at][i] for at in order] for i in range(len(folds))}).fit(every.where("part = 'train'"), "_x", "_y", "_fold")
        judged = model.predicted(every.where("part <> 'train'"), "_x", "_fold").where("prediction is not null")
        done |= _told(judged.withColumn("_t", F.col("_y").cast("int")), folds, scaler, order, result)
    return done


def _neighbour_results(configurations: list[dict], folds: list, scalers: Iterable[str], ready: dict, result: Callable) -> set:
    """Results of the neighbours' votes, of all folds and configurations of a scaler and metric from one search; which (fold, scaler, configuration) these are."""
    asked: dict[str, dict[int, tuple]] = {}
    for at, c in enumerate(configurations):
        if c["algorithm"] == "KNeighborsClassifier":
            try:
                metric, setting = _neighbour_setting(**models.translated(c["algorithm"], c.get("params", {}), 1))
            except Exception:
                continue  # told where configurations go one by one
            asked.setdefault(metric, {})[at] = setting
    done = set()
    for scaler in scalers:
        for metric, settings in asked.items():
            every, order = _of_folds(folds, scaler, ready), sorted(settings)
            rest = every.where("part <> 'train'")
            votes = geometry.knn_votes(rest, every.where("part = 'train'"), "_key", "_x", "_y", [settings[at] for at in order], metric, ["_fold"])
            judged = rest.select("_fold", "_key", "part", F.col("_y").cast("int").alias("_t")).join(votes.withColumnRenamed("key", "_key"), ["_fold", "_key"])
            done |= _told(judged.withColumn("prediction", F.col("votes.predicted")), folds, scaler, order, result)
    return done


def trained_by_fold(df: DataFrame, key: str, vector: str, label: str, configurations: list[dict], keep: Callable[[DataFrame], DataFrame], scalers: Iterable[str] = ("none",), at_once: int = 4, **tags) -> tuple[DataFrame, DataFrame]:
    """Fold results of each configuration {"algorithm", "params"} with each scaler, and the configurations that failed (fold, cfg_idx, scaler, error).

    df is a long table of assignments with fold, part (train, val, test), features and label.  A scaler is fitted once a fold, on its train rows, and
    its scaled rows are written (keep).  Logistic models and machines of squared hinge loss are fitted all at once, of all folds, and so are neighbours searched;
    the other configurations share a fold's rows, at_once of them at a time.  One that fails is listed and doesn't end the others.
    params have the names of training grids, and lost_params lists those of a configuration that change nothing or are replaced; tags are constant columns.
    """
    spark, done, failed = df.sparkSession, [], []
    folds = [r["fold"] for r in df.select("fold").distinct().orderBy("fold").collect()]  # few
    width = df.select(F.size(vector)).first()
    ready = {}
    for fold in folds:
        own = df.where(F.col("fold") == fold).select(F.col(key).alias("_key"), "part", F.col(vector).alias(vector), label)
        for scaler in scalers:
            rows = keep(_ready(own, own.where("part = 'train'"), vector, label, scaler).select("_key", "part", "_x", "_y"))
            counts = {r["part"]: (r["n"], int(r["k"])) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("_y").alias("k")).collect()}
            ready[fold, scaler] = rows, counts

    def result(fold, scaler, at: int, found: dict) -> None:
        c, counts = configurations[at], ready[fold, scaler][1]
        row = {"fold": fold, "cfg_idx": at, "algorithm": c["algorithm"], "config": json.dumps(c.get("params", {}), sort_keys=True), "scaler": scaler, "n_features": width[0], "lost_params": ",".join(models.losses(c["algorithm"], c.get("params", {})))}
        for p in ("train", "val", "test"):
            n, k = counts.get(p, (0, 0))
            row |= {f"n_{p}": n, f"{p}_pos": k, f"{p}_neg": n - k}
        for p in ("val", "test"):
            row |= {f"{m}_{p}": float(found[p][m]) if p in found else None for m in METRICS}
        done.append(row)

    together = _linear_results(configurations, folds, scalers, ready, result) | _neighbour_results(configurations, folds, scalers, ready, result)
    for (fold, scaler), (rows, counts) in ready.items():
        train, asked = rows.where("part = 'train'"), rows.where("part <> 'train'")

        def one(at: int, fold=fold, scaler=scaler, train=train, asked=asked, counts=counts):
            c = configurations[at]
            if (fold, scaler, at) in together:
                return
            try:
                settings = models.translated(c["algorithm"], c.get("params", {}), counts["train"][0])
                found = _predicted(train, asked, c["algorithm"], settings).withColumn("_t", F.col("_y").cast("int"))
                result(fold, scaler, at, {r["part"]: r for r in metrics(found, "_t", "prediction", ["part"]).collect()})
            except Exception as error:
                failed.append((fold, at, scaler, c.get("algorithm"), f"{type(error).__name__}: {error}"[:500]))

        with ThreadPool(max(1, min(at_once, len(configurations)))) as pool:
            pool.map(one, range(len(configurations)))
    if not done:
        raise RuntimeError(f"no configuration gave results: {failed[:3]}")
    done.sort(key=lambda r: (r["fold"], r["scaler"], r["cfg_idx"]))
    kind = {"fold": dict(df.dtypes)["fold"], "algorithm": "string", "config": "string", "scaler": "string", "lost_params": "string"}
    schema = ", ".join(f"{c} {kind.get(c, 'double' if c.endswith(('_val', '_test')) and not c.startswith('n_') else 'long')}" for c in done[0])
    out = spark.createDataFrame([tuple(r.values()) for r in done], schema).withColumns({k: F.lit(v) for k, v in tags.items()})
    return out, spark.createDataFrame(sorted(failed), f"fold {kind['fold']}, cfg_idx long, scaler string, algorithm string, error string")


def evaluated(df: DataFrame, vector: str, label: str, fold: int, configurations: list[dict], scaler: str = "none") -> tuple[list[dict], list[dict]]:
    """trained_by_fold() of one fold (df with part and unique rows) as plain rows; without any result both lists tell."""
    rows = df.withColumns({"fold": F.lit(fold), "_id": F.monotonically_increasing_id()})
    try:
        done, failed = trained_by_fold(rows, "_id", vector, label, configurations, checkpointed, [scaler])
    except RuntimeError as error:
        return [], [{"cfg_idx": i, "algorithm": c.get("algorithm"), "error": str(error)[:500]} for i, c in enumerate(configurations)]
    return [r.asDict() for r in done.collect()], [{k: r[k] for k in ("cfg_idx", "algorithm", "error")} for r in failed.collect()]


def grids(document: dict, algorithm: str | None = None) -> list[dict]:
    """Configurations of a grid document {"param_grids": {algorithm: [params, ..]}}, of one algorithm or all; a dict of lists stands for all its combinations."""
    found = document.get("param_grids", document)
    if algorithm is not None and algorithm not in found:
        raise ValueError(f"no grid for {algorithm}; there are {', '.join(sorted(found))}")
    out = []
    for name, params in found.items():
        if algorithm in (None, name):
            out += configurations({name: params}) if isinstance(params, dict) else [{"algorithm": name, "params": p} for p in params]
    return out


def configurations(grid: dict[str, dict[str, list]]) -> list[dict]:
    """Every combination of each algorithm's parameter lists."""
    out = []
    for algorithm, params in grid.items():
        rows = [{}]
        for name, values in params.items():
            rows = [r | {name: v} for r in rows for v in values]
        out += [{"algorithm": algorithm, "params": r} for r in rows]
    return out


def principal_components(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with pca (k coordinates; signs are arbitrary) and the variance each explains."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("_x", array_to_vector(vectors.doubles(F.col(vector))))
    fit = PCA(k=k, inputCol="_x", outputCol="_p").fit(ready)
    return fit.transform(ready).withColumn("pca", vector_to_array("_p")).drop("_x", "_p"), fit.explainedVariance.toArray().tolist()
