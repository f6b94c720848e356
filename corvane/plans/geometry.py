"""Queries over vectors: pairs, ladders, nearest neighbours, scaling, reduction, clusters, votes."""

from __future__ import annotations

from functools import reduce as reduce_left

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import vectors
from corvane.operators import cluster, geometry, reduce, results, training
from corvane.plans.registry import registry
from corvane.plans.tables import r, read, rounded
from corvane.session import checkpointed

QUERIES, ORACLES, query = registry()
PERCENTS = [30.0, 40.0, 50.0, 60.0, 70.0, 75.0, 80.0, 85.0, 90.0, 95.0, 97.5, 99.0, 99.9]
LIMITS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4]
_DOUBLES = lambda xs: "[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "]"
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_P = f"{_E}, p AS (SELECT a.vec_id AS key_a, b.vec_id AS key_b, a.label = b.label AS same_label, list_cosine_similarity(a.v, b.v) AS value FROM e a JOIN e b ON a.vec_id < b.vec_id)"
_D = f"{_E}, p AS (SELECT a.vec_id AS key_a, b.vec_id AS key_b, a.label = b.label AS same_label, list_distance(a.v, b.v) AS value FROM e a JOIN e b ON a.vec_id < b.vec_id)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    return read(spark, sf_dir, "embeddings"), "vec_id", "embedding"


def _described(value: str = "value") -> str:
    q = lambda p: f"quantile_cont({value}, {p}::DOUBLE)"
    return f"count({value})::BIGINT AS n, {r(f'avg({value})')} AS mean, {r(f'stddev_samp({value})')} AS std, {r(f'min({value})')} AS minimum, {r(q(0.25))} AS p25, {r(q(0.5))} AS p50, {r(q(0.75))} AS p75, {r(f'max({value})')} AS maximum"


@query(f"WITH {_P} SELECT count(*)::BIGINT AS n_pairs, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS minimum, {r('max(value)')} AS maximum FROM p")
def pair_similarity_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V4, J18, A15."""
    return rounded(geometry.pair_summary_of(*_vectors(spark, sf_dir)))


@query(f"WITH {_D} SELECT count(*)::BIGINT AS n_pairs, {r('avg(value)', 5)} AS mean, {r('stddev_pop(value)', 5)} AS std, {r('min(value)', 5)} AS minimum, {r('max(value)', 5)} AS maximum FROM p")
def pair_distance_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, A15."""
    return rounded(geometry.pair_summary_of(*_vectors(spark, sf_dir), "euclidean"), 5)


@query(f"WITH {_P}, q AS (SELECT quantile_cont(value, {_DOUBLES(p / 100 for p in PERCENTS)}) AS q FROM p) SELECT unnest({_DOUBLES(PERCENTS)}) AS percentile, (round(unnest(q), 6) + 0::DOUBLE) AS threshold FROM q")
def pair_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return rounded(geometry.pair_percentiles(*_vectors(spark, sf_dir), PERCENTS))


@query(f"WITH {_P}, t AS (SELECT unnest({_DOUBLES(LIMITS)}) AS threshold) SELECT threshold, count(*) FILTER (value >= threshold)::BIGINT AS n_pairs, {r('count(*) FILTER (value >= threshold) / count(*)')} AS fraction FROM p CROSS JOIN t GROUP BY ALL")
def pair_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return rounded(geometry.pair_thresholds(*_vectors(spark, sf_dir), LIMITS))


@query(f"WITH {_P} SELECT CASE WHEN same_label THEN 'same_label' ELSE 'different_label' END AS pair_type, {_described()} FROM p GROUP BY ALL")
def pair_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A16."""
    return rounded(geometry.pair_types(*_vectors(spark, sf_dir), "label"))


@query(f"WITH {_D}, q AS (SELECT quantile_cont(value, {_DOUBLES((100 - p) / 100 for p in PERCENTS)}) AS q FROM p) SELECT unnest({_DOUBLES(PERCENTS)}) AS reduction_percentile, {r('100 - unnest(' + _DOUBLES(PERCENTS) + ')')} AS distance_percentile, (round(unnest(q), 5) + 0::DOUBLE) AS distance_threshold FROM q")
def euclidean_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return rounded(geometry.complementary_pairs(*_vectors(spark, sf_dir), PERCENTS, "euclidean"), 5)


@query(f"WITH {_P}, b AS (SELECT least(floor((value + 0.6::DOUBLE) / 1.2::DOUBLE * 90), 89)::INTEGER AS bin, count(*) AS n FROM p WHERE value BETWEEN -0.6::DOUBLE AND 0.6::DOUBLE GROUP BY ALL), f AS (SELECT bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM range(90) g(bin) LEFT JOIN b USING (bin)), s AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5::DOUBLE AS smooth FROM f) SELECT bin, n, {r('smooth')} AS smooth, {r('smooth / max(smooth) OVER ()')} AS density FROM s")
def smoothed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A52, W7."""
    return rounded(results.smoothed(geometry.pair_histogram(*_vectors(spark, sf_dir), -0.6, 0.6)))


@query(f"WITH {_E}, x AS (SELECT unnest(v) AS x FROM e) SELECT (SELECT count(*) FROM e)::BIGINT AS n, (SELECT max(len(v)) FROM e)::INTEGER AS n_features, {r('min(x)')} AS minimum, {r('max(x)')} AS maximum, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std FROM x")
def embedding_value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return rounded(geometry.value_summary(read(spark, sf_dir, "embeddings"), "embedding"))


def _digest(df: DataFrame) -> DataFrame:
    """Three numbers of each vector, so that whole vectors need not be compared as text."""
    v = F.col("embedding")
    return rounded(df.select("vec_id", F.get(v, F.lit(0)).alias("first"), F.get(v, F.lit(63)).alias("last"), F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)).alias("total")), 5)


def _digest_sql(ctes: str) -> str:
    return f"WITH {_E}, {ctes} SELECT vec_id, {r('v[1]', 5)} AS first, {r('v[64]', 5)} AS last, {r('list_sum([abs(x) FOR x IN v])', 5)} AS total FROM s"


@query(_digest_sql("s AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM e)"))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V12."""
    return _digest(geometry.normalized(read(spark, sf_dir, "embeddings"), "embedding"))


def _scaled_sql(center: str, spread: str) -> str:
    return _digest_sql(f"x AS (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM e), f AS (SELECT i, {center} AS c, {spread} AS s FROM x GROUP BY i), s AS (SELECT vec_id, list((x - c) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS v FROM x JOIN f USING (i) GROUP BY vec_id)")


@query(_scaled_sql("min(x)", "max(x) - min(x)"))
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "minmax"))


@query(_scaled_sql("avg(x)", "stddev_pop(x)"))
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "standard"))


@query(_scaled_sql("median(x)", "quantile_cont(x, 0.75::DOUBLE) - quantile_cont(x, 0.25::DOUBLE)"))
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "robust"))


@query(_scaled_sql("0::DOUBLE", "max(abs(x))"))
def maxabs_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "maxabs"))


def _normed_sql(size: str) -> str:
    return _digest_sql(f"s AS (SELECT vec_id, [x / {size} FOR x IN v] AS v FROM e)")


@query(_normed_sql("list_sum([abs(y) FOR y IN v])"))
def l1_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "l1"))


@query(_normed_sql("list_max([abs(y) FOR y IN v])"))
def max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "max"))


@query(_normed_sql("sqrt(list_dot_product(v, v))"))
def l2_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12, by the name that training uses."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "normalizer_l2"))


@query()
def power_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yeo-Johnson; a test holds the powers against a search in numpy."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "power"))


_QUANTILES = "u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), q AS (SELECT i, quantile_disc(x, [" + ", ".join(f"{k / 1000}::DOUBLE" for k in range(1001)) + "]) AS q FROM u GROUP BY i), s AS (SELECT vec_id, list(z ORDER BY i) AS v FROM (SELECT vec_id, u.i, len(list_filter(q, lambda y: y < x)) / 1001::DOUBLE AS z FROM u JOIN q USING (i)) GROUP BY vec_id)"


@query(_digest_sql(_QUANTILES))
def quantile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among quantiles."""
    return _digest(training.scaled(read(spark, sf_dir, "embeddings"), "embedding", "quantile"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's nearest one of another fold, by both strategies' folds: by id (random), and by label block (distance)."""
    return geometry.nearest_of_other_folds(*_vectors(spark, sf_dir), {"random": F.col("vec_id") % 5, "distance": F.floor(F.col("label") / 2)})


_F = f"{_E}, f AS (SELECT vec_id, v, 'random' AS strategy, (vec_id % 5)::INTEGER AS fold FROM e UNION ALL SELECT vec_id, v, 'distance', floor(label / 2)::INTEGER FROM e), n AS (SELECT a.strategy, a.fold, a.vec_id, max(round(list_cosine_similarity(a.v, b.v), 9)) AS value FROM f a JOIN f b ON a.strategy = b.strategy AND a.fold <> b.fold GROUP BY ALL)"


@query(f"WITH {_F} SELECT strategy, fold, vec_id, {r('value')} AS max_similarity FROM n")
def nearest_train_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6, J17."""
    return rounded(_nearest(spark, sf_dir).select("strategy", "fold", F.col("key").alias("vec_id"), F.col("value").alias("max_similarity")))


_QS = ", ".join(f"{r(f'quantile_cont(value, {p}::DOUBLE)')} AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))


@query(f"WITH {_F} SELECT strategy, fold, {r('avg(value)')} AS mean, {_QS}, {r('max(value)')} AS maximum, " + ", ".join(f"{r(f'avg(CASE WHEN value >= {t}::DOUBLE THEN 1::DOUBLE ELSE 0 END)')} AS prop_{int(t * 100)}" for t in (0.90, 0.95, 0.99)) + " FROM n GROUP BY ALL")
def nearest_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, A28."""
    return rounded(_nearest(spark, sf_dir).groupBy("strategy", "fold").agg(*(c.alias(n) for n, c in geometry.similarity_summary(F.col("value")).items())))


@query(f"WITH {_F}, g AS (SELECT strategy, fold, count(*) AS n, avg(value) AS s, avg(1 - value) AS d, max(value) AS sm, max(1 - value) AS dm FROM n GROUP BY ALL) SELECT strategy, count(DISTINCT fold)::BIGINT AS n_seeds, count(*)::BIGINT AS n_folds, sum(n)::BIGINT AS n_test, {r('avg(d)')} AS distance_mean, {r('stddev_samp(d)')} AS distance_std, {r('max(dm)')} AS distance_maximum, {r('avg(s)')} AS similarity_mean, {r('stddev_samp(s)')} AS similarity_std, {r('max(sm)')} AS similarity_maximum FROM g GROUP BY strategy")
def geometry_over_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of folds' means, the greatest of their greatest."""
    folds = geometry.fold_geometry(_nearest(spark, sf_dir), ["strategy", "fold"])
    return rounded(geometry.geometry_of_folds(folds, ["strategy"], "fold"))


@query(f"WITH {_F}, s AS (SELECT strategy, fold, avg(1 - value) AS d FROM n GROUP BY ALL), p AS (SELECT a.d AS base, b.d AS other, b.d - a.d AS delta FROM s a JOIN s b USING (fold) WHERE a.strategy = 'random' AND b.strategy = 'distance') SELECT 'embedding' AS space, count(*)::BIGINT AS n_seeds, {r('avg(base)')} AS base_mean, {r('avg(other)')} AS other_mean, {r('avg(delta)')} AS delta_mean, {r('stddev_samp(delta)')} AS delta_sd, {r('2.776445::DOUBLE * stddev_samp(delta) / sqrt(count(*))')} AS delta_ci95, true AS complete FROM p")
def geometry_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of both strategies paired by fold."""
    each = _nearest(spark, sf_dir).groupBy("strategy", "fold").agg(F.avg(1 - F.col("value")).alias("d")).withColumn("space", F.lit("embedding"))
    return rounded(results.paired_geometry(each, ["space"], "strategy", "fold", "d", 5))


def _vote(spark: SparkSession, sf_dir: str, fold: int = 0) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    votes = geometry.knn_vote(rows.where(f"vec_id % 5 = {fold}"), rows.where(f"vec_id % 5 <> {fold}"), "vec_id", "embedding", "y")
    return votes.join(rows.select(F.col("vec_id").alias("key"), "y"), "key")


def _by_fold(one) -> DataFrame:
    """The rows that one(fold) gives, of each of the five folds."""
    out = [one(f).withColumn("fold", F.lit(f)) for f in range(5)]
    return reduce_left(DataFrame.unionByName, out)


_V = f"{_E}, c AS (SELECT a.vec_id, (b.label < 5)::INT AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS n FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), k AS (SELECT vec_id, avg(y) AS score FROM c WHERE n <= 5 GROUP BY ALL), t AS (SELECT vec_id, score, (score > 0.5::DOUBLE)::INTEGER AS predicted, (label < 5)::INTEGER AS y FROM k JOIN e USING (vec_id))"


@query(f"WITH {_V} SELECT vec_id, {r('score')} AS score, predicted, y FROM t")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours' votes on fold 0; knn_vote_by_fold is of all folds."""
    return rounded(_vote(spark, sf_dir).withColumnRenamed("key", "vec_id"))


@query(f"WITH {_V}, m AS (SELECT sum((y = 1 AND predicted = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND predicted = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND predicted = 0)::INT)::DOUBLE AS fn, sum((y = 0 AND predicted = 0)::INT)::DOUBLE AS tn FROM t) SELECT {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc FROM m")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17, on fold 0; confusion_by_fold is of all folds."""
    return rounded(training.metrics(_vote(spark, sf_dir), "y", "predicted"))


_VF = _V.replace("a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0", "a.vec_id % 5 <> b.vec_id % 5")


@query(f"WITH {_VF} SELECT (vec_id % 5)::INTEGER AS fold, vec_id, {r('score')} AS score, predicted, y FROM t")
def knn_vote_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes on every row, by neighbours of the other folds."""
    return rounded(_by_fold(lambda f: _vote(spark, sf_dir, f)).withColumnRenamed("key", "vec_id"))


@query(f"WITH {_VF}, m AS (SELECT (vec_id % 5)::INTEGER AS fold, sum((y = 1 AND predicted = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND predicted = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND predicted = 0)::INT)::DOUBLE AS fn, sum((y = 0 AND predicted = 0)::INT)::DOUBLE AS tn FROM t GROUP BY ALL) SELECT fold, {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc FROM m")
def confusion_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a fold."""
    return rounded(training.metrics(_by_fold(lambda f: _vote(spark, sf_dir, f)), "y", "predicted", ["fold"]))


@query()
def logistic_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaled logistic regression on each fold, trained on the other folds."""
    rows = read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 1).cast("int"))
    out = _by_fold(lambda f: training.fitted(rows.where(f"vec_id % 5 <> {f}"), rows.where(f"vec_id % 5 = {f}"), "embedding", "label", "LogisticRegression", "standard", maxIter=20))
    return rounded(training.metrics(out, "y", "prediction", ["fold"]))


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folds of the embeddings by id, a label that the vectors can tell, and for each fold its parts."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.get(F.col("embedding"), F.lit(0)) + F.get(F.col("embedding"), F.lit(1)) > 0).cast("int").alias("y"), (F.col("vec_id") % 3).cast("int").alias("own"))
    part = F.when(F.col("own") == F.col("fold"), "test").when(F.col("vec_id") % 10 == 0, "val").otherwise("train")
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("part", part).drop("own")


GRID = {"param_grids": {"LogisticRegression": [{"C": 1.0, "max_iter": 20}, {"C": 0.01, "max_iter": 20, "n_jobs": 8}], "GaussianNB": [{}], "LinearDiscriminantAnalysis": [{"shrinkage": None}], "QuadraticDiscriminantAnalysis": [{"reg_param": 0.1}], "DecisionTreeClassifier": [{"max_depth": 4}], "KNeighborsClassifier": {"n_neighbors": [3, 7], "metric": ["cosine"]}, "SVC": [{"C": 1.0, "max_iter": 20}]}}


@query()
def training_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration of a grid, with two scalers, trained and judged on each fold; tests hold its parts against numpy."""
    found, _ = training.trained_by_fold(_training_rows(spark, sf_dir), "vec_id", "embedding", "y", training.grids(GRID), checkpointed, ["none", "standard"], partition_strategy="random")
    return rounded(found)


_KF = "p AS (SELECT vec_id, embedding::DOUBLE[] AS v, (embedding[1] + embedding[2] > 0)::INTEGER AS y, (vec_id % 3)::INTEGER AS own FROM embeddings), f AS (SELECT *, fold::INTEGER AS fold, CASE WHEN own = fold THEN 'test' WHEN vec_id % 10 = 0 THEN 'val' ELSE 'train' END AS part FROM p CROSS JOIN range(3) r(fold))"


@query(f"WITH {_KF.replace('SELECT *, fold::INTEGER AS fold', 'SELECT vec_id, v, y, fold::INTEGER AS fold')}, c AS (SELECT a.fold, a.part, a.vec_id, a.y AS t, b.y, row_number() OVER (PARTITION BY a.fold, a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS n FROM f a JOIN f b ON a.fold = b.fold AND a.part <> 'train' AND b.part = 'train'), k AS (SELECT fold, part, vec_id, max(t) AS t, (avg(y) > 0.5::DOUBLE)::INTEGER AS p FROM c WHERE n <= 3 GROUP BY ALL) SELECT fold, part, count(*)::BIGINT AS n, {r('avg((t = p)::INT)')} AS accuracy, sum(t)::BIGINT AS positives FROM k GROUP BY ALL")
def neighbours_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy on val and test of each fold of one configuration of the grid's."""
    found, _ = training.trained_by_fold(_training_rows(spark, sf_dir), "vec_id", "embedding", "y", [{"algorithm": "KNeighborsClassifier", "params": {"n_neighbors": 3, "metric": "cosine"}}], checkpointed)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"n_{p}").alias("n"), F.col(f"accuracy_{p}").alias("accuracy"), F.col(f"{p}_pos").alias("positives")) for p in ("val", "test"))))
    return rounded(found.select("fold", each.alias("e")).select("fold", "e.*"))


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10."""
    out, variance = training.principal_components(read(spark, sf_dir, "embeddings"), "embedding")
    return rounded(out.select("vec_id", F.abs(F.get("pca", F.lit(0))).alias("first"), F.lit(variance[0]).alias("variance_first"), F.lit(variance[1]).alias("variance_second")), 4)


def _one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.one_pass_of(*_vectors(spark, sf_dir), 0.3)


_C = f"{_P}, c AS (SELECT key_a, key_b, value FROM p WHERE value >= 0.3::DOUBLE)"


@query(f"WITH {_C} SELECT removed_id, representative_id, representative_id AS cluster_id FROM (SELECT key_b AS removed_id, key_a AS representative_id, row_number() OVER (PARTITION BY key_b ORDER BY round(value, 9) DESC, key_a) AS n FROM c) WHERE n = 1")
def reduction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, one pass: a row goes if any earlier row is close; its representative is the closest."""
    return _one_pass(spark, sf_dir)


@query(f"WITH {_C}, g AS (SELECT DISTINCT key_b AS id FROM c), a AS (SELECT count(*)::BIGINT AS n_original, count(*) FILTER (id IS NULL)::BIGINT AS n_reduced, count(*) FILTER (id IS NULL AND label = 0)::BIGINT AS n_0, count(*) FILTER (id IS NULL AND label = 1)::BIGINT AS n_1 FROM e LEFT JOIN g ON vec_id = id) SELECT *, n_original - n_reduced AS removed, {r('n_reduced / n_original')} AS kept_fraction FROM a")
def reduction_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return rounded(reduce.retention(read(spark, sf_dir, "embeddings"), _one_pass(spark, sf_dir), "vec_id", "label"))


@query(f"WITH {_P}, m AS (SELECT vec_id, max(round(value, 9)) AS near FROM e LEFT JOIN (SELECT * FROM p WHERE value >= 0.2::DOUBLE) ON key_b = vec_id GROUP BY ALL), t AS (SELECT unnest({_DOUBLES([0.2, 0.3, 0.4])}) AS threshold) SELECT threshold, count(*)::BIGINT AS n_original, count(*) FILTER (near IS NULL OR near < threshold)::BIGINT AS n_reduced, count(*) FILTER (near >= threshold)::BIGINT AS removed, {r('count(*) FILTER (near IS NULL OR near < threshold) / count(*)')} AS kept_fraction FROM m CROSS JOIN t GROUP BY ALL")
def retention_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-pass retention at several thresholds from one table of the closest earlier rows."""
    return rounded(reduce.ladder_of(geometry.closest_earlier(*_vectors(spark, sf_dir), 0.2), read(spark, sf_dir, "embeddings"), "vec_id", [0.2, 0.3, 0.4]))


def _greedy_sql(pairs: str, limits: list[tuple[float, float]], at_least: bool = True) -> str:
    """Row by row: a row stays if none of those that stay is close; c (percentile, key_a, key_b, value), kept (percentile, id) and best, the closest one that stays."""
    values, sign, order = ", ".join(f"({p}::DOUBLE, {t}::DOUBLE)" for p, t in limits), ">=" if at_least else "<=", "DESC" if at_least else "ASC"
    return f"""WITH RECURSIVE {pairs}, t(percentile, threshold) AS (VALUES {values}), c AS (SELECT percentile, threshold, key_a, key_b, value FROM p JOIN t ON p.value {sign} t.threshold),
near AS (SELECT percentile, key_b, list(key_a) AS near FROM c GROUP BY ALL), o AS (SELECT percentile, vec_id, row_number() OVER (PARTITION BY percentile ORDER BY vec_id) AS i FROM e CROSS JOIN t),
n AS (SELECT o.percentile, o.vec_id, o.i, coalesce(near, []) AS near FROM o LEFT JOIN near ON near.percentile = o.percentile AND near.key_b = o.vec_id),
g AS (SELECT percentile, 0::BIGINT AS i, []::BIGINT[] AS kept FROM t UNION ALL SELECT g.percentile, n.i, CASE WHEN list_has_any(g.kept, n.near) THEN g.kept ELSE list_append(g.kept, n.vec_id::BIGINT) END FROM g JOIN n ON n.percentile = g.percentile AND n.i = g.i + 1),
kept AS (SELECT percentile, unnest(kept) AS id FROM g WHERE i = (SELECT max(i) FROM n)),
best AS (SELECT c.* FROM c SEMI JOIN kept ON kept.percentile = c.percentile AND kept.id = c.key_a ANTI JOIN kept AS k2 ON k2.percentile = c.percentile AND k2.id = c.key_b QUALIFY row_number() OVER (PARTITION BY c.percentile, key_b ORDER BY round(value, 9) {order}, key_a) = 1)"""


@query(f"WITH {_P}, m AS (SELECT vec_id, label, max(round(value, 9)) AS near FROM e LEFT JOIN (SELECT * FROM p WHERE value >= 0.2::DOUBLE) ON key_b = vec_id GROUP BY ALL), t AS (SELECT unnest({_DOUBLES([0.2, 0.3, 0.4])}) AS min_seq_id), s AS (SELECT min_seq_id, count(*)::BIGINT AS n_original, count(*) FILTER (near >= min_seq_id)::BIGINT AS removed, count(*) FILTER (label = 0 AND (near IS NULL OR near < min_seq_id))::BIGINT AS n_0, count(*) FILTER (label = 1 AND (near IS NULL OR near < min_seq_id))::BIGINT AS n_1 FROM m CROSS JOIN t GROUP BY ALL) SELECT min_seq_id, n_original, n_original - removed AS n_reduced, removed, {r('(n_original - removed) / n_original')} AS kept_fraction, n_0, n_1 FROM s WHERE removed > 0")
def identity_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row of each threshold of a table of maps."""
    rows = read(spark, sf_dir, "embeddings")
    close, limits = geometry.closest_earlier(*_vectors(spark, sf_dir), 0.2), F.array(*(F.lit(t) for t in (0.2, 0.3, 0.4)))
    maps = close.withColumn("min_seq_id", F.explode(F.filter(limits, lambda t: F.round("value", 9) >= t)))  # the closest is the same for each
    return rounded(reduce.homology_rows(maps, rows, "vec_id", "label"))


@query(f"{_greedy_sql(_P, [(0, 0.3)])} SELECT key_b AS removed_id, key_a AS representative_id, key_a AS cluster_id FROM best")
def greedy_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R5, greedy: tests hold it against the sequential rule."""
    return reduce.greedy_of(*_vectors(spark, sf_dir), 0.3, checkpointed)


_LADDER = [(30.0, 0.25), (60.0, 0.35), (90.0, 0.45)]


@query(f"{_greedy_sql(_P, _LADDER)}, s AS (SELECT percentile, threshold, count(*)::BIGINT AS n_original, count(k.id)::BIGINT AS n_reduced, count(k.id) FILTER (label = 0)::BIGINT AS n_0, count(k.id) FILTER (label = 1)::BIGINT AS n_1 FROM e CROSS JOIN t LEFT JOIN kept k ON k.percentile = t.percentile AND k.id = e.vec_id GROUP BY ALL) SELECT *, n_original - n_reduced AS removed, {r('n_reduced / n_original')} AS kept_fraction FROM s".replace("SELECT percentile, threshold, count(*)::BIGINT AS n_original", "SELECT t.percentile, t.threshold, count(*)::BIGINT AS n_original"))
def reduction_by_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy reductions at each threshold of a ladder, over ids that are text; tests hold it against the sequential rule."""
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("seq_"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), "embedding", "label")
    return rounded(reduce.reduction_ladder(rows, "id", "embedding", "label", _LADDER, checkpointed)[1])


_DISTANCES = [(30.0, 1.2), (60.0, 1.1), (90.0, 1.0)]


@query(f"{_greedy_sql(_D, _DISTANCES, False)} SELECT percentile, 'seq_' || lpad(key_b::VARCHAR, 9, '0') AS removed_id, 'seq_' || lpad(key_a::VARCHAR, 9, '0') AS representative_id, 'seq_' || lpad(key_a::VARCHAR, 9, '0') AS cluster_id FROM best")
def euclidean_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the same for distances, whose thresholds fall as percentiles grow, and the closest representative of each removed row."""
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("seq_"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), "embedding", "label")
    return reduce.reduction_ladder(rows, "id", "embedding", "label", _DISTANCES, checkpointed, "euclidean")[0]


@query(f"WITH {_D}, c AS (SELECT key_a, key_b, value FROM p WHERE value <= 1.15::DOUBLE) SELECT 'seq_' || key_b::VARCHAR AS removed_id, 'seq_' || key_a::VARCHAR AS representative_id FROM (SELECT *, row_number() OVER (PARTITION BY key_b ORDER BY round(value, 9), key_a::VARCHAR) AS n FROM (SELECT CASE WHEN a < b THEN a ELSE b END AS key_a, CASE WHEN a < b THEN b ELSE a END AS key_b, value FROM (SELECT key_a::VARCHAR AS a, key_b::VARCHAR AS b, value FROM c))) WHERE n = 1")
def euclidean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, one pass, over text ids: a removed row's representative is the nearest earlier one."""
    rows = read(spark, sf_dir, "embeddings").withColumn("id", F.concat(F.lit("seq_"), F.col("vec_id").cast("string")))
    return reduce.one_pass_of(rows, "id", "embedding", 1.15, "euclidean").drop("cluster_id")


@query()
def matched_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold whose greedy reduction leaves nearest to three fifths of all rows, by bisection, and its tries."""
    rows = read(spark, sf_dir, "embeddings")
    return rounded(reduce.matched_reduction(rows, "vec_id", "embedding", rows.count() * 3 // 5, 0.2, 0.6, checkpointed, within=2, steps=8)[2], 9)


_A = f"{_C}, m AS (SELECT key_b AS removed_id, key_a AS representative_id, row_number() OVER (PARTITION BY key_b ORDER BY round(value, 9) DESC, key_a) AS n FROM c), d AS (SELECT removed_id, representative_id FROM m WHERE n = 1), s AS (SELECT vec_id, 'one_pass' AS method, coalesce(d.representative_id, vec_id) AS cluster_id, d.removed_id IS NULL AS is_representative, label FROM e LEFT JOIN d ON vec_id = d.removed_id)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assignments(read(spark, sf_dir, "embeddings").select("vec_id"), _one_pass(spark, sf_dir), "one_pass", "vec_id")


@query(f"WITH {_A} SELECT vec_id, method, cluster_id, is_representative FROM s")
def cluster_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    return _assigned(spark, sf_dir)


@query(f"WITH {_A}, z AS (SELECT cluster_id, count(*) AS k FROM s GROUP BY ALL) SELECT count(*)::BIGINT AS n_clusters, count(*) FILTER (k = 1)::BIGINT AS n_singletons, {r('count(*) FILTER (k = 1) / count(*)')} AS singleton_fraction, {r('avg(k)')} AS mean_size, {r('median(k)')} AS median_size, {r('quantile_cont(k::DOUBLE, 0.95::DOUBLE)')} AS p95_size, max(k)::BIGINT AS max_size FROM z")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A40."""
    return rounded(cluster.cluster_stats(_assigned(spark, sf_dir)))


def _agreement_sql(table: str, a: str, b: str) -> str:
    return f"""{table}, t AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS c FROM src GROUP BY ALL), x AS (SELECT sum(c) AS c FROM t GROUP BY a), y AS (SELECT sum(c) AS c FROM t GROUP BY b),
sums AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM t) AS shared, (SELECT sum(c * (c - 1) / 2) FROM x) AS ref, (SELECT sum(c * (c - 1) / 2) FROM y) AS cand, (SELECT sum(c) FROM t) AS n, (SELECT sum(c * ln(c)) FROM t) AS lb, (SELECT sum(c * ln(c)) FROM x) AS lr, (SELECT sum(c * ln(c)) FROM y) AS lc)
SELECT ref::BIGINT AS reference_pairs, cand::BIGINT AS candidate_pairs, shared::BIGINT AS shared_pairs, {r('shared / nullif(cand, 0)')} AS precision, {r('shared / nullif(ref, 0)')} AS recall, {r('2 * shared / nullif(ref + cand, 0)')} AS f1, {r('shared / nullif(ref + cand - shared, 0)')} AS jaccard,
{r('(shared - ref * cand / (n * (n - 1) / 2)) / ((ref + cand) / 2 - ref * cand / (n * (n - 1) / 2))')} AS adjusted_rand, {r('((ln(n) - lr / n) + (ln(n) - lc / n) - (ln(n) - lb / n)) / (((ln(n) - lr / n) + (ln(n) - lc / n)) / 2)')} AS normalized_mutual_info FROM sums"""


@query(_agreement_sql("WITH src AS (SELECT * FROM customer)", "c_nationkey", "c_mktsegment"))
def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and by market segment."""
    return rounded(cluster.agreement(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment"))


@query(_agreement_sql(f"WITH {_A}, src AS (SELECT * FROM s)", "label", "cluster_id"))
def cluster_agreement_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against clusters of the reduction."""
    rows = _assigned(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return rounded(cluster.agreement(rows, "label", "cluster_id"))


@query(f"WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH') SELECT (SELECT count(*) FROM u JOIN h USING (o_custkey))::BIGINT AS n_shared, (SELECT count(*) FROM (FROM u UNION FROM h))::BIGINT AS n_union, {r('(SELECT count(*) FROM u JOIN h USING (o_custkey)) / (SELECT count(*) FROM (FROM u UNION FROM h))')} AS jaccard")
def representative_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A43, U3."""
    rows = read(spark, sf_dir, "orders")
    one, two = (rows.where(F.col("o_orderpriority") == p).select("o_custkey").distinct() for p in ("1-URGENT", "2-HIGH"))
    return rounded(cluster.set_jaccard(one, two, "o_custkey"))


@query(f"WITH {_E} SELECT count(*)::BIGINT AS n, count(*) FILTER (len(v) = 64)::BIGINT AS n_full, {r('avg(sqrt(list_dot_product(v, v)))')} AS mean_norm FROM e")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors validated (finite, one length, unique ids, none zero), then summarised."""
    rows = geometry.checked(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    v = vectors.doubles(F.col("embedding"))
    return rounded(rows.agg(F.count("*").alias("n"), F.count_if(F.size(v) == 64).alias("n_full"), F.avg(vectors.norm(v)).alias("mean_norm")))
