"""Cross-validation folds that a seed reproduces, checks before and after, and their status.

Folds come from the rank of a hash of id and seed.  Ranks over all rows would put all rows in one task, so rows are ranked in ranges of
the hash and counted once: a row's rank is its place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import naming, stats, vectors
from corvane.operators.curate import numbered

#: Hexadecimal digits of a hash that ranges of rows are told by, at least, and rows of a range.
RANGES, ROWS = 2, 100_000


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def ranked(df: DataFrame, order: Column, by: list[str] = ()) -> DataFrame:
    """df with _rank (from 0) and _n: the place by a hexadecimal order inside each group of by, and the group's size."""
    by = list(by)
    digits = max(RANGES, math.ceil(math.log(max(df.count(), 1) / ROWS, 16)))
    df = df.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, digits))
    sizes = df.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    along = Window.partitionBy(*by).orderBy("_range")
    sizes = sizes.select(*by, "_range", (F.sum("_size").over(along) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_range") == F.col("_by__range")]
    out = df.join(sizes.withColumnsRenamed({c: f"_by_{c}" for c in [*by, "_range"]}), reduce(lambda a, b: a & b, on)).drop(*(f"_by_{c}" for c in [*by, "_range"]))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_order"))
    return out.withColumn("_rank", F.col("_before") + place - 1).drop("_order", "_range", "_before")


def kfold(df: DataFrame, key: str, seed: int, n_splits: int = 5, label: str | None = None) -> DataFrame:
    """key (and label) with fold 0 .. n_splits - 1; with a label each class is dealt out evenly."""
    columns = [key, *([label] if label else [])]
    out = ranked(df.select(*columns), order_hash(key, seed), [label] if label else [])
    return out.select(*columns, F.floor(F.col("_rank") * n_splits / F.col("_n")).cast("int").alias("fold"))


def distance_folds(df: DataFrame, key: str, vector: str, seed: int, n_splits: int = 5, metric: str = "euclidean", standardize: bool = False) -> DataFrame:
    """Folds of equal size by distance to the centroid, so that test rows lie apart from train rows; ties by hash of key and seed.

    metric: euclidean, or cosine (1 - similarity); standardize: after each place's mean and deviation are taken out.  The centroid is one
    vector of sums.  Rows are numbered in ranges of their own making, so a distance that many rows have costs no single task.
    """
    if standardize:
        from corvane.operators.training import scaled

        df = scaled(df.select(key, vector), vector, "standard")
    v = vectors.doubles(F.col(vector))
    center = df.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_center"))
    apart = vectors.euclidean(F.col("v"), F.col("_center")) if metric == "euclidean" else 1 - F.coalesce(vectors.cosine(F.col("v"), F.col("_center")), F.lit(0.0))
    far = df.select(key, v.alias("v")).crossJoin(F.broadcast(center)).select(key, F.round(apart, 6).alias("_far"), order_hash(key, seed).alias("_order"))  # one row
    out = numbered(far, ["_far", "_order", key], "_number")
    n = out.agg(F.count("*").alias("_n"))
    return out.crossJoin(F.broadcast(n)).select(key, F.floor((F.col("_number") - 1) * n_splits / F.col("_n")).cast("int").alias("fold"))  # one row


def assignments(folds: DataFrame, key: str, n_splits: int, seed: int, val_share: float = 0.1, **tags: str) -> DataFrame:
    """One row a fold, part and key: test is the fold itself; of the rest a share by hash is val, the others train."""
    each = folds.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)), F.col("fold").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    part = F.when(F.col("_own") == F.col("fold"), "test").when(draw < val_share, "val").otherwise("train")
    return each.withColumns({"part": part, "seed": F.lit(seed), **{k: F.lit(v) for k, v in tags.items()}}).drop("_own")


def precheck(df: DataFrame, label: str, n_splits: int, by: list[str] = (), stratified: bool = False) -> DataFrame:
    """status and reason of a table (or each group of by) before it is split."""
    by = list(by)
    classes = df.groupBy(*by, label).agg(F.count("*").alias("_c")).groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.count(label).alias("n_classes"), F.min("_c").alias("least_class"))
    reason = F.when(F.col("n_rows") == 0, "empty_input").when(F.col("n_classes") < 2, "single_class").when(F.col("n_rows") < n_splits, "fewer_rows_than_folds")
    if stratified:
        reason = reason.when(F.col("least_class") < n_splits, "class_too_small")
    return classes.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("status", F.when(F.col("reason") == "ok", "kept").otherwise("invalid_split"))


def validate(assigned: DataFrame, label: str, n_splits: int, by: list[str] = ()) -> DataFrame:
    """Each fold and part that should be there: its rows and classes, and whether it may be used."""
    by = list(by)
    there = assigned.groupBy(*by, "fold", "part").agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_classes"))
    parts = F.explode(F.array(*(F.lit(p) for p in ("train", "val", "test")))).alias("part")
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    expected = (assigned.select(*by).distinct() if by else assigned.sparkSession.range(1).select()).withColumn("fold", F.explode(folds)).select(*by, "fold", parts)
    out = expected.join(there, [*by, "fold", "part"], "left").fillna(0, ["n_rows", "n_classes"])
    return out.withColumn("status", F.when((F.col("n_rows") > 0) & (F.col("n_classes") >= 2), "kept").otherwise("invalid_split"))


def status_summary(status: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """n_total, n_kept, n_invalid, the seeds as text, and rates, of each group."""
    kept, invalid = F.col("status") == "kept", F.col("status") == "invalid_split"
    seeds = F.array_join(F.transform(F.array_sort(F.collect_set(F.col(seed).cast("int"))), lambda s: s.cast("string")), ";")
    out = status.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(kept).alias("n_kept"), F.count_if(invalid).alias("n_invalid"), seeds.alias("seeds"))
    return out.withColumns({"kept_rate": stats.ratio(F.col("n_kept"), F.col("n_total")), "invalid_rate": stats.ratio(F.col("n_invalid"), F.col("n_total"))})


def strategy_summary(status: DataFrame, by: list[str], scenario: str = "scenario", seed: str = "seed") -> DataFrame:
    kept, invalid = F.col("status") == "kept", F.col("status") == "invalid_split"
    out = status.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(kept).alias("n_kept"), F.count_if(invalid).alias("n_invalid"), F.count_distinct(scenario).alias("n_scenarios"), F.count_distinct(seed).alias("n_seeds"))
    return out.withColumns({"kept_rate": stats.ratio(F.col("n_kept"), F.col("n_total")), "invalid_rate": stats.ratio(F.col("n_invalid"), F.col("n_total"))})


def scenarios(spark, **dimensions: list) -> DataFrame:
    """Every combination of configured values; as many rows as the configuration says, never data."""
    out = spark.range(1).select()
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out


def fingerprint(assigned: DataFrame, key: str, by: list[str]) -> DataFrame:
    """A digest of each group's train and test ids."""
    ids = lambda part: F.collect_list(F.when(F.col("part") == part, F.col(key).cast("string")))
    return assigned.groupBy(*by).agg(vectors.assignment_hash(ids("train"), ids("test")).alias("assignment_hash"))


def ordered_levels(df: DataFrame, level: str) -> DataFrame:
    """df with the kind of each level (none, percentile, identity, threshold), its value, and level_order: kinds in that order, each by value."""
    text = F.coalesce(F.col(level).cast("string"), F.lit(""))
    kind = F.when(text.rlike("^p[0-9]"), "percentile").when(text.startswith("minseqid_"), "identity").when(text.startswith("threshold_"), "threshold").otherwise("none")
    out = df.withColumns({"level_kind": kind, "level_value": naming.parameter_value(text)})
    place = F.array_position(F.array(*(F.lit(k) for k in ("none", "percentile", "identity", "threshold"))), F.col("level_kind"))
    order = Window.orderBy(place, F.col("level_value").asc_nulls_first(), level)
    ranks = out.select(level, "level_kind", "level_value").distinct().withColumn("level_order", F.row_number().over(order)).select(F.col(level).alias("_level"), "level_order")  # levels, not data
    return out.join(ranks, F.col(level).eqNullSafe(F.col("_level"))).drop("_level")


def feasibility(status: DataFrame, scenario: str, level: str, levels: list[str]) -> DataFrame:
    """The share of kept splits by scenario and level, one column a level."""
    return status.groupBy(scenario).pivot(level, levels).agg(F.avg((F.col("status") == "kept").cast("double")))
