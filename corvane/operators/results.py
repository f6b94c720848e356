"""From fold results to configurations: aggregates, best by validation, summaries over seeds, completeness, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import keys, stats


def fold_aggregates(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of each metric; a metric that df lacks is null with a count of 0."""
    aggs = []
    for m in metrics:
        x = stats.clean(F.col(m)) if m in df.columns else F.lit(None).cast("double")
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"{m}_std"), F.count(x).alias(f"{m}_n")]
    return df.groupBy(*keys.existing(df, by)).agg(*aggs)


def best_per_fold(df: DataFrame, unit: list[str], config: str, validation: str, test: str) -> DataFrame:
    """Each unit's configuration of the highest validation metric; ties by number, then text, of the configuration.  Test never decides."""
    number = F.coalesce(F.col(config).cast("string").try_cast("double"), F.lit(float("inf")))
    order = Window.partitionBy(*unit).orderBy(F.col(validation).desc(), number, F.col(config).cast("string"))
    return df.where(F.col(validation).isNotNull() & F.col(test).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def seed_summary(df: DataFrame, by: list[str], seed: str, metric: str, rule: str = "t") -> DataFrame:
    """Seed means first, then their mean, deviation, standard error and 95 % half width in each group; rule: t or normal."""
    each = df.groupBy(*by, seed).agg(F.avg(metric).alias("_m"), F.count(metric).alias("_n"))
    x = F.col("_m")
    half = stats.half_width_t(x) if rule == "t" else stats.half_width_normal(x)
    return each.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), half.alias("ci95"), F.sum("_n").alias("n_evaluations"), F.count(x).alias("n_seeds"))


def selected_by_validation(df: DataFrame, panel: list[str], identity: list[str], seed: str, validation: str, test: str, top: int, one_each: list[str] | None = None) -> DataFrame:
    """The top configurations of each panel by their mean over seeds of the validation metric, with the test summary attached afterwards.

    one_each: columns of which each combination stays once, by its best rank, before ranks are given anew.
    """
    by = [*panel, *identity]
    ranked = seed_summary(df, by, seed, validation).select(*by, F.col("mean").alias("validation_mean"), F.col("ci95").alias("validation_ci95"), "n_seeds")
    order = lambda: Window.partitionBy(*panel).orderBy(F.round("validation_mean", 12).desc_nulls_last(), *identity)
    if one_each:
        first = Window.partitionBy(*panel, *one_each).orderBy(F.round("validation_mean", 12).desc_nulls_last(), *identity)
        ranked = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    chosen = ranked.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    told = seed_summary(df, by, seed, test).select(*by, F.col("mean").alias("test_mean"), F.col("ci95").alias("test_ci95"))
    return chosen.join(told, by, "left")


def complete_units(df: DataFrame, unit: list[str], cell: list[str], cells: int) -> DataFrame:
    """Rows of the units that have all cells."""
    whole = df.groupBy(*unit).agg(F.count_distinct(F.struct(*cell)).alias("_n")).where(F.col("_n") == cells).drop("_n")
    return df.join(whole, unit, "left_semi")


def completeness(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Each expected combination with how often it was found: missing, found or ambiguous."""
    counts = found.groupBy(*by).agg(F.count("*").alias("n_found"))
    out = expected.join(counts, by, "left").fillna(0, ["n_found"])
    return out.withColumn("status", F.when(F.col("n_found") == 0, "missing").when(F.col("n_found") == 1, "found").otherwise("ambiguous"))


def corrected_master(base: DataFrame, replacement: DataFrame, by: list[str]) -> DataFrame:
    """base without the keys that replacement brings, and replacement; origin says which; columns that one side lacks are null.

    A key that one of the tables has twice is an error: which of its rows counts can't be told.
    """
    base, replacement = keys.assert_unique(base, by), keys.assert_unique(replacement, by)
    gone = replacement.select(*by)
    on = reduce(lambda a, b: a & b, (F.col(f"base.{c}").eqNullSafe(F.col(f"gone.{c}")) for c in by))
    kept = base.alias("base").join(gone.alias("gone"), on, "left_anti")
    return kept.withColumn("origin", F.lit("original")).unionByName(replacement.withColumn("origin", F.lit("replacement")), allowMissingColumns=True)


def identity_repeats(df: DataFrame, by: list[str]) -> DataFrame:
    """Result identities that several rows claim."""
    return keys.repeated(df, keys.existing(df, by))


def weighted_seed_mean(df: DataFrame, by: list[str], weight: str, values: list[str]) -> DataFrame:
    """Means weighted by rows of each fold."""
    w = F.col(weight).cast("double")
    return df.groupBy(*by).agg(*(stats.ratio(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values))


def paired_geometry(df: DataFrame, by: list[str], strategy: str, seed: str, value: str, least_seeds: int, base: str = "random", other: str = "distance") -> DataFrame:
    """Means of both strategies, and the mean, deviation and 95 % half width of their paired differences over seeds."""
    one = df.where(F.col(strategy) == base).select(*by, seed, F.col(value).alias("base"))
    two = df.where(F.col(strategy) == other).select(*by, seed, F.col(value).alias("other"))
    both = two.join(one, [*by, seed]).withColumn("delta", F.col("other") - F.col("base"))
    out = both.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), F.avg("base").alias("base_mean"), F.avg("other").alias("other_mean"), F.avg("delta").alias("delta_mean"), F.stddev_samp("delta").alias("delta_sd"), stats.half_width_t(F.col("delta")).alias("delta_ci95"))
    return out.withColumn("complete", F.col("n_seeds") >= least_seeds)


def five_number_summary(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in stats.five_numbers(F.col(metric)).items()))


def heatmap(df: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Means by row and a fixed list of columns."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def threshold_panel(df: DataFrame, by: list[str], level: str, metric: str, anchor: str = "p100") -> DataFrame:
    """Mean, standard error and count by level, and a zero anchor row of each group."""
    x = F.col(metric)
    out = df.groupBy(*by, level).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0)).alias("sem"), F.count(x).alias("n"))
    zero = df.select(*by).distinct().select(*by, F.lit(anchor).alias(level), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sem"), F.lit(0).cast("long").alias("n"))
    return out.where(F.col(level) != anchor).unionByName(zero)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 90, width: int = 5, by: list[str] = ()) -> DataFrame:
    """bin (from 0), n, smooth (a centred moving average with zeros beyond the edges) and density (its share of the highest)."""
    by = list(by)
    place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(value.between(low, high)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return smoothed(every.join(counts, [*by, "bin"], "left").fillna(0, ["n"]), width, by)


def smoothed(full: DataFrame, width: int = 5, by: list[str] = ()) -> DataFrame:
    """histogram() of counts (bin, n) of every bin."""
    near = Window.partitionBy(*(by or [F.lit(1)])).orderBy("bin").rowsBetween(-(width // 2), width // 2)  # bins, not data
    out = full.withColumn("smooth", F.sum("n").over(near) / float(width))
    return out.withColumn("density", F.coalesce(stats.ratio(F.col("smooth"), F.max("smooth").over(Window.partitionBy(*(by or [F.lit(1)])))), F.lit(0.0)))
