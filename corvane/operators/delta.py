"""Paired deltas of metrics against a baseline, and rankings of what loses least."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import keys, stats


def _mean(df: DataFrame, by: list[str], metrics: list[str], ending: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(stats.clean(F.col(m))).alias(f"{m}__{ending}") for m in metrics))


def _with_deltas(df: DataFrame, metrics: list[str]) -> DataFrame:
    made: dict[str, Column] = {}
    for m in metrics:
        new, old = F.col(f"{m}__candidate"), F.col(f"{m}__baseline")
        made |= {f"delta__{m}": new - old, f"loss__{m}": old - new, f"retention__{m}": F.when(F.abs(old) > 1e-12, new / old)}
    return df.withColumns(made)


def paired_delta(df: DataFrame, baseline: Column, candidate: Column, match: list[str], context: list[str], metrics: list[str], name: str) -> DataFrame:
    """Candidates beside the baseline of the same match columns: both sides' means, delta, loss and retention of each metric.

    Both sides are averaged before they meet, so the join has one row a key and its smaller side may be broadcast.
    """
    match, metrics = keys.existing(df, match), keys.existing(df, metrics)
    by = list(dict.fromkeys([*match, *keys.existing(df, context)]))
    tagged = df.select("*", baseline.alias("_baseline"), candidate.alias("_candidate"))
    tagged = keys.filled_keys(tagged, by)
    old = _mean(tagged.where("_baseline"), match, metrics, "baseline")
    new = _mean(tagged.where("_candidate"), by, metrics, "candidate")
    return _with_deltas(new.join(old, match), metrics).withColumn("comparison_name", F.lit(name))


def reference_delta(df: DataFrame, reference: Column, match: list[str], metric: str, comparison: Column | None = None) -> DataFrame:
    """Each row of comparison (all rows, the reference's own too, if None) with each reference row of the same match columns.

    Missing keys match missing ones.  The reference isn't averaged: several rows of a key give several rows.
    """
    match = keys.existing(df, match)
    there = df.where(reference).select(*(F.col(c).alias(f"_{c}") for c in match), F.col(metric).alias(f"{metric}_reference"))
    rows = df if comparison is None else df.where(comparison)
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in match))
    return rows.join(there, on).drop(*(f"_{c}" for c in match)).withColumn(f"delta_{metric}", F.col(metric) - F.col(f"{metric}_reference"))


def decision_ranking(deltas: DataFrame, groups: list[str], primary: str, secondary: str | None = None, context: list[str] = (), min_pairs: int = 1, performance: str | float = "median", seed: str | None = "seed") -> DataFrame:
    """Groups of paired deltas, ranked in each context by least loss, then by steadiness, then by what they reach.

    rank_by_lowest_loss numbers all groups; decision_rank only those with enough pairs whose mean reaches the threshold (the
    median or third quartile of groups with enough pairs, or a number).  A context without such groups has no ranks.
    """
    metrics = [m for m in (primary, secondary) if m]
    aggs = [F.count("*").alias("n_pairs")]
    if seed and seed in deltas.columns:
        aggs.append(F.count_distinct(seed).alias("n_seeds"))
    for m in metrics:
        d = F.col(f"delta__{m}")
        below = lambda limit, d=d: F.avg(F.when(d < limit, 1.0).otherwise(0.0))
        aggs += [F.avg(f"{m}__baseline").alias(f"baseline_mean__{m}"), F.avg(f"{m}__candidate").alias(f"candidate_mean__{m}"), F.avg(d).alias(f"delta_mean__{m}"), F.percentile(d, F.lit(0.5)).alias(f"delta_median__{m}")]
        aggs += [F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias(f"delta_std__{m}"), F.avg(f"loss__{m}").alias(f"loss_mean__{m}"), F.percentile(f"loss__{m}", F.lit(0.5)).alias(f"loss_median__{m}"), F.avg(f"retention__{m}").alias(f"retention_mean__{m}")]
        aggs += [below(0.0).alias(f"prop_negative_delta__{m}"), below(-0.05).alias(f"prop_delta_below_minus_005__{m}"), below(-0.10).alias(f"prop_delta_below_minus_010__{m}")]
    out = deltas.groupBy(*groups).agg(*aggs)
    part = list(context) or [F.lit(1)]
    mean, enough = F.col(f"candidate_mean__{primary}"), F.col("n_pairs") >= min_pairs
    whole = Window.partitionBy(*part)
    share = {"median": 0.5, "q3": 0.75}.get(performance) if isinstance(performance, str) else None
    limit = F.percentile(F.when(enough, mean), F.lit(share)).over(whole) if share is not None else F.when(F.count(F.when(enough, 1)).over(whole) > 0, F.lit(float(performance)))
    out = out.withColumn("performance_threshold", limit)
    known = F.col("performance_threshold").isNotNull()
    out = out.withColumns({"passes_min_pairs": known & enough, "passes_performance_filter": known & (mean >= F.col("performance_threshold"))})
    # Rounded as the ranks are defined on: sums differ in their last bits from run to run.
    keep = [F.round(f"loss_mean__{primary}", 12).asc_nulls_last(), F.round(f"delta_std__{primary}", 12).asc_nulls_last(), F.round(mean, 12).desc_nulls_last()]
    if secondary:
        keep.append(F.round(f"candidate_mean__{secondary}", 12).desc_nulls_last())
    order = Window.partitionBy(*part).orderBy(*keep, *groups)
    chosen = F.col("passes_min_pairs") & F.col("passes_performance_filter")
    out = out.withColumns({
        "rank_by_lowest_loss": F.when(known, F.row_number().over(order)),
        "decision_rank": F.when(chosen, F.sum(chosen.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")),
    })
    return out.withColumn("decision_class", F.when(~known, "Insufficient pairs").when(F.col("decision_rank").isNotNull(), "Recommended").otherwise("Low performance or insufficient evidence"))


def ranked_distributions(deltas: DataFrame, ranking: DataFrame, groups: list[str], metric: str, rank: str = "rank_by_lowest_loss", panel: str | None = None, top: int = 30, filters: dict[str, object] | None = None) -> DataFrame:
    """The boxes of a ranking: for the top groups (of each value of panel, if there is one) the count and five numbers of their deltas.

    Groups meet their deltas by one key of their columns, in which missing values are equal.  filters: a value or several that a column has to
    have, on both sides.  panel_rank is the least rank in the panel, which orders panels; groups without deltas have no box.
    """
    for column, choice in (filters or {}).items():
        wanted = [str(c) for c in choice] if isinstance(choice, (list, tuple, set)) else [str(choice)]
        deltas, ranking = (df.where(F.col(column).cast("string").isin(wanted)) for df in (deltas, ranking))
    own = [panel] if panel else []
    order = Window.partitionBy(*(own or [F.lit(1)])).orderBy(F.col(rank).asc_nulls_last(), *groups)
    first = ranking.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    shown = list(dict.fromkeys([*own, *keys.existing(ranking, groups)]))
    first = first.select(*shown, F.col(rank).alias("rank"), keys.combo_key(ranking, groups).alias("combo"))
    if panel:
        first = first.withColumn("panel_rank", F.min("rank").over(Window.partitionBy(panel)))
    values = deltas.select(keys.combo_key(deltas, groups).alias("combo"), F.col(f"delta__{metric}").alias("_d")).where("_d is not null")
    chosen = values.join(first.select("combo").distinct(), "combo", "left_semi")  # before values are dealt out by group
    boxes = chosen.groupBy("combo").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in stats.five_numbers(F.col("_d")).items()))
    return first.join(boxes, "combo")
