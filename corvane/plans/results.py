"""Queries over results: deltas, rankings, aggregates, selection, insight, names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import keys, naming, stats
from corvane.operators import curate, delta, experiment, insight, report, results
from corvane.plans.registry import registry
from corvane.plans.tables import FOLD_RESULTS, MEAN_RESULTS, fold_results, mean_results, r, read, rounded
from corvane.session import shared_folder
from corvane.sources import sinks, tables

QUERIES, ORACLES, query = registry()

MATCH = ["seed", "cfg", "partition"]


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold_results(spark, sf_dir)
    return delta.paired_delta(rows, F.col("reduction") == "N", F.col("reduction").isin("A", "R"), MATCH, ["reduction"], ["val", "test"], "partition_effect")


_SIDES = f"""f AS (SELECT seed::VARCHAR AS seed, cfg::VARCHAR AS cfg, partition, reduction, val, test FROM ({FOLD_RESULTS})),
b AS (SELECT seed, cfg, partition, avg(val) AS val__baseline, avg(test) AS test__baseline FROM f WHERE reduction = 'N' GROUP BY ALL),
c AS (SELECT seed, cfg, partition, reduction, avg(val) AS val__candidate, avg(test) AS test__candidate FROM f WHERE reduction IN ('A', 'R') GROUP BY ALL),
p AS (SELECT *, val__candidate - val__baseline AS delta__val, val__baseline - val__candidate AS loss__val,
  CASE WHEN abs(val__baseline) > 1e-12::DOUBLE THEN val__candidate / val__baseline END AS retention__val,
  test__candidate - test__baseline AS delta__test, test__baseline - test__candidate AS loss__test,
  CASE WHEN abs(test__baseline) > 1e-12::DOUBLE THEN test__candidate / test__baseline END AS retention__test FROM c JOIN b USING (seed, cfg, partition))"""
_DELTA_COLUMNS = [f"{k}__{m}" for m in ("val", "test") for k in ("delta", "loss", "retention")] + [f"{m}__{s}" for m in ("val", "test") for s in ("candidate", "baseline")]


@query(f"WITH {_SIDES} SELECT seed, cfg, partition, reduction, {', '.join(f'{r(c)} AS {c}' for c in _DELTA_COLUMNS)}, 'partition_effect' AS comparison_name FROM p")
def paired_delta_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against their baseline, both averaged first."""
    return rounded(_deltas(spark, sf_dir))


def _ranking_sql(groups: str, context: str | None, performance: float, least: int) -> str:
    over = f"PARTITION BY {context}" if context else ""
    parts = []
    for m in ("test", "val"):
        d = f"delta__{m}"
        parts += [f"avg({m}__baseline) AS baseline_mean__{m}", f"avg({m}__candidate) AS candidate_mean__{m}", f"avg({d}) AS delta_mean__{m}", f"median({d}) AS delta_median__{m}", f"coalesce(stddev_samp({d}), 0) AS delta_std__{m}", f"avg(loss__{m}) AS loss_mean__{m}", f"median(loss__{m}) AS loss_median__{m}", f"avg(retention__{m}) AS retention_mean__{m}"]
        parts += [f"avg(CASE WHEN {d} < {limit}::DOUBLE THEN 1::DOUBLE ELSE 0 END) AS {name}__{m}" for limit, name in ((0, "prop_negative_delta"), (-0.05, "prop_delta_below_minus_005"), (-0.10, "prop_delta_below_minus_010"))]
    kinds = ("baseline_mean", "candidate_mean", "delta_mean", "delta_median", "delta_std", "loss_mean", "loss_median", "retention_mean", "prop_negative_delta", "prop_delta_below_minus_005", "prop_delta_below_minus_010")
    out = ", ".join(f"{r(f'{k}__{m}')} AS {k}__{m}" for m in ("test", "val") for k in kinds)
    order = f"{over} ORDER BY round(loss_mean__test, 12) NULLS LAST, round(delta_std__test, 12) NULLS LAST, round(candidate_mean__test, 12) DESC NULLS LAST, round(candidate_mean__val, 12) DESC NULLS LAST, {groups}"
    return f"""WITH {_SIDES}, g AS (SELECT {groups}, count(*)::BIGINT AS n_pairs, count(DISTINCT seed)::BIGINT AS n_seeds, {", ".join(parts)} FROM p GROUP BY {groups}),
h AS (SELECT *, (SELECT quantile_cont(x.candidate_mean__test, {performance}::DOUBLE) FROM g x WHERE x.n_pairs >= {least} {f"AND x.{context} = g.{context}" if context else ""}) AS performance_threshold FROM g),
k AS (SELECT *, performance_threshold IS NOT NULL AND n_pairs >= {least} AS passes_min_pairs, performance_threshold IS NOT NULL AND candidate_mean__test >= performance_threshold AS passes_performance_filter FROM h)
SELECT {groups}, n_pairs, n_seeds, {out}, {r("performance_threshold")} AS performance_threshold, passes_min_pairs, passes_performance_filter,
  CASE WHEN performance_threshold IS NOT NULL THEN row_number() OVER ({order}) END::INTEGER AS rank_by_lowest_loss,
  CASE WHEN passes_min_pairs AND passes_performance_filter THEN sum((passes_min_pairs AND passes_performance_filter)::INT) OVER ({order} ROWS UNBOUNDED PRECEDING) END::INTEGER AS decision_rank,
  CASE WHEN performance_threshold IS NULL THEN 'Insufficient pairs' WHEN passes_min_pairs AND passes_performance_filter THEN 'Recommended' ELSE 'Low performance or insufficient evidence' END AS decision_class
FROM k"""


@query(_ranking_sql("reduction, cfg", None, 0.5, 20))
def decision_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas by reduction and configuration, ranked over all."""
    return rounded(delta.decision_ranking(_deltas(spark, sf_dir), ["reduction", "cfg"], "test", "val", min_pairs=20))


@query(_ranking_sql("reduction, cfg, partition", "reduction", 0.75, 50))
def decision_ranking_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked within each reduction, by the third quartile."""
    return rounded(delta.decision_ranking(_deltas(spark, sf_dir), ["reduction", "cfg", "partition"], "test", "val", context=["reduction"], min_pairs=50, performance="q3"))


def _reference_sql(reference: str, match: list[str], comparison: str = "true") -> str:
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in match)
    return f"WITH m AS ({MEAN_RESULTS}) SELECT a.seed, a.cfg, a.reduction, a.partition, {r('a.val')} AS val, {r('a.test')} AS test, {r('b.test')} AS test_reference, {r('a.test - b.test')} AS delta_test FROM m a JOIN (SELECT * FROM m WHERE {reference}) b ON {on} WHERE {comparison}"


@query(_reference_sql("reduction = 'N'", MATCH, "a.reduction <> 'N'"))
def reduction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return rounded(delta.reference_delta(mean_results(spark, sf_dir), F.col("reduction") == "N", MATCH, "test", F.col("reduction") != "N"))


@query(_reference_sql("partition = 'F'", ["seed", "cfg", "reduction"], "a.partition <> 'F'"))
def partition_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return rounded(delta.reference_delta(mean_results(spark, sf_dir), F.col("partition") == "F", ["seed", "cfg", "reduction"], "test", F.col("partition") != "F"))


@query(_reference_sql("partition = 'F' AND reduction = 'N'", ["seed", "cfg"]))
def partition_reduction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, the reference's own too."""
    return rounded(delta.reference_delta(mean_results(spark, sf_dir), (F.col("partition") == "F") & (F.col("reduction") == "N"), ["seed", "cfg"], "test"))


@query(_reference_sql("cfg = 1", ["seed", "reduction", "partition"], "a.cfg = 2"))
def scaler_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, with configurations 1 and 2 as scalers."""
    return rounded(delta.reference_delta(mean_results(spark, sf_dir), F.col("cfg") == 1, ["seed", "reduction", "partition"], "test", F.col("cfg") == 2))


@query(_reference_sql("partition = 'F'", ["seed", "cfg"], "a.partition = 'O'"))
def delta_vs_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduction isn't part of the key, so each row meets every reference of its configuration."""
    return rounded(delta.reference_delta(mean_results(spark, sf_dir), F.col("partition") == "F", ["seed", "cfg"], "test", F.col("partition") == "O"))


@query(f"SELECT cfg, reduction, {', '.join(f'{r(f)} AS {n}' for m in ('val', 'test') for f, n in ((f'avg({m})', f'{m}_mean'), (f'stddev_samp({m})', f'{m}_std')))}, count(val)::BIGINT AS val_n, count(test)::BIGINT AS test_n, NULL::DOUBLE AS f1_mean, NULL::DOUBLE AS f1_std, 0::BIGINT AS f1_n FROM ({FOLD_RESULTS}) GROUP BY ALL")
def fold_results_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, with a metric that the table lacks."""
    return rounded(results.fold_aggregates(fold_results(spark, sf_dir), ["cfg", "reduction"], ["val", "test", "f1"]))


@query(f"SELECT seed, partition, cfg, {r('val')} AS val, {r('test')} AS test FROM (SELECT *, row_number() OVER (PARTITION BY seed, partition ORDER BY round(val, 12) DESC, cfg) AS n FROM (SELECT seed, partition, cfg, avg(val) AS val, avg(test) AS test FROM ({FOLD_RESULTS}) GROUP BY ALL)) WHERE n = 1")
def best_config_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and status as the fold."""
    rows = fold_results(spark, sf_dir).groupBy("seed", "partition", "cfg").agg(F.round(F.avg("val"), 12).alias("val"), F.avg("test").alias("test"))
    return rounded(results.best_per_fold(rows, ["seed", "partition"], "cfg", "val", "test"))


_SEEDS = f"s AS (SELECT reduction, partition, seed, avg(test) AS m, count(test) AS k FROM ({FOLD_RESULTS}) GROUP BY ALL)"


def _seed_sql(half: str) -> str:
    return f"WITH {_SEEDS} SELECT reduction, partition, {r('avg(m)')} AS mean, {r('stddev_samp(m)')} AS sd, {r('stddev_samp(m) / sqrt(count(m))')} AS se, {r(half)} AS ci95, sum(k)::BIGINT AS n_evaluations, count(m)::BIGINT AS n_seeds FROM s GROUP BY ALL"


_T = "CASE WHEN count(m) < 2 THEN NULL WHEN count(m) - 1 <= 30 THEN list_extract([" + ", ".join(f"{q}::DOUBLE" for q in stats.T_975) + "], (count(m) - 1)::BIGINT) ELSE 1.96::DOUBLE END"


@query(_seed_sql(f"{_T} * stddev_samp(m) / sqrt(count(m))"))
def seed_level_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed means first, half widths by Student's t."""
    return rounded(results.seed_summary(fold_results(spark, sf_dir), ["reduction", "partition"], "seed", "test"))


@query(_seed_sql("CASE WHEN count(m) <= 1 THEN 0 ELSE 1.96::DOUBLE * stddev_samp(m) / sqrt(count(m)) END"))
def seed_level_ci_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths by 1.96 standard errors."""
    return rounded(results.seed_summary(fold_results(spark, sf_dir), ["reduction", "partition"], "seed", "test", rule="normal"))


_HALF = _T.replace("count(m)", "count(x)") + " * stddev_samp(x) / sqrt(count(x))"


@query(f"""WITH f AS ({FOLD_RESULTS}), v AS (SELECT reduction, cfg, avg(x) AS m, {_HALF} AS h, count(x) AS n FROM (SELECT reduction, cfg, seed, avg(val) AS x FROM f GROUP BY ALL) GROUP BY ALL),
t AS (SELECT reduction, cfg, avg(x) AS m, {_HALF} AS h FROM (SELECT reduction, cfg, seed, avg(test) AS x FROM f GROUP BY ALL) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY reduction ORDER BY round(m, 12) DESC, cfg) AS rank FROM v)
SELECT reduction, cfg, {r('k.m')} AS validation_mean, {r('k.h')} AS validation_ci95, n::BIGINT AS n_seeds, rank::INTEGER AS rank, {r('t.m')} AS test_mean, {r('t.h')} AS test_ci95 FROM k LEFT JOIN t USING (reduction, cfg) WHERE rank <= 3""")
def validation_selected_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen by validation, told with test."""
    return rounded(results.selected_by_validation(fold_results(spark, sf_dir), ["reduction"], ["cfg"], "seed", "val", "test", 3))


@query("SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n_orders FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5) GROUP BY ALL")
def complete_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with all five priorities."""
    rows = results.complete_units(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority"], 5)
    return rows.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n_orders"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH e AS (SELECT n_nationkey, f.flag FROM nation CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) f(flag)),
x AS (SELECT s_nationkey AS n_nationkey, l_returnflag AS flag, count(*) AS n_found FROM (SELECT DISTINCT s_nationkey, s_suppkey, l_returnflag FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) GROUP BY ALL)
SELECT n_nationkey, flag, coalesce(n_found, 0)::BIGINT AS n_found, CASE coalesce(n_found, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM e LEFT JOIN x USING (n_nationkey, flag)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected nation and flag combinations against what suppliers delivered."""
    expected = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(f) for f in "ANRX"))).alias("flag"))
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("flag")).distinct()
    found = read(spark, sf_dir, "supplier").join(pairs, "s_suppkey").select(F.col("s_nationkey").alias("n_nationkey"), "flag")
    return results.completeness(expected, found, ["n_nationkey", "flag"])


@query(f"""WITH base AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ALL),
new AS (SELECT o_custkey, o_orderpriority, total * 2 AS total, n, 'corrected' AS note FROM base WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, o_orderpriority, {r('total', 2)} AS total, n::BIGINT AS n, NULL AS note, 'original' AS origin FROM base WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_custkey, o_orderpriority, {r('total', 2)}, n, note, 'replacement' FROM new""")
def corrected_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One priority's rows replaced by key, with a column that the base lacks."""
    base = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    new = base.where(F.col("o_orderpriority") == "1-URGENT").withColumns({"total": F.col("total") * 2, "note": F.lit("corrected")})
    return rounded(results.corrected_master(base, new, ["o_custkey", "o_orderpriority"]), 2)


@query("SELECT l_suppkey, l_linenumber, l_returnflag, l_linestatus, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def identity_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that several results claim."""
    return results.identity_repeats(read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "absent"])


@query(f"SELECT seed, partition, {r('sum(v * n) / sum(n)')} AS v FROM (SELECT seed, partition, cfg, avg(test) AS v, count(*) AS n FROM ({FOLD_RESULTS}) GROUP BY ALL) GROUP BY ALL")
def weighted_seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds to seeds, weighted by rows."""
    rows = fold_results(spark, sf_dir).groupBy("seed", "partition", "cfg").agg(F.avg("test").alias("v"), F.count("*").alias("n"))
    return rounded(results.weighted_seed_mean(rows, ["seed", "partition"], "n", ["v"]))


@query(f"SELECT o_orderpriority, {', '.join(r(f'avg(CASE WHEN o_orderstatus = {chr(39)}{s}{chr(39)} THEN o_totalprice END)', 4) + f' AS {chr(34)}{s}{chr(34)}' for s in 'FOP')} FROM orders GROUP BY ALL")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A38."""
    return rounded(results.heatmap(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", list("FOP"), "o_totalprice"), 4)


@query(f"SELECT reduction, partition, count(*)::BIGINT AS n, {r('min(test)')} AS minimum, {r('quantile_cont(test, 0.25::DOUBLE)')} AS q1, {r('median(test)')} AS median, {r('quantile_cont(test, 0.75::DOUBLE)')} AS q3, {r('max(test)')} AS maximum FROM ({MEAN_RESULTS}) GROUP BY ALL")
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data of effect boxplots."""
    return rounded(results.five_number_summary(mean_results(spark, sf_dir), ["reduction", "partition"], "test"))


@query(f"""WITH m AS (SELECT reduction, CASE cfg WHEN 1 THEN 'p100' ELSE 'p' || (10 * cfg)::VARCHAR END AS level, test FROM ({MEAN_RESULTS}))
SELECT reduction, level, {r('avg(test)')} AS mean, {r('coalesce(stddev_samp(test) / sqrt(count(test)), 0)')} AS sem, count(test)::BIGINT AS n FROM m WHERE level <> 'p100' GROUP BY ALL
UNION ALL SELECT DISTINCT reduction, 'p100', 0::DOUBLE, 0::DOUBLE, 0::BIGINT FROM m""")
def threshold_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by level and a zero anchor."""
    level = F.when(F.col("cfg") == 1, "p100").otherwise(F.concat(F.lit("p"), (F.col("cfg") * 10).cast("string")))
    return rounded(results.threshold_panel(mean_results(spark, sf_dir).withColumn("level", level), ["reduction"], "level", "test"))


@query(f"""WITH {_SIDES}, q AS (SELECT reduction, cfg, quantile_cont(delta__test, 0.25::DOUBLE) AS q1, quantile_cont(delta__test, 0.75::DOUBLE) AS q3 FROM p GROUP BY ALL)
SELECT seed, cfg, partition, reduction, {r('delta__test')} AS delta__test, {r('q1 - 1.5::DOUBLE * (q3 - q1)')} AS lower_bound, {r('q3 + 1.5::DOUBLE * (q3 - q1)')} AS upper_bound,
CASE WHEN delta__test > q3 + 1.5::DOUBLE * (q3 - q1) THEN 'high' ELSE 'low' END AS outlier_type FROM p JOIN q USING (reduction, cfg) WHERE delta__test > q3 + 1.5::DOUBLE * (q3 - q1) OR delta__test < q1 - 1.5::DOUBLE * (q3 - q1)""")
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A44."""
    found = insight.outliers(_deltas(spark, sf_dir), ["reduction", "cfg"], "delta__test")
    return rounded(found.select("seed", "cfg", "partition", "reduction", "delta__test", "lower_bound", "upper_bound", "outlier_type"))


@query(f"""WITH {_SIDES}, q AS (SELECT reduction, quantile_cont(delta__test, 0.25::DOUBLE) AS q1, quantile_cont(delta__test, 0.75::DOUBLE) AS q3 FROM p GROUP BY ALL),
o AS (SELECT p.*, delta__test > q3 + 1.5::DOUBLE * (q3 - q1) AS high FROM p JOIN q USING (reduction) WHERE delta__test > q3 + 1.5::DOUBLE * (q3 - q1) OR delta__test < q1 - 1.5::DOUBLE * (q3 - q1))
SELECT reduction, count(*) FILTER (high AND delta__test > 0)::BIGINT AS n_positive, count(*) FILTER (high AND delta__test > 0 AND abs(test__baseline) <= 1e-8::DOUBLE)::BIGINT AS n_zero_baseline FROM o GROUP BY ALL""")
def positive_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A45."""
    found = insight.outliers(_deltas(spark, sf_dir), ["reduction"], "delta__test")
    return insight.positive_outliers(found, ["reduction"], "delta__test", "test__baseline")


def _part_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return curate.numbered(parts, [F.col("p_retailprice").desc(), F.col("p_partkey")], "rank_by_lowest_loss")


def _enrichment_sql(top: str) -> str:
    return f"""WITH k AS (SELECT p_brand, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), n AS (SELECT count(*) AS n, {top} AS t FROM part),
v AS (SELECT 'p_brand' AS feature, p_brand AS value, rank FROM k UNION ALL SELECT 'p_size', p_size::VARCHAR, rank FROM k),
c AS (SELECT feature, value, count(*) FILTER (rank <= t) AS top_count, count(*) AS all_count FROM v, n GROUP BY ALL)
SELECT feature, value, all_count::BIGINT AS all_count, top_count::BIGINT AS top_count, {r('top_count / t::DOUBLE')} AS top_fraction, {r('all_count / n::DOUBLE')} AS all_fraction, {r('(top_count / t::DOUBLE) / (all_count / n::DOUBLE)')} AS enrichment FROM c, n WHERE top_count > 0"""


@query(_enrichment_sql("20"))
def enrichment_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A48, J16."""
    return rounded(insight.enrichment(_part_ranking(spark, sf_dir), ["p_brand", "p_size", "absent"], 20))


@query(_enrichment_sql("least(count(*), greatest(5, ceil(count(*) * 0.1::DOUBLE)))"))
def enrichment_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tenth."""
    return rounded(insight.enrichment_share(_part_ranking(spark, sf_dir), ["p_brand", "p_size"], 0.1))


@query("""WITH f AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS a, bool_or(o_orderstatus = 'F') AS b, bool_or(o_totalprice > 300000) AS c FROM orders GROUP BY ALL)
SELECT CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END AS region, count(*)::BIGINT AS n FROM f WHERE a OR b OR c GROUP BY ALL""")
def venn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A50."""
    return insight.venn3(read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000)


_TOP = f"top AS (SELECT cfg, row_number() OVER (ORDER BY round(avg(val), 12) DESC, cfg) AS rank FROM ({FOLD_RESULTS}) GROUP BY cfg QUALIFY rank <= 4)"
_PAIRS = f"""u AS (SELECT cfg, seed, partition, avg(test) AS m FROM ({FOLD_RESULTS}) WHERE cfg IN (SELECT cfg FROM top) GROUP BY ALL),
d AS (SELECT a.cfg AS first, b.cfg AS second, a.m - b.m AS x FROM u a JOIN u b USING (seed, partition) JOIN top ta ON ta.cfg = a.cfg JOIN top tb ON tb.cfg = b.cfg WHERE ta.rank < tb.rank)"""


def _top_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = fold_results(spark, sf_dir)
    order = Window.orderBy(F.round("v", 12).desc(), "cfg")
    top = rows.groupBy("cfg").agg(F.avg("val").alias("v")).withColumn("rank", F.row_number().over(order)).where("rank <= 4").drop("v")
    return insight.pair_differences(rows, "cfg", ["seed", "partition"], "test", top)


@query(f"WITH {_TOP}, {_PAIRS} SELECT first, second, count(x)::BIGINT AS n_pairs, {r('avg(x)')} AS mean, {r('median(x)')} AS median, {r('coalesce(stddev_samp(x), 0)')} AS std, avg(x) > 0 AS first_higher FROM d GROUP BY ALL")
def pairwise_top_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the four best configurations; their bootstrap intervals are pairwise_intervals."""
    return rounded(insight.pair_means(_top_differences(spark, sf_dir)))


_DRAWN = f"""k AS (SELECT first, second, x, ('0x' || substr(md5(seed::VARCHAR || '|' || partition), 1, 13))::BIGINT AS key FROM d WHERE x IS NOT NULL),
a AS (SELECT first, second, x, i, key, (key % {insight.PRIME} + i * 69621 % {insight.PRIME} + 123 * 40692) % {insight.PRIME} AS a FROM k CROSS JOIN range(2000) r(i)),
b AS (SELECT *, (a * a + 3 * a + 7) % {insight.PRIME} AS b FROM a), c AS (SELECT *, (b * 16807 + key // {insight.PRIME}) % {insight.PRIME} AS c FROM b), e AS (SELECT *, ((c * c + 5 * c + 11) % {insight.PRIME} * 48271 % {insight.PRIME})::DOUBLE / {insight.PRIME} AS u FROM c),
w AS (SELECT *, {' + '.join(f'(u >= {p!r}::DOUBLE)::INTEGER' for p in insight.POISSON)} AS w FROM e), s AS (SELECT first, second, i, sum(w * x) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
q AS (SELECT first, second, quantile_cont(m, 0.025::DOUBLE) AS lo, quantile_cont(m, 0.975::DOUBLE) AS hi FROM s GROUP BY ALL),
t AS (SELECT first, second, count(x)::BIGINT AS n, avg(x) AS mean, median(x) AS median, coalesce(stddev_samp(x), 0) AS std FROM d GROUP BY ALL),
v AS (SELECT t.*, CASE WHEN n < 2 THEN mean ELSE lo END AS low, CASE WHEN n < 2 THEN mean ELSE hi END AS high FROM t JOIN q USING (first, second))"""
_DIFFERENCES = _PAIRS.replace("a.m - b.m AS x", "a.m - b.m AS x, seed, partition")


@query(f"WITH {_TOP}, {_DIFFERENCES}, {_DRAWN} SELECT first, second, n AS n_pairs, {r('mean')} AS mean, {r('median')} AS median, {r('std')} AS std, mean > 0 AS first_higher, {r('low')} AS ci_low, {r('high')} AS ci_high, low <= 0 AND high >= 0 AS ci_crosses_zero FROM v")
def pairwise_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparisons with bootstrap intervals, whose draws are hashes of units."""
    return rounded(insight.compared_pairs(_top_differences(spark, sf_dir), key=["seed", "partition"]))


@query(f"WITH {_TOP}, {_DIFFERENCES}, {_DRAWN} SELECT first, second, n, {r('mean')} AS estimate, {r('low')} AS low, {r('high')} AS high FROM v")
def pairwise_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same differences with bootstrap intervals."""
    return _rounded(insight.bootstrap_ci(_top_differences(spark, sf_dir), ["first", "second"], "difference", key=["seed", "partition"]))


def _rounded(df: DataFrame | None) -> DataFrame | None:
    return rounded(df) if df is not None else None


_SPACES = "SELECT 's' || (l_suppkey % 7)::VARCHAR AS rep, 'm' || (l_partkey % 5)::VARCHAR || '_t' AS red, CASE WHEN l_quantity > 25 THEN 'z' || (l_orderkey % 3)::VARCHAR END AS split, l_linenumber % 5 AS kind FROM lineitem"


@query(f"""WITH x AS ({_SPACES}), k AS (SELECT CASE kind WHEN 4 THEN rep || '_reduced_descriptor' ELSE rep END AS representation_clean, CASE kind WHEN 0 THEN 'no_reduction' WHEN 1 THEN 'homology_reduction' WHEN 4 THEN 'unknown' ELSE 'distance_reduction' END AS reduction_strategy_clean,
CASE kind WHEN 2 THEN rep WHEN 3 THEN red WHEN 4 THEN 'unknown' ELSE 'none' END AS reduced_by, coalesce(split, CASE kind WHEN 2 THEN rep WHEN 3 THEN red WHEN 4 THEN 'unknown' ELSE rep END) AS split_space_clean FROM x) SELECT *, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def parse_experiment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of experiments that lines make, read apart."""
    c = lambda x: x.cast("string")
    rep, red, kind = F.concat(F.lit("s"), c(F.col("l_suppkey") % 7)), F.concat(F.lit("m"), c(F.col("l_partkey") % 5), F.lit("_t")), F.col("l_linenumber") % 5
    ending = F.when(kind == 0, "_no_reduced").when(kind == 1, "_reduced_homology").when(kind == 2, "_reduced_distance").when(kind == 3, F.concat(F.lit("_reduced_distance_by_"), red)).otherwise("_reduced_descriptor")
    split = F.when(F.col("l_quantity") > 25, F.concat(F.lit("_split_by_z"), c(F.col("l_orderkey") % 3))).otherwise("")
    told = naming.experiment(F.col("name"))
    return read(spark, sf_dir, "lineitem").select(F.concat(rep, ending, split).alias("name")).groupBy(*(v.alias(k) for k, v in told.items())).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_quantity::INTEGER AS q, l_linenumber AS i FROM lineitem), v AS (SELECT CASE i WHEN 1 THEN 'p' || q::VARCHAR || '_0' WHEN 2 THEN ' P ' || q::VARCHAR WHEN 3 THEN 'p' || q::VARCHAR || '_5' WHEN 4 THEN '0.' || lpad(q::VARCHAR, 2, '0') WHEN 5 THEN (q + 1)::VARCHAR || '.25' WHEN 6 THEN 'none' ELSE 'junk' END AS value,
CASE i WHEN 3 THEN 'p' || q::VARCHAR || '_5' WHEN 5 THEN 'p' || (q + 1)::VARCHAR || '_25' WHEN 6 THEN 'p100' WHEN 7 THEN NULL ELSE 'p' || q::VARCHAR END AS level FROM x) SELECT value, level, count(*)::BIGINT AS n FROM v GROUP BY ALL""")
def normalize_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles that lines spell in seven ways."""
    i, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = lambda x: x.cast("string")
    value = F.when(i == 1, F.concat(F.lit("p"), text(q), F.lit("_0"))).when(i == 2, F.concat(F.lit(" P "), text(q))).when(i == 3, F.concat(F.lit("p"), text(q), F.lit("_5"))).when(i == 4, F.concat(F.lit("0."), F.lpad(text(q), 2, "0")))
    value = value.when(i == 5, F.concat(text(q + 1), F.lit(".25"))).when(i == 6, "none").otherwise("junk")
    return read(spark, sf_dir, "lineitem").groupBy(value.alias("value")).agg(F.count("*").alias("n")).select("value", naming.normal_threshold(F.col("value")).alias("level"), "n")


@query("""WITH x AS (SELECT l_quantity::INTEGER AS q, l_linenumber % 4 AS i FROM lineitem) SELECT CASE i WHEN 0 THEN 'no_threshold' WHEN 1 THEN 'p' || q::VARCHAR || '_5' WHEN 2 THEN 'threshold_0.' || q::VARCHAR ELSE 'minseqid_0_' || q::VARCHAR END AS level, CASE i WHEN 0 THEN 'none' WHEN 1 THEN 'percentile' WHEN 2 THEN 'threshold' ELSE 'identity' END AS kind,
CASE WHEN i = 1 THEN q + 0.5::DOUBLE WHEN i > 1 THEN ('0.' || q::VARCHAR)::DOUBLE END AS value, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def parameter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and number of the levels that lines name."""
    i, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    level = F.when(i == 0, "no_threshold").when(i == 1, F.concat(F.lit("p"), q, F.lit("_5"))).when(i == 2, F.concat(F.lit("threshold_0."), q)).otherwise(F.concat(F.lit("minseqid_0_"), q))
    rows = read(spark, sf_dir, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return rows.select("level", naming.parameter_type(F.col("level")).alias("kind"), naming.parameter_value(F.col("level")).alias("value"), "n")


@query("""SELECT p_partkey, p_brand || ' | ' || p_size::VARCHAR AS combo, CASE WHEN lower(trim(p_brand)) LIKE 'brand%' THEN 'B' ELSE p_brand END AS label,
CASE WHEN p_size >= 6 THEN '>=6 sources' WHEN p_size = 1 THEN '1 source' ELSE p_size::VARCHAR || ' sources' END AS support FROM part""")
def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined keys (an absent column is left out), labels with the value as fallback, support groups."""
    parts = read(spark, sf_dir, "part")
    label = F.when(F.lower(F.trim("p_brand")).startswith("brand"), "B").otherwise(naming.labelled(F.col("p_brand"), naming.PARTITION_LABELS))
    return parts.select("p_partkey", keys.combo_key(parts, ["p_brand", "p_size", "absent"]).alias("combo"), label.alias("label"), naming.support_group(F.col("p_size")).alias("support"))


@query(f"SELECT l_returnflag AS scaler, count(*)::BIGINT AS n_rows, count(DISTINCT l_suppkey)::BIGINT AS n_experiments, count(*) FILTER (l_linestatus <> 'F')::BIGINT AS n_invalid_spaces FROM lineitem GROUP BY ALL")
def result_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A56."""
    return report.audit(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_linestatus", ["F"])


@query("""SELECT o_orderstatus, '{' || string_agg('"' || p || '":' || n::VARCHAR, ',' ORDER BY p) || '}' AS counts FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL""")
def compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A51."""
    return report.compact_counts(read(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderstatus"])


@query(f"SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS n_1, count(*) FILTER (quality = 0)::BIGINT AS n_0, count(DISTINCT quality)::BIGINT AS n_classes, {r('count(*) FILTER (quality = 1) / count(quality)')} AS fraction_1 FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A53, P32."""
    return rounded(report.balance(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id"), "quality", ["lang"]))


@query(f"SELECT l_returnflag, {r('min(l_tax) - 0.05::DOUBLE * (max(l_tax) - min(l_tax))')} AS l_tax_low, {r('max(l_tax) + 0.05::DOUBLE * (max(l_tax) - min(l_tax))')} AS l_tax_high FROM lineitem GROUP BY ALL")
def axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A55."""
    return rounded(report.limits(read(spark, sf_dir, "lineitem"), ["l_tax"], ["l_returnflag"]))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-3'), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50, which is what is asked for."""
    return report.sampled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 3)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, W3, W5."""
    rows = report.first_of_each(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_orderpriority")


@query(f"WITH m AS (SELECT cfg, avg(test) AS v FROM ({FOLD_RESULTS}) GROUP BY ALL) SELECT cfg, {r('v', 9)} AS v, {r('v - lag(v) OVER (ORDER BY cfg)', 9)} AS step, coalesce(v - lag(v) OVER (ORDER BY cfg) <= 0, true) AS non_increasing FROM m")
def ladder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return rounded(report.steps(fold_results(spark, sf_dir).groupBy("cfg").agg(F.avg("test").alias("v")), "cfg", "v"), 9)


@query(f"WITH u AS (SELECT l_returnflag AS reduction, 'cfg' || l_linenumber::VARCHAR AS metric_name, l_tax AS value, 'test_' || l_linestatus AS stage FROM lineitem UNION ALL SELECT l_returnflag, 'MCC', l_discount, 'val' FROM lineitem) SELECT reduction, count(*)::BIGINT AS n, {r('avg(value)')} AS mcc FROM (SELECT * FROM u WHERE stage LIKE '%test%' AND metric_name = 'cfg1') GROUP BY ALL")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric of a long table's test rows."""
    items = read(spark, sf_dir, "lineitem")
    one = items.select(F.col("l_returnflag").alias("reduction"), F.concat(F.lit("cfg"), F.col("l_linenumber").cast("string")).alias("metric_name"), F.col("l_tax").alias("value"), F.concat(F.lit("test_"), "l_linestatus").alias("stage"))
    two = items.select(F.col("l_returnflag").alias("reduction"), F.lit("MCC").alias("metric_name"), F.col("l_discount").alias("value"), F.lit("val").alias("stage"))
    rows = report.as_metric(report.test_rows(report.union_all([one, two])), "mcc", "cfg1")
    return rounded(rows.groupBy("reduction").agg(F.count("*").alias("n"), F.avg("mcc").alias("mcc")))


_KEPT = "SELECT lang, p::DOUBLE AS p, count(*) AS n, count(*) FILTER (doc_id % 100 < p) AS k, count(*) FILTER (doc_id % 100 < p AND n_chars > 1000) AS k1 FROM documents CROSS JOIN (VALUES (30), (60), (90)) t(p) GROUP BY ALL"


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What percentiles of ids leave of each language, as a reducer's files, one a language, read back."""
    folder = f"{shared_folder(spark)}/corvane/summaries-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "documents").withColumn("percentile", F.explode(F.array(*(F.lit(p) for p in (30.0, 60.0, 90.0)))))
    kept = F.col("doc_id") % 100 < F.col("percentile")
    rows = rows.groupBy(F.concat("lang", F.lit("_reduced_distance_reduction_summary.csv")).alias("file"), "percentile").agg(F.count("*").alias("n_total"), F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.col("n_chars") <= 1000)).alias("n_0"), F.count_if(kept & (F.col("n_chars") > 1000)).alias("n_1"))
    sinks.write_named(rows, folder, "file")
    return tables.read_summaries(spark, folder, "percentile double, n_total long, n_kept long, n_0 long, n_1 long")


@query(f"SELECT 'All' AS dataset_reduction_label, 'distance' AS reduction_kind, 'percentile' AS parameter_type, p AS parameter_value, n::BIGINT AS n_input, k::BIGINT AS n_reduced, {r('k / n')} AS retained_fraction, {r('100 * k / n')} AS retained_percent, {r('100 - 100 * k / n')} AS removed_percent FROM ({_KEPT})")
def reduction_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of each language, read from its file, in the common layout."""
    return rounded(report.reduction_summary(_summaries(spark, sf_dir), "All", "distance"))


@query(f"WITH t AS (SELECT count(*) AS total FROM documents) SELECT lang AS model, k::BIGINT AS n_reduced, {r('k / total')} AS coverage, {r('k1 / k')} AS fraction_1 FROM ({_KEPT}), t WHERE p = 90")
def reduction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ninetieth percentile keeps of each language, and of which class."""
    total = read(spark, sf_dir, "documents").count()
    return rounded(report.coverage(_summaries(spark, sf_dir).withColumnRenamed("n_kept", "n_reduced"), 90.0, total))


def _box_sql(top: str, shown: str, key: str) -> str:
    q = lambda p: r(f"quantile_cont(delta__test, {p}::DOUBLE)")
    return f"""WITH {_SIDES}, k AS (SELECT reduction, cfg, partition, row_number() OVER (ORDER BY round(avg(loss__test), 12), round(coalesce(stddev_samp(delta__test), 0), 12), round(avg(test__candidate), 12) DESC, reduction, cfg, partition)::INTEGER AS rank FROM p GROUP BY reduction, cfg, partition),
t AS ({top}) SELECT {shown}, t.rank, {key} AS combo, count(*)::BIGINT AS n, {q(0)} AS minimum, {q(0.25)} AS q1, {q(0.5)} AS median, {q(0.75)} AS q3, {q(1)} AS maximum FROM t JOIN p USING (reduction, cfg, partition) GROUP BY ALL"""


_COMBO = "reduction || ' | ' || cfg || ' | ' || partition"


def _box_ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    deltas = _deltas(spark, sf_dir)
    return deltas, delta.decision_ranking(deltas, ["reduction", "cfg", "partition"], "test")


@query(_box_sql("SELECT * FROM k WHERE rank <= 10", "reduction, cfg, partition", _COMBO))
def combination_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the deltas behind the ten best combinations, met by one key of their columns."""
    deltas, ranking = _box_ranking(spark, sf_dir)
    return rounded(delta.ranked_distributions(deltas, ranking, ["reduction", "cfg", "partition"], "test", top=10))


@query(_box_sql("SELECT *, min(rank) OVER (PARTITION BY partition) AS panel_rank FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY rank) AS n FROM k WHERE reduction = 'R') WHERE n <= 3", "reduction, cfg, partition, panel_rank", _COMBO))
def sensitivity_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best configurations of each partition's panel, of one reduction."""
    deltas, ranking = _box_ranking(spark, sf_dir)
    out = delta.ranked_distributions(deltas, ranking, ["reduction", "cfg", "partition"], "test", panel="partition", top=3, filters={"reduction": "R"})
    return rounded(out)


@query(f"SELECT l_partkey::VARCHAR AS representation, count(*)::BIGINT AS n, {r('avg(l_tax)')} AS mcc FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY ALL")
def result_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results made ready for a panel: unscaled rows of distance reductions only, of the levels that parse."""
    items = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "distance_reduction").when(F.col("l_returnflag") == "A", "homology_reduction").otherwise("unknown")
    rows = items.select(F.lit("random").alias("partition_strategy"), *(F.col("l_tax").alias(m) for m in ("mcc_val_mean", "f1_val_mean", "mcc_test_mean")), F.lit("SVC").alias("algorithm"), F.col("l_suppkey").alias("seed"), F.col("l_linenumber").alias("cfg_idx"), F.col("l_partkey").cast("string").alias("representation_clean"), kind.alias("reduction_strategy_clean"), F.lit("p30_0").alias("reduction_level"), F.lit("prot_bert").alias("reduced_by"), F.when(F.col("l_linestatus") == "O", "no_norm").otherwise("l2").alias("scaler"))
    ready = report.result_table(report.prepared_results(rows))
    return rounded(ready.where("threshold = 'p30' and reduced_by_label = 'ProtBERT'").groupBy(F.col("representation_label").alias("representation")).agg(F.count("*").alias("n"), F.avg("mcc_test_mean").alias("mcc")))


@query(f"SELECT threshold, count(*)::BIGINT AS n, {r('avg(s)')} AS mean FROM (SELECT 'p' || (l_linenumber * 10)::VARCHAR AS threshold, l_discount AS s FROM lineitem WHERE l_linenumber IN (2, 3) AND l_returnflag = 'A') GROUP BY ALL")
def similarity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of similarity of the wanted levels and representation."""
    rows = read(spark, sf_dir, "lineitem").select(F.lit("random").alias("split_strategy"), F.concat(F.lit("p"), (F.col("l_linenumber") * 10).cast("string"), F.lit("_0")).alias("reduction_level"), F.col("l_discount").alias("s"), F.col("l_returnflag").alias("train_representation"))
    out = report.similarity_observations(rows, "s", "p20 30", "A")
    return rounded(out.groupBy("threshold").agg(F.count("*").alias("n"), F.avg("s").alias("mean")))


@query("SELECT l_linenumber::BIGINT AS i, CASE WHEN l_linenumber = 1 THEN 'no_threshold' WHEN l_linenumber % 2 = 0 THEN (l_linenumber * 10)::VARCHAR ELSE (l_linenumber * 10)::VARCHAR || '.5' END AS shown, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as they are shown."""
    value = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 10 + F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(0.5))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), experiment.parameter_text(value.cast("string")).alias("shown")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT 'p' || (ascii(p) - 48)::VARCHAR || '0_0' AS level, CASE WHEN s = 'F' THEN '/d/p' || (ascii(p) - 48)::VARCHAR || '0_0/data_nr_labeled.csv' END AS reduced_dataset, n::BIGINT AS n FROM f")
def reduced_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reduced table of each row of a summary lies, among the files that are there."""
    rows = read(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("p"), "o_orderstatus").agg(F.count("*").alias("n"))
    value = F.concat("p", F.lit("0.0"))
    there = rows.where("o_orderstatus = 'F'").select(F.explode(F.array(*(F.concat(F.lit("/d/p"), F.replace(value, F.lit("."), F.lit("_")), F.lit(f"/{n}")) for n in ("data_nr.csv", "data_nr_labeled.csv")))).alias("path"))
    lost = F.when(F.col("o_orderstatus") != "F", F.lit("threshold")).otherwise("percentile")
    summary = rows.select(F.when(F.col("o_orderstatus") == "F", "distance").otherwise("homology").alias("kind"), lost.alias("parameter_type"), value.alias("parameter_value"), "n")
    out = experiment.reduced_tables(summary, there, "/d")
    return out.select(F.concat(F.lit("p"), F.replace(F.col("parameter_value"), F.lit("."), F.lit("_"))).alias("level"), "reduced_dataset", "n")


@query(f"WITH m AS ({MEAN_RESULTS}), d AS (SELECT a.cfg, a.partition, a.reduction, a.test - b.test AS x FROM m a JOIN (SELECT * FROM m WHERE reduction = 'N') b ON a.seed = b.seed AND a.cfg = b.cfg AND a.partition = b.partition WHERE a.reduction <> 'N') SELECT partition, reduction, count(*)::BIGINT AS n, " + ", ".join(f"{r(f'quantile_cont(x, {p}::DOUBLE)')} AS {k}" for k, p in (("minimum", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1))) + " FROM d GROUP BY ALL")
def delta_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """five numbers of the deltas of a reduction, in a facet for each partition."""
    rows = delta.reference_delta(mean_results(spark, sf_dir), F.col("reduction") == "N", MATCH, "test", F.col("reduction") != "N")
    return rounded(results.five_number_summary(rows, ["partition", "reduction"], "delta_test"))


@query(f"WITH m AS ({MEAN_RESULTS}), d AS (SELECT a.cfg, a.reduction, a.test - b.test AS x FROM m a JOIN (SELECT * FROM m WHERE partition = 'F') b ON a.seed = b.seed AND a.cfg = b.cfg AND a.reduction = b.reduction WHERE a.partition <> 'F') SELECT cfg, " + ", ".join(f"{r(chr(97) + 'vg(x) FILTER (reduction = ' + chr(39) + k + chr(39) + ')')} AS \"{k}\"" for k in "ANR") + " FROM d GROUP BY cfg")
def delta_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean deltas of a partition, configurations by reductions."""
    rows = delta.reference_delta(mean_results(spark, sf_dir), F.col("partition") == "F", ["seed", "cfg", "reduction"], "test", F.col("partition") != "F")
    return rounded(results.heatmap(rows, "cfg", "reduction", ["A", "N", "R"], "delta_test"))
