"""Queries over splits: folds, checks, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import experiment, split
from corvane.plans.registry import registry
from corvane.plans.tables import r, read, rounded

QUERIES, ORACLES, query = registry()


def _fold_sql(by: str = "") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"floor((row_number() OVER ({over}ORDER BY md5(doc_id::VARCHAR || '-7')) - 1) * 5 / count(*) OVER ({over.strip()}))::INTEGER"


@query(f"SELECT doc_id, {_fold_sql()} AS fold FROM labels")
def kfold_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return split.kfold(read(spark, sf_dir, "labels"), "doc_id", 7)


@query(f"SELECT doc_id, quality, {_fold_sql('quality')} AS fold FROM labels")
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9."""
    return split.kfold(read(spark, sf_dir, "labels"), "doc_id", 7, label="quality")


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
d AS (SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS far FROM x JOIN c USING (i) GROUP BY vec_id)
SELECT vec_id, floor((row_number() OVER (ORDER BY far, md5(vec_id::VARCHAR || '-7'), vec_id) - 1) * 5 / count(*) OVER ())::INTEGER AS fold FROM d""")
def kfold_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10."""
    return split.distance_folds(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7)


_ASSIGNED = f"""k AS (SELECT doc_id, quality, {_fold_sql('quality')} AS own FROM labels),
a AS (SELECT doc_id, quality, f::INTEGER AS fold, CASE WHEN own = f THEN 'test' WHEN ('0x' || substr(md5(doc_id::VARCHAR || '-7-' || f::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE < 0.1::DOUBLE THEN 'val' ELSE 'train' END AS part FROM k CROSS JOIN range(5) r(f))"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = split.kfold(read(spark, sf_dir, "labels"), "doc_id", 7, label="quality")
    return split.assignments(folds, "doc_id", 5, 7, strategy="stratified")


@query(f"WITH {_ASSIGNED} SELECT doc_id, quality, fold, part, 7 AS seed, 'stratified' AS strategy FROM a")
def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 fixture: one long table instead of folders."""
    return _assigned(spark, sf_dir)


@query(f"WITH {_ASSIGNED}, e AS (SELECT f::INTEGER AS fold, p AS part FROM range(5) r(f) CROSS JOIN (VALUES ('train'), ('val'), ('test')) v(p)), c AS (SELECT fold, part, count(*) AS n_rows, count(DISTINCT quality) AS n_classes FROM a GROUP BY ALL) SELECT fold, part, coalesce(n_rows, 0)::BIGINT AS n_rows, coalesce(n_classes, 0)::BIGINT AS n_classes, CASE WHEN n_rows > 0 AND n_classes >= 2 THEN 'kept' ELSE 'invalid_split' END AS status FROM e LEFT JOIN c USING (fold, part)")
def split_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12."""
    return split.validate(_assigned(spark, sf_dir), "quality", 5)


_PRE = "c AS (SELECT lang, source, quality, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY ALL), g AS (SELECT lang, source, sum(c)::BIGINT AS n_rows, count(quality)::BIGINT AS n_classes, min(c)::BIGINT AS least_class FROM c GROUP BY ALL), h AS (SELECT *, CASE WHEN n_rows = 0 THEN 'empty_input' WHEN n_classes < 2 THEN 'single_class' WHEN n_rows < 5 THEN 'fewer_rows_than_folds' WHEN least_class < 5 THEN 'class_too_small' ELSE 'ok' END AS reason FROM g), s AS (SELECT *, CASE WHEN reason = 'ok' THEN 'kept' ELSE 'invalid_split' END AS status FROM h)"


def _precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return split.precheck(rows, "quality", 5, by=["lang", "source"], stratified=True)


@query(f"WITH {_PRE} SELECT * FROM s")
def split_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11."""
    return _precheck(spark, sf_dir)


_RATES = f"{r('count(*) FILTER (status = ' + chr(39) + 'kept' + chr(39) + ') / count(*)')} AS kept_rate, {r('count(*) FILTER (status = ' + chr(39) + 'invalid_split' + chr(39) + ') / count(*)')} AS invalid_rate"
_COUNTS = "count(*)::BIGINT AS n_total, count(*) FILTER (status = 'kept')::BIGINT AS n_kept, count(*) FILTER (status = 'invalid_split')::BIGINT AS n_invalid"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _precheck(spark, sf_dir).withColumn("seed", F.regexp_replace("source", "[^0-9]", "").cast("int"))


_SEEDED = _PRE + ", q AS (SELECT *, regexp_replace(source, '[^0-9]', '', 'g')::INTEGER AS seed FROM s)"


@query(f"WITH {_SEEDED} SELECT lang, {_COUNTS}, array_to_string(list_sort(list(DISTINCT seed)), ';') AS seeds, {_RATES} FROM q GROUP BY lang")
def split_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, R13."""
    return rounded(split.status_summary(_status(spark, sf_dir), ["lang"]))


@query(f"WITH {_SEEDED} SELECT reason, {_COUNTS}, count(DISTINCT lang)::BIGINT AS n_scenarios, count(DISTINCT seed)::BIGINT AS n_seeds, {_RATES} FROM q GROUP BY reason")
def split_strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return rounded(split.strategy_summary(_status(spark, sf_dir), ["reason"], scenario="lang"))


@query("SELECT representation, strategy, seed FROM (SELECT DISTINCT lang AS representation FROM documents) a CROSS JOIN (SELECT DISTINCT o_orderstatus AS strategy FROM orders) b CROSS JOIN (SELECT DISTINCT l_linenumber AS seed FROM lineitem) c")
def scenario_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the languages, statuses and line numbers there are."""
    values = lambda table, column: [x[0] for x in read(spark, sf_dir, table).select(column).distinct().orderBy(column).collect()]
    return split.scenarios(spark, representation=values("documents", "lang"), strategy=values("orders", "o_orderstatus"), seed=values("lineitem", "l_linenumber"))


@query(f"WITH {_ASSIGNED} SELECT fold, sha256('TRAIN' || coalesce(string_agg(CASE WHEN part = 'train' THEN doc_id::VARCHAR || '~' END, '' ORDER BY doc_id::VARCHAR), '') || 'TEST' || coalesce(string_agg(CASE WHEN part = 'test' THEN doc_id::VARCHAR || '~' END, '' ORDER BY doc_id::VARCHAR), '')) AS assignment_hash FROM a GROUP BY fold".replace("'~'", "chr(0)"))
def assignment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13."""
    return split.fingerprint(_assigned(spark, sf_dir), "doc_id", ["fold"])


@query(f"WITH {_PRE}, k AS (SELECT lang, avg((status = 'kept')::INT) FILTER (source = 'src0') AS a, avg((status = 'kept')::INT) FILTER (source = 'src1') AS b FROM s GROUP BY lang) SELECT lang, {r('a')} AS src0, {r('b')} AS src1 FROM k")
def split_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept splits by scenario and level, one column a level."""
    return rounded(split.feasibility(_precheck(spark, sf_dir), "lang", "source", ["src0", "src1"]))


@query("SELECT level, kind AS level_kind, v AS level_value, row_number() OVER (ORDER BY CASE kind WHEN 'none' THEN 0 WHEN 'percentile' THEN 1 WHEN 'identity' THEN 2 ELSE 3 END, v NULLS FIRST, level)::INTEGER AS level_order, n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'no_threshold' WHEN 1 THEN 'p' || (l_linenumber * 10)::VARCHAR || '_5' WHEN 2 THEN 'minseqid_0_' || l_linenumber::VARCHAR ELSE 'threshold_0.' || l_linenumber::VARCHAR END AS level, CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'percentile' WHEN 2 THEN 'identity' ELSE 'threshold' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN l_linenumber * 10 + 0.5::DOUBLE ELSE l_linenumber / 10::DOUBLE END AS v, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)")
def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by kind and value."""
    i = F.col("l_linenumber")
    level = F.when(i % 4 == 0, "no_threshold").when(i % 4 == 1, F.concat(F.lit("p"), (i * 10).cast("string"), F.lit("_5"))).when(i % 4 == 2, F.concat(F.lit("minseqid_0_"), i.cast("string"))).otherwise(F.concat(F.lit("threshold_0."), i.cast("string")))
    rows = read(spark, sf_dir, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return split.ordered_levels(rows, "level").select("level", "level_kind", "level_value", "level_order", "n")


@query(f"WITH {_PRE} SELECT lang AS scenario, source AS strategy, a AS algorithm, 'none' AS scaler, lang AS representation_strategy, 'unknown' AS redundancy_strategy FROM s CROSS JOIN (VALUES ('GaussianNB'), ('SVC')) t(a) WHERE status = 'kept'")
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that kept splits make with algorithms and scalers."""
    rows = _precheck(spark, sf_dir).select(F.col("lang").alias("scenario"), F.col("source").alias("strategy"), "status")
    return experiment.training_matrix(rows, ["GaussianNB", "SVC"], ["none"], ["scenario", "strategy"])
