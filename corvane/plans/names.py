"""Queries over names: what is read out of them, over names that the driver tables are made to bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import keys, naming
from corvane.operators import experiment, geometry, report
from corvane.plans.registry import registry
from corvane.plans.tables import r, read, rounded

QUERIES, ORACLES, query = registry()


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys and how many lines each has, to make names of."""
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))


_N = "k AS (SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)"


def _pick(column: str, *values: str | None):
    """One of the values by a number's remainder."""
    out = F.lit(values[0])
    for i, v in enumerate(values):
        out = F.when(F.col(column) % len(values) == i, F.lit(v)).otherwise(out)
    return out


def _pick_sql(column: str, *values: str | None) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


_REPS, _REDS = ("One-hot", "Ankh2", "other"), ("No reduction", "Distance reduction", "unknown", None)


@query(f"WITH {_N}, x AS (SELECT {_pick_sql('l_partkey', *_REPS)} AS rep, {_pick_sql('l_partkey', *_REDS)} AS red, n FROM k), f AS (SELECT rep = 'One-hot' AS is_onehot, coalesce(red IN ('No reduction', 'unknown'), false) AS is_no_reduction, rep = 'Ankh2' AS is_embedding, n FROM x) SELECT is_onehot, is_no_reduction, is_embedding, CASE WHEN is_no_reduction AND is_onehot THEN 'B1: One-hot + No reduction' WHEN is_no_reduction AND is_embedding THEN 'B2: Embeddings + No reduction' ELSE 'Other' END AS context, sum(n)::BIGINT AS n FROM f GROUP BY ALL")
def baseline_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which baseline rows may be held against, from flags of their labels."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", *_REPS).alias("rep"), _pick("l_partkey", *_REDS).alias("red"), "n")
    rows = rows.withColumns(naming.context_flags(F.col("rep"), F.col("red"), ["Ankh2"]))
    flags = ["is_onehot", "is_no_reduction", "is_embedding"]
    return rows.groupBy(*flags, naming.baseline_context(*(F.col(c) for c in flags)).alias("context")).agg(F.sum("n").alias("n"))


_RED3 = ("No reduction", "Homology reduction", "Distance reduction")


@query(f"WITH {_N}, x AS (SELECT {_pick_sql('l_partkey', *_RED3)} AS red, {_pick_sql('l_partkey', 'a', None, 'b', 'c')} AS space, {_pick_sql('l_partkey', 'p30_0', 'minseqid_3', None, 'no_level', 'p90_0')} AS level, n FROM k) SELECT CASE red WHEN 'No reduction' THEN 'no_reduction' WHEN 'Homology reduction' THEN 'homology' ELSE coalesce(space, 'not_applicable') END AS space, CASE red WHEN 'No reduction' THEN 'no_reduction' ELSE coalesce(level, 'not_applicable') END AS level, CASE WHEN level LIKE 'p%' THEN level ELSE 'not_applicable' END AS percentile, CASE WHEN level LIKE 'minseqid%' THEN level ELSE 'not_applicable' END AS homology, sum(n)::BIGINT AS n FROM x GROUP BY ALL")
def clean_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces and levels of combinations, and their columns by kind."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", *_RED3).alias("red"), _pick("l_partkey", "a", None, "b", "c").alias("by"), _pick("l_partkey", "p30_0", "minseqid_3", None, "no_level", "p90_0").alias("at"), "n")
    clean = naming.clean_combo(F.col("red"), F.col("by"), F.col("at"))
    kinds = naming.level_columns(F.col("at"))
    out = rows.select(*(c.alias(n) for n, c in zip(("space", "level"), clean.values(), strict=True)), *(c.alias(n) for n, c in zip(("percentile", "homology"), kinds.values(), strict=True)), "n")
    return out.groupBy("space", "level", "percentile", "homology").agg(F.sum("n").alias("n"))


_TREES = ("s/random/seed_3/p30_0/fold_2/t.csv", "s/random/seed_3/minseqid_3/fold_10/t.csv", "t/distance/p90_5/seed_4/t.csv", "t/no_threshold/distance/seed_5/t.csv", "x.csv")


@query(f"WITH {_N} SELECT {_pick_sql('l_partkey', 's', 's', 't', 't', None)} AS scenario, {_pick_sql('l_partkey', 'random', 'random', 'distance', 'distance', None)} AS strategy, {_pick_sql('l_partkey', '3', '3', '4', '5', None)}::INTEGER AS seed, {_pick_sql('l_partkey', 'p30_0', 'minseqid_3', 'p90_5', 'no_level', 'no_level')} AS reduction_level, {_pick_sql('l_partkey', '2', '10', None, None, None)}::INTEGER AS fold, sum(n)::BIGINT AS n FROM k GROUP BY ALL")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of result files say."""
    from corvane.sources.tables import path_metadata

    rows = _numbered(spark, sf_dir).select(F.concat(F.lit("/root/"), _pick("l_partkey", *_TREES)).alias("path"), "n")
    told = path_metadata(F.col("path"))
    return rows.withColumns(told).groupBy(*told).agg(F.sum("n").alias("n"))


@query(f"WITH {_N} SELECT {_pick_sql('l_partkey', 'distance_reduction', 'homology_reduction', 'no_reduction', 'parsed', 'parsed')} AS strategy, CASE WHEN l_partkey % 2 = 0 THEN 'onehot' ELSE 'rep' END AS representation, CASE WHEN l_partkey % 2 = 1 THEN 'space' WHEN l_partkey % 3 = 0 THEN 'onehot' ELSE 'not_applicable' END AS split_space, sum(n)::BIGINT AS n FROM k GROUP BY ALL")
def table_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's own strategy before the parsed one, and experiments that were run again on one-hot."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", "By distance", "Homology 0.3", "no_reduction", "else", None).alias("own"), _pick("l_partkey", "again", "first").alias("e"), _pick("l_partkey", "Distance_aware", "random", "stratified").alias("part"), "n")
    fixed = naming.corrected_onehot(F.col("e"), F.col("part"), ["again"], F.lit("rep"), F.lit("space"))
    columns = [naming.strategy_from_table(F.col("own"), F.lit("parsed")).alias("strategy"), fixed["representation_clean"].alias("representation"), fixed["split_space_clean"].alias("split_space")]
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


_RUNS = ("onehot_no_reduced", "ankh2_ext1_reduced_distance_by_prot_bert", "prot_bert_reduced_descriptor", "esmc_300m_reduced_homology", "plain", "odd")


@query(f"WITH {_N} SELECT {_pick_sql('l_partkey', 'onehot', 'ankh2_ext1', 'prot_bert', 'esmc_300m', 'plain', 'a')} AS representation_strategy, {_pick_sql('l_partkey', 'no_reduction', 'reduced_distance_by_prot_bert', 'reduced_descriptor', 'reduced_homology', 'unknown', 'b')} AS redundancy_strategy, {_pick_sql('l_partkey', 'onehot', 'ankh2_ext1', 'prot_bert', 'esmc_300m', None, None)} AS prefix, sum(n)::BIGINT AS n FROM k GROUP BY ALL")
def scenario_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representation and strategy of training scenarios, with an override, and the longest known name they begin with."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", *_RUNS).alias("name"), "n")
    known = ["onehot", "ankh2", "ankh2_ext1", "prot_bert", "prot", "esmc_300m"]
    said = naming.scenario(F.col("name"), {"odd": ("a", "b")})
    return rows.groupBy(*(c.alias(n) for n, c in said.items()), naming.longest_prefix(F.col("name"), known).alias("prefix")).agg(F.sum("n").alias("n"))


_KINDS = ("no_reduced", "reduced_homology", "reduced_distance")


@query("""WITH l AS (SELECT DISTINCT lang AS a FROM documents), k AS (SELECT x.a AS train, y.a AS red, z.a AS split, kind FROM l x, l y, (SELECT a FROM l UNION ALL SELECT NULL) z, (VALUES ('no_reduced'), ('reduced_homology'), ('reduced_distance')) v(kind)),
n AS (SELECT *, kind = 'reduced_distance' AND red <> train AS other FROM k)
SELECT train || '_' || kind || CASE WHEN other THEN '_by_' || red ELSE '' END || coalesce('_split_by_' || split, '') AS name, train AS representation, CASE kind WHEN 'no_reduced' THEN 'no_reduction' WHEN 'reduced_homology' THEN 'homology_reduction' ELSE 'distance_reduction' END AS strategy,
coalesce(split, CASE WHEN kind = 'reduced_distance' THEN red ELSE train END) AS split_space, count(*)::BIGINT AS n FROM n GROUP BY ALL""")
def made_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the scenarios that every pair of languages makes, read back."""
    spaces = [x.lang for x in read(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]  # a corpus has few
    made = [(experiment.scenario_name(a, kind, b, c),) for a in spaces for b in spaces for c in [*spaces, None] for kind in _KINDS]
    rows = spark.createDataFrame(made, "name string")
    told = naming.experiment(F.col("name"))
    rows = rows.select("name", told["representation_clean"].alias("representation"), told["reduction_strategy_clean"].alias("strategy"), told["split_space_clean"].alias("split_space"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(f"WITH {_N}, x AS (SELECT {_pick_sql('l_partkey', 'distance_reduction', 'homology_reduction', 'no_reduction', 'unknown', None)} AS red, {_pick_sql('l_partkey', 'p30_0', 'minseqid_3', None, 'p90_0')} AS level, {_pick_sql('l_partkey', 'random', 'other', 'distance')} AS split, n FROM k) SELECT red AS reduction_strategy, level AS reduction_level, sum(n)::BIGINT AS n FROM x WHERE split IN ('random', 'distance') AND (red = 'no_reduction' OR red = 'distance_reduction' AND level IN ('p30_0', 'p90_0') OR red = 'homology_reduction' AND level = 'minseqid_3') GROUP BY ALL")
def kept_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the wanted splits and levels; "auto" wants all."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", "distance_reduction", "homology_reduction", "no_reduction", "unknown", None).alias("reduction_strategy"), _pick("l_partkey", "p30_0", "minseqid_3", None, "p90_0").alias("reduction_level"), _pick("l_partkey", "random", "other", "distance").alias("split_strategy"), "n")
    rows = keys.selected(keys.selected(rows, "split_strategy", "auto"), "split_strategy", ["random", "distance"])
    kept = experiment.kept_by_level(rows, ["random", "distance"], ["p30_0", "p90_0"], ["minseqid_3"])
    return kept.groupBy("reduction_strategy", "reduction_level").agg(F.sum("n").alias("n"))


@query(f"WITH {_N} SELECT l_partkey, row_number() OVER (ORDER BY l_partkey * 1000000000000000000000000::HUGEINT)::BIGINT AS place FROM k")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with numbers of any length, in the order of the numbers."""
    from corvane.operators.curate import numbered

    rows = _numbered(spark, sf_dir).select("l_partkey", naming.natural_key(F.concat(F.lit("level_"), F.col("l_partkey").cast("string"), F.lit("0" * 24))).alias("k"))
    return numbered(rows, ["k", "l_partkey"], "place").select("l_partkey", "place")


@query(f"WITH {_N} SELECT {_pick_sql('l_partkey', 'random', 'distance-aware', 'stratified', 'my-own', None)} AS split, {_pick_sql('l_partkey', 'single-source', 'full-consensus', 'multi-source')} AS subset, sum(n)::BIGINT AS n FROM k GROUP BY ALL")
def spelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and subsets by their spellings."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", " Random_KFold", "distance emb", "Stratified-split ", "My own", None).alias("s"), _pick("l_partkey", "Source_1", "overall", ">=2").alias("t"), "n")
    return rows.groupBy(naming.by_spelling(F.col("s"), naming.SPLIT_NAMES).alias("split"), naming.by_spelling(F.col("t"), naming.SUBSET_NAMES).alias("subset")).agg(F.sum("n").alias("n"))


_RAW = ("x ERROR:  Some classes have fewer samples than n_splits", "fold 1 has only 1 class(es)", "ids_path not found", "other  reason", None, "Unknown parameters for DistanceAwareKFoldSplitter: [z]")
_SAID = ("Invalid stratified k-fold: at least one class has fewer samples than n_splits. Some classes have fewer samples than n_splits", "Invalid split: at least one train/val/test fold contains fewer than two classes. fold 1 has only 1 class(es)", naming.NO_ARRAYS + "ids_path not found", "other reason", "", naming.UNKNOWN_SAYS.format("[z]").replace("'", "''"))


@query(f"WITH {_N} SELECT {_pick_sql('l_partkey', *_SAID)} AS reason, sum(n)::BIGINT AS n FROM k GROUP BY ALL")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed splits say, made readable."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", *_RAW).alias("raw"), "n")
    return rows.groupBy(naming.clean_reason(F.col("raw")).alias("reason")).agg(F.sum("n").alias("n"))


@query(f"WITH {_N}, x AS (SELECT l_partkey, {_pick_sql('l_partkey', 'percentile', 'min_seq_id', 'no_threshold', 'else')} AS kind FROM k) SELECT {_pick_sql('l_partkey', 'Reduction percentile', 'Homology min_seq_id', 'No reduction', 'Reduction parameter')} AS label, CASE kind WHEN 'min_seq_id' THEN 'homology' ELSE kind END AS slug, {_pick_sql('l_partkey', 'ProtBERT', 'x', 'No reduction')} AS space, {_pick_sql('l_partkey', 'SVC', 'Random Forest', 'y')} AS algorithm, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parameters, spaces and algorithms."""
    rows = _numbered(spark, sf_dir).select(_pick("l_partkey", "percentile", "min_seq_id", "no_threshold", "else").alias("kind"), _pick("l_partkey", "PROT_bert", "x", None).alias("s"), _pick("l_partkey", "SVC", "RandomForestClassifier", "y").alias("a"))
    columns = [experiment.parameter_label(F.col("kind")).alias("label"), experiment.parameter_slug(F.col("kind")).alias("slug"), report.pretty(F.col("s")).alias("space"), report.pretty_algorithm(F.col("a")).alias("algorithm")]
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_linenumber AS seed FROM lineitem), n AS (SELECT count(DISTINCT lang)::INTEGER AS n FROM documents)
SELECT folder, splitter, seed::INTEGER AS seed, CASE WHEN splitter = 'stratified_kfold' THEN n ELSE 5 END AS n_splits, standardized, metric
FROM (VALUES ('random_kfold', 'random_kfold', NULL::BOOLEAN, NULL), ('stratified_kfold', 'stratified_kfold', NULL, NULL), ('distance_aware_kfold_norm', 'distance_aware_kfold', true, 'euclidean'), ('distance_aware_kfold_no_norm', 'distance_aware_kfold', false, 'euclidean')) t(folder, splitter, standardized, metric), s, n""")
def splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the strategies, as many stratified folds as there are languages, and what their splitters are told for each seed."""
    n = read(spark, sf_dir, "documents").agg(F.count_distinct("lang")).first()[0]
    strategies = {"random_kfold": {"enabled": True}, "stratified_kfold": {"enabled": True, "n_splits": n}, "distance_aware_kfold": {"enabled": True, "descriptor_modes": ["norm", "no_norm"]}}
    rows = []
    for seed in sorted(x.l_linenumber for x in read(spark, sf_dir, "lineitem").select("l_linenumber").distinct().collect()):  # seven
        for folder in experiment.strategy_folders(strategies, "descriptors"):
            told = experiment.split_parameters(folder, seed, strategies, "label", "descriptors", "euclidean")[experiment.splitter(folder)]
            rows.append((folder, experiment.splitter(folder), told["seed"], told["n_splits"], told.get("standardize_descriptors"), told.get("metric")))
    return spark.createDataFrame(rows, "folder string, splitter string, seed int, n_splits int, standardized boolean, metric string")


@query("""WITH d AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source), k AS (SELECT source, 'a' || (first % 7)::VARCHAR AS path, CASE n % 3 WHEN 0 THEN 'onehot_descriptor' WHEN 1 THEN 'embedding_distance' ELSE 'homology' END AS kind FROM d),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY path ORDER BY source) = 1)
SELECT source AS label, kind, CASE kind WHEN 'onehot_descriptor' THEN 'euclidean' WHEN 'embedding_distance' THEN 'cosine' END AS metric, CASE kind WHEN 'onehot_descriptor' THEN 'descriptor_euclidean' WHEN 'embedding_distance' THEN 'embedding_cosine' ELSE 'homology' END AS strategy,
CASE kind WHEN 'onehot_descriptor' THEN 'onehot_reduced_descriptor' ELSE source || CASE kind WHEN 'homology' THEN '_reduced_homology' ELSE '_reduced_distance' END END AS experiment FROM f""")
def reduction_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of a reduction of each source, the first of each path, and where each comes from."""
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy("source").collect()  # a row a source
    kinds = ("onehot_descriptor", "embedding_distance", "homology")
    out = []
    for label, kind, _ in experiment.summary_specs(f"{x.source} :: {kinds[x.n % 3]}::a{x.first % 7}" for x in rows):
        method = {"key": "onehot", "method": "one_hot"} if kind == "onehot_descriptor" else {"key": label, "method": "embedding"}
        made = experiment.provenance({"name": "d"}, method, kind, {"enabled": True})
        out.append((label, kind, made["analysis"]["metric"], made["reduction"]["strategy"], made["experiment"]["name"]))
    return spark.createDataFrame(out, "label string, kind string, metric string, strategy string, experiment string")


@query("SELECT 'part_' || p_partkey::VARCHAR AS id, p_brand FROM part")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids trimmed and without nulls, under the name that reducers expect."""
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("  part_"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("key"), "p_brand")
    return geometry.canonical_ids(experiment.reducer_input(rows, "key"), "id")


@query("SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def joined_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of the same places side by side, and rows of wanted keys, all of which are there."""
    customers, nations = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = report.rows_of(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey"), "c_custkey", customers)
    return report.side_by_side(customers, regions, "c_custkey")


@query("SELECT count(*) FILTER (l_partkey % 7 = 0)::BIGINT AS seed, 0::BIGINT AS part FROM lineitem")
def path_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that say otherwise than their path; seeds are compared as numbers."""
    seed = F.when(F.col("l_partkey") % 7 == 0, F.lit("4")).when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(F.lit("3.0"))
    rows = read(spark, sf_dir, "lineitem").select(seed.alias("seed"), F.lit(3).alias("path_seed"), F.col("l_linestatus").alias("part"), F.col("l_linestatus").alias("path_part"))
    return report.disagreements(rows, {"seed": "path_seed", "part": "path_part"})


@query(f"SELECT s_nationkey AS nation, {r('avg(s_acctbal)')} AS balance, NULL::VARCHAR AS name, 'supplier' AS kind FROM supplier GROUP BY ALL UNION ALL SELECT n_nationkey, NULL, n_name, 'nation' FROM nation")
def tables_of_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with different columns, in the order in which columns come first."""
    one = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("balance")).withColumn("kind", F.lit("supplier"))
    two = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return rounded(report.union_all([one, two])).select(*report.ordered_union(one.columns, two.columns))


@query("SELECT c_mktsegment AS segment, count(*) FILTER (c_nationkey = 0)::BIGINT AS n_0, count(*) FILTER (c_nationkey = 1)::BIGINT AS n_1 FROM customer GROUP BY ALL")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of labels as columns."""
    return report.label_columns(read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), "c_nationkey", [0, 1], ["segment"])


@query("SELECT o_orderstatus, o_orderkey, place FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders) WHERE place <= 4")
def top_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of each key."""
    return report.top_of_each(read(spark, sf_dir, "orders"), ["o_orderstatus"], [F.col("o_totalprice").desc(), "o_orderkey"], 4).select("o_orderstatus", "o_orderkey", "place")


@query(f"WITH g AS (SELECT l_returnflag AS model, l_linenumber AS i, 'p' || (l_linenumber % 3 * 30 + 10)::VARCHAR AS level, count(*) FILTER (l_linestatus = 'O')::BIGINT AS n_0, count(*) FILTER (l_linestatus = 'F')::BIGINT AS n_1 FROM lineitem GROUP BY ALL), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY model, level ORDER BY i DESC) = 1), e AS (SELECT model, level FROM (SELECT DISTINCT model FROM c) CROSS JOIN (VALUES ('p10'), ('p30'), ('p70')) v(level)) SELECT model, level, i, n_0, n_1, {r('n_0 / nullif(n_0 + n_1, 0)')} AS fraction_0, {r('n_1 / nullif(n_0 + n_1, 0)')} AS fraction_1 FROM e LEFT JOIN c USING (model, level)")
def reduction_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class fractions along the levels of a curve, of the last line number that has a level, null where a model has none."""
    i = F.col("l_linenumber")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), i.alias("i")).agg(F.count_if(F.col("l_linestatus") == "O").alias("n_0"), F.count_if(F.col("l_linestatus") == "F").alias("n_1"))
    counts = counts.withColumn("level", F.concat(F.lit("p"), (F.col("i") % 3 * 30 + 10).cast("string")))
    return rounded(report.over_levels(counts, "level", ["p10", "p30", "p70", "p10"], ["model"], [F.col("i").desc()]))


@query(f"WITH v AS (SELECT n_chars::DOUBLE AS x, lang FROM documents WHERE n_chars BETWEEN 1 AND 5000), f AS (SELECT lang, stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM v GROUP BY lang), b AS (SELECT lang, n, h, floor(x / (h / 4)) AS b, count(*) AS c, avg(x) AS m FROM v JOIN f USING (lang) GROUP BY ALL), g AS (SELECT i * 500::DOUBLE AS x FROM range(11) t(i)) SELECT lang, x, {r('sum(c * exp(-0.5::DOUBLE * pow((x - m) / h, 2)) / (n * h * sqrt(2 * pi())))', 8)} AS density FROM b JOIN g ON abs(x - m) <= 8 * h GROUP BY lang, x")
def length_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kernel estimates of lengths in each language."""
    rows = read(spark, sf_dir, "documents").where("n_chars between 1 and 5000")
    return rounded(report.projected_density(rows, "n_chars", 0, 5000, 11, ["lang"]), 8)
