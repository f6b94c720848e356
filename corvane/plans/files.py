"""Queries that write and read files: tables, sequences, documents and folders of experiments, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import vectors
from corvane.operators import experiment, geometry
from corvane.plans.registry import registry
from corvane.plans.tables import r, read, rounded
from corvane.session import shared_folder
from corvane.sources import parsers, sequences, sinks, tables

QUERIES, ORACLES, query = registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as CSV, read back by its ending, two columns of it."""
    path = f"{_folder(spark, 'csv')}/nation.csv"
    sinks.write_csv(read(spark, sf_dir, "nation"), path)
    return tables.read_table(spark, path, ["n_nationkey", "n_name"], "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT r_regionkey, r_name, true AS right_types FROM region")
def tsv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated table whose types are read from it."""
    path = f"{_folder(spark, 'tsv')}/region.tsv"
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # five rows
    sinks.write_text(spark, "key\tname\n" + "".join(f"{x.r_regionkey}\t{x.r_name}\n" for x in rows), path)
    df = tables.read_table(spark, path)
    return df.select(F.col("key").alias("r_regionkey"), F.col("name").alias("r_name"), F.lit(dict(df.dtypes)["key"] == "int").alias("right_types"))


@query(f"SELECT vec_id, len(embedding)::INTEGER AS width, {r('list_sum([abs(x) FOR x IN embedding::DOUBLE[]])', 5)} AS total, {r('embedding[11]::DOUBLE', 5)} AS eleventh FROM embeddings")
def wide_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as wide columns in Parquet, packed again by the numbers of their columns."""
    path = f"{_folder(spark, 'wide')}/features.parquet"
    wide = tables.wide_features(read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features")))
    sinks.write_parquet(wide.select(*sorted(wide.columns)), path)
    rows = tables.packed_features(tables.read_table(spark, path), "p_", ["vec_id", "absent"])
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + F.abs(x))
    return rounded(rows.select("vec_id", F.size("features").alias("width"), total.alias("total"), F.get("features", F.lit(10)).alias("eleventh")), 5)


_SEQ = "upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g'))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("s"))


@query(f"SELECT 'part' || p_partkey::VARCHAR AS id, {_SEQ} AS sequence, 'a part GN=' || replace(p_brand, '#', 'x') || ' end' AS description FROM part")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of FASTA files, sequences over several lines."""
    path = _folder(spark, "fasta")
    lines = F.concat(F.lit(">part"), F.col("p_partkey").cast("string"), F.lit(" a part GN="), F.replace(F.col("p_brand"), F.lit("#"), F.lit("x")), F.lit(" end\n"), F.substring("s", 1, 3), F.lit("\r\n"), F.expr("substring(s, 4)"))
    _parts(spark, sf_dir).select(lines.alias("value")).write.text(path)
    return sequences.read_fasta(spark, path, description=True)


@query(f"SELECT gene, arg_max(sequence, p_partkey) AS sequence FROM (SELECT replace(p_brand, '#', 'x') AS gene, {_SEQ} AS sequence, p_partkey FROM part) GROUP BY gene")
def gene_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sequence of each gene that descriptions name."""
    rows = _parts(spark, sf_dir).select(F.concat(F.lit("protein GN="), F.replace(F.col("p_brand"), F.lit("#"), F.lit("x")), F.lit(" PE=1")).alias("description"), F.col("s").alias("sequence"), "p_partkey")
    return sequences.gene_sequences(rows, "p_partkey")


@query(f"SELECT 'part ' || p_partkey::VARCHAR AS id, {_SEQ} AS sequence FROM part")
def quoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose records are quoted."""
    path = _folder(spark, "quoted")
    rows = _parts(spark, sf_dir).select(F.concat(F.lit('">part '), F.col("p_partkey").cast("string"), F.lit('"\n"'), F.substring("s", 1, 4), F.lit("\n"), F.expr("substring(s, 5)"), F.lit('"')).alias("value"))
    rows.write.text(path)
    return sequences.read_quoted_fasta(spark, path).select("id", "sequence")


@query("SELECT o_custkey AS file, '>' || min(o_orderkey)::VARCHAR AS first, count(*)::BIGINT AS n, sum(3)::BIGINT AS letters FROM orders GROUP BY ALL")
def printed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of capital letters belong to the header above them, other lines to none."""
    lines = read(spark, sf_dir, "orders").select("o_custkey", F.explode(F.array(*(F.struct((F.col("o_orderkey") * 4 + i).alias("n"), t.alias("t")) for i, t in enumerate((F.concat(F.lit(">>"), F.col("o_orderkey").cast("string")), F.lit("AC"), F.lit("page 1"), F.lit("D")))))).alias("l"))
    rows = sequences.running_headers(lines.select("o_custkey", "l.n", "l.t"), "o_custkey", "n", "t")
    return rows.groupBy(F.col("o_custkey").alias("file")).agg(F.min_by("id", F.expr("bigint(substring(id, 2))")).alias("first"), F.count("*").alias("n"), F.sum(F.length("sequence")).alias("letters"))


@query("SELECT s_suppkey AS file, 'non' || s_nationkey::VARCHAR AS id, 'SEQ' AS sequence, 0 AS label FROM supplier")
def alternating_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets whose rows are headers and sequences in turn, and a label told by a header."""
    suppliers = read(spark, sf_dir, "supplier")
    lines = suppliers.select("s_suppkey", F.lit(0).alias("n"), F.concat(F.lit("non"), F.col("s_nationkey").cast("string")).alias("t")).unionByName(suppliers.select("s_suppkey", F.lit(1).alias("n"), F.lit("SEQ").alias("t")))
    rows = sequences.alternating(lines, "s_suppkey", "n", "t")
    return rows.select(F.col("s_suppkey").alias("file"), "id", "sequence", parsers.unless("id", "non")(rows).alias("label"))


@query("SELECT n_nationkey % 2 AS label, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) || repeat('A', n_nationkey::INTEGER) AS sequence FROM nation")
def source_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of two files, positive and negative, parsed by its name and judged."""
    folder = _folder(spark, "source")
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for label, name in ((1, "anti.txt"), (0, "nonanti.txt")):
        own = [x for x in rows if x.n_nationkey % 2 == label]
        text = "".join(f">n{x.n_nationkey}\n{''.join(c for c in x.n_name.upper() if 'A' <= c <= 'Z')}\n{'A' * x.n_nationkey}\n" for x in [*own, *own[:2]])
        sinks.write_text(spark, text, f"{folder}/{name}")
    right, _, _ = parsers.parsed(spark, folder, "Zhai et al")
    return right.select("label", "sequence")


@query("SELECT count(*)::BIGINT AS number_of_records, count(DISTINCT n_regionkey)::BIGINT AS number_of_unique_sequences, count(DISTINCT n_regionkey) FILTER (n_regionkey % 2 = 1)::BIGINT AS positive_examples, count(DISTINCT n_regionkey) FILTER (n_regionkey % 2 = 0)::BIGINT AS negative_examples, 0::BIGINT AS number_of_sequences_with_errors FROM nation")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes into a source's metadata."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("sequence"), (F.col("n_regionkey") % 2).cast("int").alias("label"))
    return parsers.judged(rows)[2]


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 40 AS e, l_linenumber AS i FROM lineitem), o AS (SELECT CASE WHEN e IN (3, 7) THEN 'inside_experiment_blocklist' WHEN i = 6 THEN 'unparsed_filename' WHEN i = 2 THEN 'scaler_excluded' WHEN e % 2 = 0 THEN 'missing_done_marker' ELSE 'accepted' END AS outcome FROM f WHERE i <> 7)
SELECT outcome, count(*)::BIGINT AS n FROM o GROUP BY ALL UNION ALL SELECT 'discovered', count(*) FROM o""")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files that lines name, below a folder, and why some are left out; hidden ones aren't seen."""
    root, e, i = _folder(spark, "runs"), F.col("l_suppkey") % 40, F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(e.alias("e"), i.alias("i")).distinct()
    file = F.when(F.col("i") == 6, "bad.csv").otherwise(F.concat(F.lit("SVC"), F.col("i").cast("string"), F.lit("_scaler_"), F.when(F.col("i") == 2, "l2").otherwise("none"), F.lit(".csv")))
    folder = F.concat(F.when(F.col("i") == 7, ".hidden/e").otherwise("e"), F.col("e").cast("string"))
    sinks.write_named(rows.select(F.concat(folder, F.lit("/p30_0/exploration_by_fold_"), file).alias("file"), "i"), root, "file")
    marked = rows.where("e % 2 = 1").select(F.concat(F.lit("e"), F.col("e").cast("string"), F.lit("/p30_0/training_done_scaler_none.txt")).alias("file"), F.lit(1).alias("done")).distinct()
    sinks.write_named(marked, f"{root}/markers", "file")
    markers = experiment.done_markers(spark, f"{root}/markers").withColumn("path", F.replace("path", F.lit("/markers/"), F.lit("/")))
    files = tables.found_files(spark, root, "exploration_by_fold_*.csv")
    return experiment.accepted_files(files, root.removeprefix("file://"), block=["e3", "e7"], exclude=["l2"], markers=markers)[1]


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = f THEN 'test' WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS part, f::INTEGER AS fold, 7 AS seed, lang AS scenario, 'random_kfold' AS strategy FROM documents CROSS JOIN range(3) r(f)")
def fold_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to files of folds, a folder a language, and read back as one table."""
    root, fold = _folder(spark, "folds"), F.col("fold")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold"))
    part = F.when(F.col("doc_id") % 3 == fold, "test").when(F.col("doc_id") % 10 == 0, "val").otherwise("train")
    file = F.concat("lang", F.lit("/random_kfold/seed_7/fold_"), fold.cast("string"), F.lit("/"), part, F.lit(".csv"))
    sinks.write_named(rows.select(F.col("doc_id").cast("string").alias("id"), file.alias("file")), root, "file")
    return tables.read_folds(spark, root, "id string").select("id", "part", "fold", "seed", "scenario", "strategy")


@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY source))::INTEGER AS seed, n FROM s)
SELECT lang AS scenario, seed, CASE n % 3 WHEN 0 THEN '' ELSE 'p' || (n % 90)::VARCHAR || '_0' END AS threshold, CASE n % 3 WHEN 0 THEN 'invalid_split' WHEN 1 THEN 'kept' ELSE 'unknown' END AS status, CASE WHEN n % 3 = 2 THEN 'bad' ELSE '' END AS reason, (n % 3 = 1)::INTEGER AS is_kept, (n % 3 <> 1)::INTEGER AS is_invalid,
CASE n % 3 WHEN 0 THEN 'none' ELSE 'percentile' END AS parameter_type, CASE WHEN n % 3 <> 0 THEN (n % 90)::DOUBLE END AS parameter_value FROM t""")
def seed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a seed for each source below a folder a language; what analyses left there is passed over."""
    from pyspark.sql import Window

    root, n = _folder(spark, "status"), F.col("n")
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    rows = rows.withColumn("seed", F.row_number().over(Window.partitionBy("lang").orderBy("source")))  # few sources
    level = F.when(n % 3 == 0, "no_threshold").otherwise(F.concat(F.lit("p"), (n % 90).cast("string"), F.lit("_0")))
    said = rows.select(level.alias("reduction_levels"), F.when(n % 3 == 0, "invalid_split").when(n % 3 == 1, "kept").alias("status"), F.when(n % 3 == 2, "log ERROR: bad").alias("reason"), F.explode(F.array(F.lit("random"), F.lit("split_analysis"))).alias("strategy"), "lang", "seed")
    file = F.concat("lang", F.lit("/"), "strategy", F.lit("/seed_"), F.col("seed").cast("string"), F.lit("/split_summary.csv"))
    sinks.write_named(said.select("reduction_levels", "status", "reason", file.alias("file")), root, "file")
    return tables.read_seed_summaries(spark, root).drop("reduction_levels", "source_path", "strategy")


@query("SELECT n_name AS id, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE lower(n_name) END AS content, CASE WHEN n_nationkey % 3 = 0 THEN 'OSError: ' || n_name END AS error FROM nation")
def fetched_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source answers for each key, and why it fails where it does."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 3 == 0).alias("down"))
    rows = rows.select("id", F.when(F.col("down"), F.concat(F.lit("!"), F.col("id"))).otherwise(F.col("id")).alias("asked"))

    def fetch(key: str) -> str:
        if key.startswith("!"):
            raise OSError(key[1:])
        return key.lower()

    return tables.fetched(rows, "asked", fetch).drop("asked")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, NULL FROM region")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: rows appended to a table in its own columns."""
    path = f"{_folder(spark, 'append')}/t"
    sinks.write_parquet(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    more = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit("x").alias("other"))
    sinks.append_aligned(more, path)
    return spark.read.parquet(path)


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY ALL")
def small_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: a small result as a document, and parameters beside it, read back."""
    folder = _folder(spark, "documents")
    counts = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    sinks.write_json(spark, {"rows": sinks.summary_document(counts)}, f"{folder}/counts.json")
    sinks.write_parameters(spark, {"n_splits": 5}, f"{folder}/parameters.yaml")
    rows = spark.read.schema("rows array<struct<n_regionkey: int, n: long>>").option("multiLine", "true").json(f"{folder}/counts.json")
    there = spark.read.text(f"{folder}/parameters.yaml").where(F.col("value").contains("n_splits")).limit(1)
    return rows.select(F.explode("rows").alias("x")).select("x.*").join(there.select(F.lit(True).alias("ok")), F.lit(True), "left_semi")


@query("WITH s AS (SELECT s_suppkey, s_nationkey AS scenario, s_suppkey % 2 AS seed, CASE WHEN s_nationkey % 5 = 0 THEN 'again' ELSE 'first' END AS written FROM supplier), k AS (SELECT *, min((CASE written WHEN 'again' THEN s_suppkey % 7 <> 3 ELSE s_suppkey % 4 <> 3 END)::INT) OVER (PARTITION BY scenario, seed) AS ok FROM s) SELECT s_suppkey, scenario, seed, written FROM k WHERE ok = 1")
def written_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments written without those of invalid splits; a fifth of the scenarios is then replaced, and the others stay."""
    path = _folder(spark, "splits")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scenario"), (F.col("s_suppkey") % 2).alias("seed"))
    for written, some, wrong in (("first", rows, F.col("s_suppkey") % 4 == 3), ("again", rows.where("scenario % 5 = 0"), F.col("s_suppkey") % 7 == 3)):
        status = some.select("scenario", "seed", F.when(wrong, "invalid_split").otherwise("kept").alias("status"))
        sinks.write_splits(some.withColumn("written", F.lit(written)), status, path, ["scenario", "seed"])
    out = sinks.read_splits(spark, path, ["scenario", "seed"])
    kinds = dict(rows.dtypes)
    return out.select("s_suppkey", F.col("scenario").cast(kinds["scenario"]).alias("scenario"), F.col("seed").cast(kinds["seed"]).alias("seed"), "written")


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT 'v' || vec_id::VARCHAR AS id, {r('v[2] / sqrt(list_dot_product(v, v))', 5)} AS second, {r('v[2]', 5)} AS raw FROM e")
def configured_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces by configuration, checked; unit vectors for cosine, vectors as they are for distances."""
    rows = tables.wide_features(read(spark, sf_dir, "embeddings").select(F.concat(F.lit(" v"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("features")))
    spaces = geometry.embedding_spaces(spark, {"unit": {"path": "x", "prefix": "p_"}, "raw": {"path": "x", "prefix": "p_", "metric": "euclidean"}}, lambda _, path: rows)
    one, two = (spaces[k].select("id", F.get("features", F.lit(1)).alias(n)) for k, n in (("unit", "second"), ("raw", "raw")))
    return rounded(one.join(two, "id"), 5)


@query("SELECT vec_id, 64 AS n FROM embeddings")
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: vectors written and read as a table of arrays."""
    path = f"{_folder(spark, 'vectors')}/v"
    sinks.write_parquet(read(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v")), path)
    return spark.read.parquet(path).select("vec_id", F.size("v").alias("n"))
