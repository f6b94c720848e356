"""Queries over source tables: repeats, consensus, quality control, support, labels, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import naming, stats, vectors
from corvane.operators import curate, reduce
from corvane.plans.registry import registry
from corvane.plans.tables import r, read, rounded

QUERIES, ORACLES, query = registry()
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled sequences: the customer is the sequence, the priority the source, finished is label 1."""
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.col("o_custkey").alias("sequence"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


_S = "s AS (SELECT o_orderkey, o_custkey AS sequence, o_orderpriority AS source, (o_orderstatus = 'F')::INT AS label FROM orders)"
_KEYS = "g AS (SELECT o_custkey AS sequence, count(*)::BIGINT AS n, count(DISTINCT o_orderstatus) AS k, list_sort(list(DISTINCT o_orderstatus)) AS labels, max(o_orderstatus) AS label FROM orders GROUP BY ALL)"


def _repeats(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sequence"), F.col("o_orderstatus").alias("label"))
    return curate.duplicates(rows, "sequence", "label")


@query(f"WITH {_KEYS} SELECT sequence, label, n AS n_duplicates FROM g WHERE n > 1 AND k = 1")
def duplicate_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return _repeats(spark, sf_dir)["consistent"]


@query(f"WITH {_KEYS} SELECT sequence, array_to_string(labels, ';') AS labels, n AS n_duplicates FROM g WHERE n > 1 AND k > 1")
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J12."""
    return _repeats(spark, sf_dir)["conflicts"].withColumn("labels", F.array_join("labels", ";"))


@query(f"WITH {_KEYS} SELECT sequence, label FROM g WHERE n = 1")
def duplicate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return _repeats(spark, sf_dir)["unique"]


@query("SELECT text, count(*)::BIGINT AS n_duplicates, array_to_string(list_sort(list(DISTINCT source)), ';') AS labels FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over texts, P37: the sources of each repeated text, joined."""
    rows = curate.repeated_texts(read(spark, sf_dir, "documents"), "text", "source")
    return rows.select("text", "n_duplicates", F.array_join("labels", ";").alias("labels"))


@query(f"WITH {_S} SELECT sequence, " + ", ".join(f"coalesce(arg_min(label, o_orderkey) FILTER (source = '{p}'), 999)::INTEGER AS \"{p}\"" for p in PRIORITIES) + " FROM s GROUP BY sequence")
def pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: each source's first label, 999 where it has none."""
    return curate.source_pivot(_sources(spark, sf_dir), "sequence", "source", "label", "o_orderkey", PRIORITIES)


_VOTES = f"{_S}, f AS (SELECT sequence, source, arg_min(label, o_orderkey) AS vote FROM s GROUP BY ALL), v AS (SELECT sequence, count(*) FILTER (vote = 0)::BIGINT AS count_0, count(*) FILTER (vote = 1)::BIGINT AS count_1, count(*)::BIGINT AS n_valid_sources FROM f GROUP BY ALL), c AS (SELECT *, CASE WHEN count_1 = n_valid_sources THEN 1 WHEN count_0 = n_valid_sources THEN 0 END::INTEGER AS label FROM v)"


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.consensus(curate.votes(_sources(spark, sf_dir), "sequence", "source", "label", "o_orderkey"))


@query(f"WITH {_VOTES} SELECT sequence, count_0, count_1, n_valid_sources, {r('count_0 / n_valid_sources')} AS count_0_norm, {r('count_1 / n_valid_sources')} AS count_1_norm, label FROM c WHERE label IS NOT NULL")
def label_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: sequences all of whose sources agree."""
    return rounded(_consensus(spark, sf_dir).where("label is not null"))


@query(f"WITH {_VOTES} SELECT sequence, count_0, count_1, n_valid_sources FROM c WHERE label IS NULL")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return _consensus(spark, sf_dir).where("label is null").select("sequence", "count_0", "count_1", "n_valid_sources")


@query(f"WITH {_VOTES} SELECT count(*)::BIGINT AS n_total, count(*) FILTER (label = 1)::BIGINT AS n_positive, count(*) FILTER (label = 0)::BIGINT AS n_negative, count(*) FILTER (label IS NULL)::BIGINT AS n_conflict, min(length(sequence::VARCHAR))::INTEGER AS min_length, max(length(sequence::VARCHAR))::INTEGER AS max_length FROM c")
def consensus_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return curate.dataset_metadata(_consensus(spark, sf_dir).withColumn("sequence", F.col("sequence").cast("string")), "sequence", "label")


_PLAIN = r"^[A-Za-z ,.\n]*$"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.quality_control(read(spark, sf_dir, "documents"), "text", F.col("text").rlike(_PLAIN))


@query("SELECT doc_id, length(text)::INTEGER AS length FROM documents WHERE length(text) BETWEEN 70 AND 1024 AND regexp_full_match(text, '[A-Za-z ,.\\n]*')")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain characters only and a length within limits."""
    return _checked(spark, sf_dir).where("passes").select("doc_id", "length")


@query("SELECT c_custkey, length(c_mktsegment)::INTEGER AS length, regexp_full_match(c_mktsegment, '[ACDEFGHIKLMNPQRSTVWY]*') AS is_canon, regexp_full_match(c_mktsegment, '[ACDEFGHIKLMNPQRSTVWYBZX]*') AS is_extended, length(c_mktsegment) BETWEEN 9 AND 1024 AS is_in_length FROM customer")
def residue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital letters held against both alphabets of residues, and lengths within limits."""
    rows = curate.quality_control(read(spark, sf_dir, "customer"), "c_mktsegment", least=9)
    return rows.select("c_custkey", "length", "is_canon", naming.canonical(F.col("c_mktsegment"), extended=True).alias("is_extended"), "is_in_length")


@query("SELECT p_partkey, (round((length(p_type) - length(replace(p_type, 'A', ''))) * 1.8::DOUBLE, 6) + 0::DOUBLE) AS hydropathy_a, (round(abs(list_sum([CASE WHEN c = 'D' THEN -1 WHEN c = 'E' THEN -1 WHEN c = 'K' THEN 1 WHEN c = 'R' THEN 1 WHEN c = 'H' THEN 0.1::DOUBLE ELSE 0 END FOR c IN string_split(p_type, '')])), 6) + 0::DOUBLE) AS charge FROM part")
def property_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: physicochemical values of letters, and the constant part of their Fourier transform, which is their sum."""
    rows, kind = read(spark, sf_dir, "part"), F.col("p_type")
    only = F.aggregate(vectors.property_of(kind, 40, [v if c == "A" else 0.0 for c, v in zip(naming.RESIDUES, vectors.HYDROPATHY, strict=True)]), F.lit(0.0), lambda s, x: s + x)
    charge = F.slice(vectors.physicochemical(kind, 40), 81, 40)
    return rounded(rows.select("p_partkey", only.alias("hydropathy_a"), F.get(vectors.fourier(charge, 40), F.lit(0)).alias("charge")))


@query("SELECT regexp_full_match(text, '[A-Za-z ,.\\n]*') AS is_canon, length(text) BETWEEN 70 AND 1024 AS is_in_length, count(*)::BIGINT AS n, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length FROM documents GROUP BY ALL")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return _checked(spark, sf_dir).groupBy("is_canon", "is_in_length").agg(F.count("*").alias("n"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))


@query("SELECT doc_id, 'seq_' || row_number() OVER (ORDER BY doc_id)::VARCHAR AS id FROM documents")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return curate.sequential_ids(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def _supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.groupBy("text").agg(F.count_distinct("source").alias("n_sources"), F.min("doc_id").alias("doc_id"), (F.min("lang") == "en").cast("int").alias("label"))


_SUP = "u AS (SELECT text, count(DISTINCT source) AS n_sources, min(doc_id) AS doc_id, (min(lang) = 'en')::INT AS label FROM documents GROUP BY ALL)"
_GROUP = "CASE WHEN n_sources >= 6 THEN '>=6 sources' WHEN n_sources = 1 THEN '1 source' ELSE n_sources::VARCHAR || ' sources' END"


@query(f"WITH {_SUP} SELECT tag, count(*)::BIGINT AS n, min(doc_id) AS first FROM (SELECT doc_id, unnest(list_filter(['all', CASE WHEN n_sources = 1 THEN 'single' END, CASE WHEN n_sources >= 2 THEN 'multi' END, CASE WHEN n_sources >= 3 THEN 'high' END], lambda x: x IS NOT NULL)) AS tag FROM u) GROUP BY ALL")
def support_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return curate.support_subsets(_supported(spark, sf_dir), "n_sources").groupBy("tag").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"WITH {_SUP}, o AS (SELECT * FROM (VALUES (0, '1 source'), (1, '2 sources'), (2, '3 sources'), (3, '4 sources'), (4, '5 sources'), (5, '>=6 sources')) o(position, support_group)), c AS (SELECT {_GROUP} AS support_group, count(*) AS n FROM u GROUP BY ALL) SELECT position, support_group, coalesce(n, 0)::BIGINT AS n FROM o LEFT JOIN c USING (support_group)")
def support_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P7, A6."""
    return curate.support_counts(_supported(spark, sf_dir), "n_sources")


@query(f"WITH {_SUP}, a AS (SELECT count(*)::BIGINT AS n_total, count(*) FILTER (n_sources = 1)::BIGINT AS n_single, count(*) FILTER (n_sources >= 2)::BIGINT AS n_multi, count(*) FILTER (n_sources >= 3)::BIGINT AS n_high FROM u) SELECT *, {r('n_single * 100 / n_total')} AS pct_single, {r('n_multi * 100 / n_total')} AS pct_multi, {r('n_high * 100 / n_total')} AS pct_high FROM a")
def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return rounded(curate.support_summary(_supported(spark, sf_dir), "n_sources"))


@query(f"WITH {_SUP}, a AS (SELECT {_GROUP} AS support_group, count(*) FILTER (label = 1)::BIGINT AS n_1, count(*) FILTER (label = 0)::BIGINT AS n_0 FROM u GROUP BY ALL) SELECT *, {r('n_1 * 100 / (n_0 + n_1)')} AS pct_1, {r('n_0 * 100 / (n_0 + n_1)')} AS pct_0 FROM a")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, P32."""
    from corvane.functions.naming import support_group

    return rounded(curate.class_balance(_supported(spark, sf_dir), support_group(F.col("n_sources")).alias("support_group"), "label"))


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a table that has lost them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return curate.recovered_labels(rows, read(spark, sf_dir, "labels"), "quality", ["doc_id", "text"])[0]


@query(f"WITH t AS (SELECT text, arg_min_null(lang, doc_id) AS lang FROM documents WHERE text IS NOT NULL GROUP BY ALL), j AS (SELECT b.item_id, t.lang FROM benchmark b LEFT JOIN t USING (text) UNION ALL SELECT 1000000 + d.doc_id, t.lang FROM documents d LEFT JOIN t USING (text)) SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (lang IS NULL)::BIGINT AS n_missing FROM j")
def label_recovery_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels recovered by sequence, where ids are others, and how many rows stay without."""
    documents = read(spark, sf_dir, "documents")
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text").unionByName(documents.select((F.col("doc_id") + 1000000).alias("item_id"), "text"))
    return curate.recovered_labels(rows, documents.select("doc_id", "text", "lang"), "lang", ["doc_id", "text"], ["doc_id", "lang"])[1]


@query("SELECT c_custkey, c_mktsegment, coalesce(c_mktsegment, s) AS first_seen, n FROM (SELECT o_custkey, min(o_orderpriority) AS s, count(*)::BIGINT AS n FROM orders GROUP BY ALL) JOIN customer ON c_custkey = o_custkey".replace("coalesce(c_mktsegment, s) AS first_seen", "c_nationkey"))
def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows with features; where both have a column, the source's counts."""
    features = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"), F.count("*").alias("n"))
    source = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return curate.materialized(source, features, "c_custkey", ["c_nationkey"])


@query(f"SELECT count(*)::BIGINT AS n_total, count(n_nationkey)::BIGINT AS n_mapped, {r('count(n_nationkey) * 100 / count(*)')} AS pct_mapped FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up without regard to case and blanks."""
    names = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit(" "), F.upper(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("name"), "n_nationkey")
    rows = read(spark, sf_dir, "supplier").withColumn("who", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(" ")))
    return rounded(curate.mapping_report(curate.mapped_by_name(rows, names, "who", "name", "n_nationkey", "found", "n_nationkey"), "found"))


@query(f"WITH b AS (SELECT quality, count(*) AS n FROM labels GROUP BY ALL), a AS (SELECT quality, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY ALL) SELECT coalesce(b.quality, a.quality) AS quality, coalesce(b.n, 0)::BIGINT AS n_before, coalesce(a.n, 0)::BIGINT AS n_after, {r('coalesce(a.n, 0) * 100 / b.n')} AS retained_pct FROM b FULL JOIN a ON a.quality IS NOT DISTINCT FROM b.quality")
def label_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before and after a filter."""
    rows = read(spark, sf_dir, "labels")
    return rounded(reduce.label_retention(rows, rows.where("toxic = 0"), "quality"))


@query("SELECT p_partkey, list_sum([CASE WHEN x = 'B' THEN 1 ELSE 0 END FOR x IN string_split(p_brand, '')])::DOUBLE AS ones_b, array_to_string([substr(p_brand, i, 3) FOR i IN range(1, length(p_brand) - 1)], ',') AS mers, (length(p_brand) - length(replace(p_brand, 'r', '')))::DOUBLE AS r_count FROM part")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: one-hot, k-mers and letter frequencies of part brands."""
    rows = read(spark, sf_dir, "part")
    brand = F.col("p_brand")
    ones = F.aggregate(vectors.one_hot(brand, 12, "B"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("p_partkey", ones.alias("ones_b"), F.array_join(vectors.k_mers(brand, 3), ",").alias("mers"), F.round(F.get(vectors.frequencies(brand, "r"), F.lit(0)) * F.length(brand), 6).alias("r_count"))


@query(f"WITH k AS (SELECT DISTINCT p_type AS t, list_distinct([substr(p_type, i, 3) FOR i IN range(1, length(p_type) - 1)]) AS m FROM part) SELECT a.t AS first, b.t AS second, {r('len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m)))')} AS jaccard FROM k a JOIN k b ON a.t < b.t")
def kmer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3's stand-in: Jaccard similarity of 3-mer sets of the distinct part types."""
    kinds = read(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("t"), vectors.k_mers(F.col("p_type"), 3).alias("m"))
    n = 4  # groups of types, each pair of which meets by an equal join
    number = F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")
    one = kinds.select(F.col("t").alias("x"), F.col("m").alias("a"), number.alias("i")).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n - 1))))
    two = kinds.select(F.col("t").alias("y"), F.col("m").alias("b"), number.alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    both = one.join(two, ["i", "j"]).where("i < j or x < y")
    return rounded(both.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"), vectors.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query(f"SELECT count(*)::BIGINT AS n, {r('avg(n_chars)')} AS mean, {r('stddev_samp(n_chars)')} AS std, {r('min(n_chars)')} AS minimum, {r('quantile_cont(n_chars::DOUBLE, 0.25::DOUBLE)')} AS p25, {r('quantile_cont(n_chars::DOUBLE, 0.5::DOUBLE)')} AS p50, {r('quantile_cont(n_chars::DOUBLE, 0.75::DOUBLE)')} AS p75, {r('max(n_chars)')} AS maximum FROM documents")
def describe_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return rounded(read(spark, sf_dir, "documents").agg(*(c.alias(n) for n, c in stats.describe(F.col("n_chars").cast("double")).items())))
