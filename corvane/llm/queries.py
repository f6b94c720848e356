"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import ann, chat_format, mixing, oracles, pii, quality_gam, token_alignment, token_rollup, url_templates
from corvane.llm.collocations import collocations
from corvane.llm.decontamination import contamination
from corvane.llm.lattice_dedup import near_duplicates
from corvane.llm.ngram_jaccard import jaccard_components
from corvane.llm.substring_dedup import remove_repeats
from corvane.llm.workspace import Workspace


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller doc_id has too are removed: doc_id, n_words, n_removed, kept_sha256."""
    rows = remove_repeats(_read(spark, sf_dir, "documents"), window=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _rolled_up(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """Totals of a rollup that takes estimates of all documents, revises them to the counts, deletes the documents that labels call
    toxic, is compacted, and is offered every batch again, to no effect."""
    space, rollup = Workspace(spark, "counts"), token_rollup.TokenRollup(spark)
    counts = space.keep(counts, "documents")  # what each document counts for, to take it back by
    estimates = counts.withColumn("n_tokens", F.lit(1).cast("long"))
    toxic = _read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    batches = {
        "estimates": token_rollup.inserts(estimates),
        "counts": token_rollup.revisions(estimates, counts),
        "toxic": token_rollup.deletes(counts.join(toxic, "doc_id", "left_semi")),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.apply(name, changes)
        rollup.compact()
    space.close()
    return rollup.totals()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic and their tokens, by source, language and tokenizer version, kept up by inserts, revisions and deletes."""
    return _rolled_up(spark, sf_dir, token_rollup.counted(_read(spark, sf_dir, "documents")))


def word_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 for words between blanks only, which SQL can count."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    counts = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit("words-1").alias("version"), words.alias("n_tokens"))
    return _rolled_up(spark, sf_dir, counts).drop("version")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.end - h.start)")
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows, by cosine, of every vector whose id is divisible by 50: query_id, rank, vec_id, score."""
    rows = _read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings in the instruction format, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    return chat_format.digests(chat_format.formatted(rows))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: doc_id, n_shingles, component_id."""
    return jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion probability, weight and selection of every document, raked to flattened marginals of source, language and topic."""
    rows = mixing.mixed(_read(spark, sf_dir, "documents"))
    none = [F.coalesce(f"mix.{d}", F.lit("(none)")).alias(d) for d in ("source", "lang", "topic")]
    return rows.select("doc_id", *none, F.col("mix.tokens").alias("n_tokens"), "mix.probability", "mix.weight", "mix.selected")


URL_RULES = oracles.URL_RULES


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that fits each page's url and its verdict, or that of its path template: page_id, host, path, rule, verdict."""
    return url_templates.judged_pages(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model of the labels that aren't held out: doc_id, held_out, score, predicted."""
    documents = _read(spark, sf_dir, "documents")
    rows = quality_gam.scores(documents, quality_gam.train(documents, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", quality_gam.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and base_sha256 are of the base spans, spans has the disguised ones too."""
    return pii.find(_read(spark, sf_dir, "documents"), mask=False).drop("masked")


#: Files of public vocabularies, on every machine.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op11_token_alignment(spark: SparkSession, sf_dir: str, byte_bpe: str = BYTE_BPE, pieces: str = PIECE_BPE) -> DataFrame:
    """Token groups and links of every document in two tokenizers: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return token_alignment.Alignment(_read(spark, sf_dir, "documents"), byte_bpe, pieces).documents()


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors, by cosine of at least 0.95: vec_id, n_links, component_id, kept."""
    return near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.95)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score."""
    return collocations(_read(spark, sf_dir, "documents"), least=30, top=2000, percent=80)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "word_counts_rollup": word_counts_rollup,
    "op3_decontamination": op3_decontamination,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_mixing": op7_mixing,
    "op8_url_filters": op8_url_filters,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "word_counts_rollup": oracles.WORDS,
    "op3_decontamination": oracles.OP3,
    "op5_chat_format": oracles.OP5,
    "op6_ngram_jaccard": oracles.OP6,
    "op7_mixing": oracles.OP7,
    "op8_url_filters": oracles.OP8,
    "op12_embedding_dedup": oracles.OP12,
    "op13_collocations": oracles.OP13,
}
