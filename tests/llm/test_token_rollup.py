from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, token_rollup as T
from tests.llm.conftest import table, words

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")


def changes(spark, rows):
    return spark.createDataFrame(rows, "sign int, source string, lang string, version string, n_tokens long, doc_id string")


def as_dict(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    rollup = T.TokenRollup(spark, f"file://{tmp_path}/a")
    assert as_dict(rollup) == {}
    assert rollup.apply("b1", changes(spark, [(1, "s", "en", "v1", 10, "1"), (1, "s", "en", "v1", 5, "2"), (1, None, "de", "v1", 7, "3"), (1, "gone", "en", "v1", 3, "4")]))
    assert not rollup.apply("b1", changes(spark, [(1, "s", "en", "v1", 1000, "1")]))
    assert rollup.apply("b2", changes(spark, [(-1, "s", "en", "v1", 10, "1"), (1, "s", "en", "v2", 12, "1"), (-1, "gone", "en", "v1", 3, "4")]))
    expected = {("s", "en", "v1"): (1, 5), ("s", "en", "v2"): (1, 12), (None, "de", "v1"): (1, 7)}
    assert as_dict(rollup) == expected
    rollup.compact()
    assert as_dict(rollup) == expected and not rollup.apply("b1", changes(spark, []))
    assert rollup.apply("b3", changes(spark, [])) and as_dict(rollup) == expected
    rollup.compact()
    assert as_dict(T.TokenRollup(spark, f"file://{tmp_path}/a")) == expected
    assert not rollup.apply("b2", changes(spark, []))


def test_an_interrupted_compaction_counts_nothing_twice(spark, tmp_path):
    rollup = T.TokenRollup(spark, f"file://{tmp_path}/b")
    rollup.apply("b1", changes(spark, [(1, "s", "en", "v1", 10, "1")]))
    before = as_dict(rollup)
    delete, rollup._fs = rollup._fs, None

    class Broken:
        def __getattr__(self, name):
            return (lambda *a: None) if name == "delete" else getattr(delete, name)

    rollup._fs = Broken()
    rollup.compact()
    rollup._fs = delete
    assert len(rollup._commits()) == 2 and as_dict(rollup) == before
    rollup.compact()
    assert len(rollup._commits()) == 1 and as_dict(rollup) == before and not rollup.apply("b1", changes(spark, []))


def test_of_two_writers_of_a_batch_one_counts(spark, tmp_path):
    one, two = (T.TokenRollup(spark, f"file://{tmp_path}/d") for _ in "ab")
    sums = spark.createDataFrame([("s", "en", "v1", 1, 10)], T.SCHEMA)
    assert one._commit("b/1", sums) and not two._commit("b/1", sums)
    assert as_dict(one) == {("s", "en", "v1"): (1, 10)} and len(os.listdir(f"{tmp_path}/d/data")) == 1


def test_a_compaction_without_its_commit_stands_for_nothing(spark, tmp_path):
    rollup = T.TokenRollup(spark, f"file://{tmp_path}/e")
    rollup.apply("b1", changes(spark, [(1, "s", "en", "v1", 10, "1")]))
    commit, rollup._commit = rollup._commit, lambda *a: (_ for _ in ()).throw(OSError)
    with pytest.raises(OSError):
        rollup.compact()
    rollup._commit = commit
    assert as_dict(rollup) == {("s", "en", "v1"): (1, 10)} and not rollup.apply("b1", changes(spark, []))


def between(rollup, act):
    """Does something just before the rollup's next commit of sums."""
    commit = rollup._commit

    def late(*a, **k):
        rollup._commit = commit
        act()
        return commit(*a, **k)

    rollup._commit = late


def test_a_batch_committed_beside_a_compaction_counts_once(spark, tmp_path):
    one, two = (T.TokenRollup(spark, f"file://{tmp_path}/f") for _ in "ab")
    one.apply("b1", changes(spark, [(1, "s", "en", "v1", 10, "1")]))
    between(one, lambda: two.apply("b2", changes(spark, [(1, "s", "en", "v1", 100, "2")])))
    assert one.compact() and as_dict(one) == as_dict(two) == {("s", "en", "v1"): (2, 110)}
    assert one.compact() and as_dict(two) == {("s", "en", "v1"): (2, 110)}
    assert not one.apply("b1", changes(spark, [])) and not two.apply("b2", changes(spark, []))


def test_of_two_compactions_at_once_one_counts(spark, tmp_path):
    one, two = (T.TokenRollup(spark, f"file://{tmp_path}/g") for _ in "ab")
    one.apply("b1", changes(spark, [(1, "s", "en", "v1", 10, "1")]))
    # the other comes first, and again with a later batch: its base takes two numbers, and neither is free again
    between(one, lambda: (two.compact(), two.apply("b2", changes(spark, [(1, "s", "en", "v1", 5, "2")])), two.compact()))
    sums = one._summed
    one._summed = lambda live: spark.createDataFrame(sums(live).collect(), T.SCHEMA)  # read before the other removes the files
    assert not one.compact() and as_dict(one) == as_dict(two) == {("s", "en", "v1"): (2, 15)}
    assert two.compact() and as_dict(one) == {("s", "en", "v1"): (2, 15)} and len(one._commits()) == 1
    assert len(os.listdir(f"{tmp_path}/g/data")) == 1 and not one.apply("b1", changes(spark, []))


@needs_vocabulary
def test_the_query_against_brute_force(spark, edge_rows, tmp_path):
    """Inserts of estimates, revisions to counts, deletes of what labels call toxic, compaction, and all batches again."""
    table(spark, edge_rows).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {101, 103, 300, 500, 9999}
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in [*range(600), 9999]] + [(500, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with open(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        encoding = T._encoding(f.read())
    expected: dict = {}
    for doc_id, text, *more in edge_rows:
        if doc_id in toxic:
            continue
        lang, source = more if more else ("en", "s0")
        for version, n in (("words-1", len(words(text))), ("byte_bpe_50k", len(encoding.encode_ordinary(text or "")))):
            docs, tokens = expected.get((source, lang, version), (0, 0))
            expected[source, lang, version] = docs + 1, tokens + n
    got = queries.op2_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in got} == expected
    got = queries.word_counts_rollup(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, "words-1"): (r.n_docs, r.n_tokens) for r in got} == {k: v for k, v in expected.items() if k[2] == "words-1"}


@needs_vocabulary
def test_counts_are_those_of_the_tokenizer(spark, edge_rows, tmp_path):
    counts = T.counted(table(spark, edge_rows))
    with open(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        encoding = T._encoding(f.read())
    got = Counter((r.version, r.n_tokens) for r in counts.collect())
    assert got == Counter(("words-1", len(words(t))) for _, t, *_ in edge_rows) + Counter(("byte_bpe_50k", len(encoding.encode_ordinary(t or ""))) for _, t, *_ in edge_rows)
    rollup = T.TokenRollup(spark, f"file://{tmp_path}/c")
    rollup.apply("all", T.inserts(counts))
    total = rollup.totals().agg(F.sum("n_docs")).first()[0]
    assert total == 2 * len(edge_rows)
    rollup.apply("revised", T.revisions(counts, counts.withColumn("version", F.lit("v2"))))
    assert {k[2] for k in as_dict(rollup)} == {"v2"}
    rollup.apply("none", T.deletes(counts.withColumn("version", F.lit("v2"))))
    assert as_dict(rollup) == {}
    assert T.counted(table(spark, [])).collect() == []
