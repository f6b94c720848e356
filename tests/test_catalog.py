from __future__ import annotations

import pytest

from corvane.plans import catalog
from tests.oracle import DATA, compared

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    compared(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_every_fold_is_voted_on_and_predicted(spark):
    votes = catalog.QUERIES["knn_vote_by_fold"](spark, str(DATA))
    assert {r.vec_id for r in votes.select("vec_id").collect()} == {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    for name in ("confusion_by_fold", "logistic_by_fold"):
        assert sorted(r.fold for r in catalog.QUERIES[name](spark, str(DATA)).collect()) == [0, 1, 2, 3, 4]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "decision_rank" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
