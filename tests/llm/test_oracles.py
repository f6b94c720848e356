from __future__ import annotations

import pytest

from corvane.llm import queries
from tests.oracle import DATA, compared

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compared(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
