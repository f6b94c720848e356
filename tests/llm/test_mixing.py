from __future__ import annotations

import hashlib
import random
import warnings
from collections import defaultdict

import pytest

from corvane.llm import mixing
from corvane.llm.workspace import Workspace
from tests.llm.conftest import prose, table, words


def test_marginals_and_draws(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([20, 200, 800])), rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot"] * 6 + ["b", "c"])) for i in range(400)]
    got = mixing.mixed(table(spark, rows)).collect()
    tokens, weight = defaultdict(float), {d: defaultdict(float) for d in ("source", "lang", "topic")}
    for r in got:
        m = r["mix_"]  # the table has a column mix
        assert m.tokens == len(words(r.text))
        u = int(hashlib.md5(f"{r.doc_id}-{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
        assert m.selected == (u < m.probability)
        tokens[m.source] += m.tokens
        for d in weight:
            weight[d][m[d]] += m.tokens * m.probability * m.weight
    total = sum(tokens.values())
    assert sum(weight["source"].values()) == pytest.approx(mixing.RATE * total, rel=1e-6)
    root = {s: t**0.5 for s, t in tokens.items()}
    for s, w in weight["source"].items():
        assert w / sum(weight["source"].values()) == pytest.approx(root[s] / sum(root.values()), rel=2 * mixing.TOLERANCE)
    share = [w / sum(weight["topic"].values()) for w in weight["topic"].values()]
    assert share == pytest.approx([1 / 3] * 3, rel=1e-6)


def test_edges(spark, edge_rows):
    documents = table(spark, edge_rows)
    got = mixing.mixed(documents).collect()
    assert len(got) == len(edge_rows)
    assert all(r["mix_"].probability == 0 and not r["mix_"].selected for r in got if not words(r.text))
    twice = [r["mix_"].selected for r in got if r.doc_id == 500]
    assert len(set(twice)) == 1
    kept = mixing.sampled(documents)
    assert kept.columns == [*documents.columns, "probability", "weight_"]
    given = {r.text: r for r in documents.collect()}
    assert all(r[c] == given[r.text][c] for r in kept.collect() for c in documents.columns if c not in ("doc_id", "lang", "source"))
    assert mixing.mixed(table(spark, [])).collect() == []


def test_null_is_no_text(spark):
    rows = [(i, "one two three", "en", s) for i, s in enumerate([None] * 40 + ["(none)"] * 10)]
    got = mixing.mixed(table(spark, rows), powers={"source": 0.0, "lang": 1.0, "topic": 1.0}, rate=0.1).collect()
    assert {(r["mix_"].source, round(r["mix_"].probability, 6)) for r in got} == {(None, round(7.5 / 120, 6)), ("(none)", 0.25)}


def test_rounds_go_on_until_marginals_hold(spark, tmp_path):
    space = Workspace(spark, "test")
    slow = [("a", "x", 1000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000), ("c", "x", 5)]
    cells = spark.createDataFrame(slow, "source string, lang string, tokens long")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        out, error = mixing.rake(cells, {"source": 0.3, "lang": 0.0}, space)
    assert error <= mixing.TOLERANCE
    got = {(r.source, r.lang): r.weight for r in out.collect()}
    whole = sum(got.values())
    assert sum(w for (_, lang), w in got.items() if lang == "x") / whole == pytest.approx(0.5, rel=2 * mixing.TOLERANCE)
    target = {"a": 1001**0.3, "b": 1001**0.3, "c": 5**0.3}
    for s, t in target.items():
        assert sum(w for (own, _), w in got.items() if own == s) / whole == pytest.approx(t / sum(target.values()), rel=2 * mixing.TOLERANCE)
    apart = spark.createDataFrame([("a", "x", 10), ("b", "y", 1000)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="can't be met"):
        assert mixing.rake(apart, {"source": 0.0, "lang": 1.0}, space)[1] > 0.1


def test_no_python_in_the_plan(spark, edge_rows):
    plan = mixing.mixed(table(spark, edge_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
