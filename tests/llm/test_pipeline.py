from __future__ import annotations

import hashlib
import importlib.util
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest

from corvane.llm import mixing
from tests.llm.conftest import prose, table
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_jaccard import brute as groups
from tests.llm.test_pii import PATTERNS

ROOT = Path(__file__).resolve().parents[2]


def band(n: int) -> str:
    return "note" if n < 150 else "article" if n < 600 else "longform"


def raked(rows):
    """Weight over tokens of each cell of (source, lang, tokens), fitted to the default targets by many rounds."""
    cells = defaultdict(float)
    for source, lang, n in rows:
        cells[source, lang, band(n)] += n
    weight, power = dict(cells), list(mixing.POWERS.values())
    sums = lambda w, d: {v: sum(x for k, x in w.items() if k[d] == v) for v in {k[d] for k in w}}
    for _ in range(200):
        for d in range(3):
            target, now = sums(cells, d), sums(weight, d)
            weight = {k: x * target[k[d]] ** power[d] / now[k[d]] for k, x in weight.items()}
    unit = mixing.RATE * sum(cells.values()) / sum(weight.values())
    return {k: unit * weight[k] / cells[k] for k in cells}


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_against_brute_force(spark, pipeline, tmp_path):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = prose(rng, 90) if good else prose(rng, 60).upper() + "!!!"
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice("abc")))
        labels.append((i, int(good)))
    rows += [(1000 + i, rows[1 + 4 * i][1] + " tail", "en", "a") for i in range(10)]
    item = prose(rng, 30)
    rows += [(2000 + i, f"{prose(rng, 40)} {item} {prose(rng, 40)}", "en", "b") for i in range(4)]
    rows += [(3000, prose(rng, 60) + " mail me: a.b@c.de " + prose(rng, 60), "en", "c"), (3001, prose(rng, 60) + " call jane at example dot com " + prose(rng, 60), "en", "c")]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    assert len(pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:5] == columns and (i == 4 or docs.columns == columns)
        docs.write.parquet(f"{tmp_path}/stage-{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{i}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    bad = {i for i, q in labels if not q}
    one, two, three, four, five = seen.values()
    assert not bad & set(one) and len(one) == len(rows) - len(bad)
    kept = [(d, r.text) for d, r in one.items()]
    assert set(two) == {c for (d, n, c) in groups(kept)}
    assert set(three) == {d for (d, n, hit, items) in leaks([(d, r.text) for d, r in two.items()], [(0, item)], 10) if not hit}
    assert all(d in three for d in two if d < 2000) and not any(2000 <= d < 3000 for d in three)
    assert set(four) == set(three) and "<EMAIL>" in four[3000].text and all(four[d].n_chars == len(four[d].text) for d in four)
    assert not any(re.search(pattern, r.text) for r in four.values() for pattern in (PATTERNS["email"], "jane at example"))
    for d, r in four.items():  # texts without personal data are left alone
        assert d in (3000, 3001) or r.text == three[d].text
    share = raked([(r.source, r.lang, len(r.text.split())) for r in four.values()])
    for d, r in four.items():
        u = int(hashlib.md5(f"{d}-{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
        p = share[r.source, r.lang, band(len(r.text.split()))]
        assert (d in five) == (u < p) or abs(u - p) < 1e-3
        assert d not in five or five[d].probability * five[d].weight == pytest.approx(p, rel=1e-3)
    assert 0 < len(five) < len(four)
    again = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.text) for r in five.values()}
