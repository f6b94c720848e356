from __future__ import annotations

from collections import Counter

import pytest

from corvane.llm.substring_dedup import FingerprintIndex, remove_repeats
from tests.llm.conftest import table, words


def brute(rows, window):
    first: dict[tuple, int] = {}
    for doc_id, text, *_ in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        own, gone = words(text), set()
        for i in range(len(own) - window + 1):
            if doc_id is not None and first[tuple(own[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window, batches, fanout", [(50, 2, 4), (9, 3, 1)])
def test_every_repeated_window_goes_and_nothing_else(spark, edge_rows, window, batches, fanout):
    got = remove_repeats(table(spark, edge_rows), window, batches, fanout).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(edge_rows, window)


def test_empty_table(spark):
    assert remove_repeats(table(spark, [])).collect() == []


def test_compaction_keeps_what_is_known(spark):
    index = FingerprintIndex(spark, window=10)
    text = " ".join(f"x{i}" for i in range(40))
    for i in range(3):
        index.add(table(spark, [(i, f"{text} own{i}")]), table(spark, [(j, f"{text} own{j}") for j in range(i + 1)])).collect()
    index.compact()
    assert len(index.runs) == 1
    found = index.add(table(spark, [(9, text)]), table(spark, [(0, f"{text} own0"), (9, text)])).collect()
    assert {s for r in found for s in range(r.start, r.start + r.len)} == set(range(31))
