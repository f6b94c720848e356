from __future__ import annotations

import random
from collections import Counter

from corvane.llm.decontamination import contamination, decontaminated
from tests.llm.conftest import ALNUM, low, prose, table


def brute(rows, items, n):
    patterns: dict[tuple, set[int]] = {}
    for item, text in items:
        own = ALNUM.findall(low(text or ""))
        m = min(n, len(own))
        for i in range(len(own) - m + 1 if m and item is not None else 0):
            patterns.setdefault(tuple(own[i : i + m]), set()).add(item)
    sizes, out = {len(p) for p in patterns}, []
    for doc_id, text, *_ in rows:
        own, hit, found = ALNUM.findall(low(text or "")), set(), set()
        for m in sizes:
            for i in range(len(own) - m + 1):
                if items_ := patterns.get(tuple(own[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= items_
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return Counter(out)


def items_for(rows):
    rng = random.Random(5)
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 60][:4]
    items = [(i, " ".join(t.split()[20:45])) for i, t in enumerate(long)]
    return [*items, (10, "one TWO, three"), (11, prose(rng, 30)), (12, None), (13, ""), (None, long[0]), (14, items[0][1]), (14, items[0][1]), (15, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]


def test_hits_and_items(spark, edge_rows):
    items = items_for(edge_rows)
    benchmark = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    for limit in (1 << 20, 200):  # one slice, then several
        got = contamination(table(spark, edge_rows), benchmark, 10, limit).collect()
        assert Counter((r.doc_id, r.n_words, sum(h.end - h.start for h in r["hits"]), tuple(r["items"])) for r in got) == brute(edge_rows, items, 10)
    clean = {k[0] for k in brute(edge_rows, items, 10) if not k[2]}
    kept = decontaminated(table(spark, edge_rows), benchmark, 10)
    assert kept.columns == table(spark, edge_rows).columns and {r.doc_id for r in kept.collect()} == clean


def test_empty_tables(spark, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["hits"] for r in contamination(table(spark, edge_rows), none).collect())
    assert contamination(table(spark, []), none).collect() == []
