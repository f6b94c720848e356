from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from corvane.llm import collocations as phrases
from corvane.llm.workspace import Workspace
from tests.llm.conftest import low, prose, table


def brute(rows, least, top, percent=80):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = (r[2] if len(r) > 2 else "en") or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(r[1] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    f[lang][tuple(words[i : i + d])] += 1
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in held.items():
            longer = [b for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= percent * a for b in longer):
                continue
            cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-cut[0], -a, " ".join(p).encode(), cut))
        for rank, (_, a, p, cut) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, cut[2], cut[3], n[lang], cut[0]))
    return sorted(out)


def ours(spark, rows, **how):
    return sorted(tuple(r) for r in phrases.collocations(table(spark, rows).repartition(3), **how).collect())


@pytest.mark.parametrize("shard", [16 << 20, 3000])
def test_equal_to_counting_all(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rng = random.Random(5)
    fixed = ["new york city hall", "new york", "Ad Hoc", "straße nach köln", "to be or not to be", "é à é à é"]

    def text(n):
        words = []
        while len(words) < n:
            words += rng.choice(fixed).split() if rng.random() < 0.2 else [f"w{int(rng.paretovariate(0.7))}"]
        return "".join(w + rng.choice([" "] * 12 + [". ", ", ", "\n", "\t ", "  ", "!?", " ; ", "\x0b", "\r\n", "\x1f "]) for w in words)

    rows = [(i, text(rng.choice([0, 1, 3, 40, 300])), rng.choice(["en", "en", "de", None, "und"])) for i in range(160)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, " .,; ", "fr"), (503, "one two", "fr"), (504, "A\x00b " * 40, "en"), (505, "ab " * 200 + "x" * 5000, "en"), (505, "ab " * 200, "en"), (None, "no id here " * 40, None)]
    rows = [(*r, "s") for r in rows]
    expected = brute(rows, 8, 40)
    assert len({r[0] for r in expected}) == 3 and len(expected) > 60
    assert ours(spark, rows, least=8, top=40) == expected


def test_very_frequent_phrase_and_large_counts(spark, monkeypatch):
    """Counts as in a corpus far larger: products of more than 64 bits stay exact."""
    rows = [(i, "of the people " + prose(random.Random(i), 5), "en", "s") for i in range(60)]
    assert ours(spark, rows, least=30, top=5) == brute(rows, 30, 5)
    large = 4_611_686_018_427_387
    nodes = [("en", "", 0, 9 * large), ("en", "a", 1, 2 * large + 1), ("en", "b", 1, large + 2), ("en", "a b", 2, large)]
    monkeypatch.setattr(phrases, "counts", lambda docs, least, space: spark.createDataFrame(nodes, phrases.NODES))
    got = phrases.collocations(table(spark, [])).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", large, 2 * large + 1, large + 2, 9 * large, 2_000_000 * large // (3 * large + 3))]


def test_pairs_that_the_filter_lets_through_change_nothing(spark, monkeypatch):
    rows = [(i, prose(random.Random(i), 200, 6), "en", "s") for i in range(20)]
    expected = brute(rows, 12, 2000)
    monkeypatch.setattr(phrases.KeyFilter, "test", lambda self: lambda x: x == x)
    assert ours(spark, rows, least=12) == expected


def test_counts_and_empty(spark):
    docs = table(spark, [(1, "a b a b", "en", "s"), (2, None, None, "s")])
    got = {(r.lang, r.phrase, r.depth, r.n) for r in phrases.counts(docs, 2, Workspace(spark, "t")).collect()}
    assert got == {("en", "", 0, 4), ("en", "a", 1, 2), ("en", "b", 1, 2), ("en", "a b", 2, 2)}
    assert ours(spark, []) == [] == ours(spark, [(1, None, None, None), (2, "", "en", "s")])
