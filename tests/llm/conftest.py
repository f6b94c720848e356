from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Columns of names that the operators use inside, and one that nothing knows.
EXTRA = "row long, key string, set string, n int, spans string, token long, score string, topic string, weight string, odd map<string,int>, _row long, _key string, _id string, _text string, _place string, _source string, _lang string, _topic string, _tokens string, _probability string, place long, mix string, its_id string, its_row string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def table(spark, rows: list[tuple]):
    """rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "s0")[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, 1, "k", "s", 2, "x", 3, "y", "t", "w", {"a": 1}, 4, *["u"] * 9, 5, *["v"] * 3))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long text, exact and near copies, repeated rows and ids, shared passages, control characters."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([3, 5, 8, 60, 120, 200])) for _ in range(30)]
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (None, base[3]), (None, None), (103, "x" * 700_000 + " y"), (104, prose(rng, 30_000, 3))]
    rows += [(200 + i, base[-1 - i]) for i in range(5)]  # exact copies
    rows += [(210, base[7].upper()), (211, base[9].replace(" ", "\t\x0b ", 40))]
    near = prose(rng, 200).split()
    for i in range(12):  # a chain of near copies
        near = [*near[:-2], f"n{i}", f"m{i}"] if i % 2 else [f"a{i}", *near[1:]]
        rows.append((300 + i, " ".join(near)))
    rows += [(400 + i, f"{prose(rng, 50)} {passage} {prose(rng, 50)}") for i in range(6)]
    rows += [(500, base[12]), (500, base[12]), (501, base[13]), (501, base[14]), (502, "a\x00b  c d É"), (503, "one two three four five"), (504, "One TWO three four five")]
    rows += [(600, base[12], None, None), (601, passage, "de", None)]
    # Sequences of two values, and their opposites, that are alike under any polynomial modulo a power of two.
    for opposite in (0, 1):
        turns = ["ab"[i.bit_count() + opposite & 1] for i in range(1024)]
        rows += [(700 + opposite, "".join(turns)), (702 + opposite, f"{base[-1][:300]} {''.join(turns)} {prose(random.Random(7), 49)}"), (704 + opposite, " ".join("st"[t == "a"] + "u" for t in turns))]
    return rows
