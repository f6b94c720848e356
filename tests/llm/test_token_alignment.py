from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import pytest

from corvane.llm import token_alignment as alignment
from tests.llm.conftest import prose, table

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no vocabularies here")


def brute(rows):
    """Every text encoded whole, and every pair of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + (text or ""), add_special_tokens=False) if text else None
        xs = [(i, bytes(chars[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)] if x else []
        ys = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in (b.encode(text) if text else [])]
        if not text or not b"".join(t for _, t in xs) == b"".join(t for _, t in ys) == (" " + text).encode():
            docs.append((doc_id, 0, 0, [], [], ""))
            continue
        ends = []
        for tokens in (xs, ys):
            at, out = 0, {}
            for i, t in tokens:
                at += len(t)
                out[at] = i
            ends.append(out)
        links = [(ends[0][e], ends[1][e]) for e in ends[0] if e in ends[1]]
        groups, part = [], [[], []]
        for e in sorted(set(ends[0]) | set(ends[1])):
            for k in (0, 1):
                if e in ends[k]:
                    part[k].append(str(ends[k][e]))
            if e in ends[0] and e in ends[1]:
                groups.append("|".join(",".join(p) for p in part))
                part = [[], []]
        counts.update(links)
        docs.append((doc_id, len(xs), len(ys), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted([(i, na, nb, len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), sha) for i, na, nb, g, k, sha in docs], key=repr), counts


TEXTS = ["", None, " ", "a", "a ", " a", "a  b", "  a  b  ", "x\ty\nz\r\n w", "<s>hi</s> <|endoftext|> <unk> <0x41>", "nul\x00 in it", "▁a", "a ▁ b", "ﬁ é é 한국어 日本 語", "a　b   c  d", "\x1c \x1d x\x1e y", "don't we'll I'M 12 345678 3.14e10", "😀 👩‍👩‍👧 ok", "foo² bar½ _baz_ -- ?!", "x" * 3000 + " y" * 50, "tab\t end\t", "a ​ b\u0085 c"]


def ours(docs, **more):
    return sorted([tuple(r) for r in alignment.Alignment(docs, A, B, **more).documents().collect()], key=repr)


def test_whole_texts_by_brute_force(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", ".", ",", "é", "ß", " ", "a", "b", "the", "'s", "'ll", "12", "▁x", "\x85", " ", "😀", "_", "²", "I"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(rng.choice(signs) for _ in range(rng.choice([3, 20, 80])))) for i in range(150)]
    rows += [(300, rows[13][1]), (301, prose(rng, 2000)), (301, prose(rng, 50)), (None, "no id")] + [(r[0], r[1] if r[1] is None else r[1][:4000]) for r in edge_rows]
    expected, counts = brute(rows)
    assert ours(table(spark, rows).repartition(3)) == expected
    assert sum(1 for r in expected if r[1]) > 150


def test_pairs(spark):
    rows = [(1, "the cat the cat"), (2, "the dog"), (3, None)]
    expected, counts = brute(rows)
    got = {(r.a, r.b): (r["count"], r.best) for r in alignment.Alignment(table(spark, rows), A, B).pairs().collect()}
    assert {k: v for k, (v, _) in got.items()} == counts and all(best for _, best in got.values())
    once = {(r.a, r.b): r["count"] for r in alignment.Alignment(table(spark, rows), A, B, by="documents").pairs().collect()}
    assert sorted(once.values()) == [1, 1, 2]
    with pytest.raises(ValueError):
        alignment.Alignment(table(spark, rows), A, B, by="tokens")


def test_empty(spark):
    assert ours(table(spark, [])) == []
    assert ours(table(spark, [(1, None), (2, "▁")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
