from __future__ import annotations

import re
import time
import tracemalloc

from hypothesis import given, settings, strategies as st

from corvane.llm import pii
from tests.llm.conftest import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.1+ -9(5)", max_size=50))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base(text) == brute(text)


def spans(text):
    return {k: [text[a:b] for a, b in v] for k, v in pii.disguised(text, pii.base(text)).items() if v}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=30), st.data())
def test_every_character_keeps_its_source(text, data):
    t, spans = pii.Rewritten(text), [(i, i + 1) for i in range(len(text))]
    for _ in range(3):
        edges = sorted(data.draw(st.sets(st.integers(0, len(t.text)), max_size=6)))
        edits = [(a, b, data.draw(st.sampled_from(["", "x", "yz"]))) for a, b in zip(edges[::2], edges[1::2], strict=False)]
        new, own, at = "", [], 0
        for a, b, s in edits:
            new, own, at = new + t.text[at:a] + s, own + spans[at:a] + [(spans[a][0], spans[b - 1][1])] * len(s), b
        t, spans, new = t.replaced(edits), own + spans[at:], new + t.text[at:]
        assert t.text == new and [t.source((i, i + 1)) for i in range(len(new))] == spans


def test_memory_goes_with_edits_not_characters():
    text = "plain words of no interest " * 200_000 + "mail jane at example dot com"
    plain = pii.base(text)
    tracemalloc.start()
    assert pii.disguised(text, plain)["email"] == [(len(text) - 23, len(text))]
    assert tracemalloc.get_traced_memory()[1] < 5 * len(text)
    tracemalloc.stop()


def test_disguises_map_back_to_the_source():
    assert spans("write to john.doe [at] example (dot) com now") == {"email": ["john.doe [at] example (dot) com"]}
    assert spans("mail jane at example dot co dot uk") == {"email": ["jane at example dot co dot uk"]}
    assert spans("ask john dot doe at example dot com today") == {"email": ["john dot doe at example dot com"]}
    assert spans("ask john@example dot com or a.b [at] c.de") == {"email": ["john@example dot com", "a.b [at] c.de"]}
    assert spans("call plus one five five five, one two three four five six seven ok") == {"phone": ["plus one five five five, one two three four five six seven"]}
    assert spans("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ") == {"email": ["ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"]}
    assert spans("jo​hn@exam​ple.com here") == {"email": ["jo​hn@exam​ple.com"]}
    assert spans("four one one one one one one one one one one one one one one one x") == {"card": ["four one one one one one one one one one one one one one one one"]}
    assert spans("see you at noon; the dot com boom; one two three; a (at) b") == {}


def test_mixed_and_spoken_numbers():
    assert spans("call +1 555 two three four five six seven ok") == {"phone": ["+1 555 two three four five six seven"]}
    assert spans("card 4111 1111 1111 one one one one ok") == {"card": ["4111 1111 1111 one one one one"]}
    assert spans("room 5 192 dot 168 dot 10 dot 77 ok") == {"ip": ["192 dot 168 dot 10 dot 77"]}
    assert spans("from one nine two dot one six eight dot one dot one ok") == {"ip": ["one nine two dot one six eight dot one dot one"]}
    assert spans("from 192 [dot] 168.10.one ok") == {"ip": ["192 [dot] 168.10.one"]}
    assert spans("in 2019 one of 10 dot com firms at 10.30, two 3.5 seven") == {}


def test_names_and_domains_partly_spoken():
    assert spans("mail jane at example.com ok") == {"email": ["jane at example.com"]}
    name = "a" * 50 + " dot " + "b" * 90 + " dot c"
    assert spans(f"mail {name} at example dot com ok") == {"email": [f"{name} at example dot com"]}
    text = "mail john dot doe@example.com ok"
    plain = pii.base(text)
    more = pii.disguised(text, plain)
    assert pii.masked(text, {k: plain[k] + more[k] for k in pii.KINDS}) == "mail <EMAIL> ok"


PROSE = """The train arrived at 10.30am and they met me at www.example.com, she said. She works at Amazon.com and looked at St.Mary on the hill.
Sold at Fr.5 a piece, or 3 at No.5; rated 4.5 at example.com and 9 at imdb.com. Look at this. He was at Yahoo.com until 2009, at 12.5 percent.
You can find us at example.org or call us at home. We met at St.James at 8.15, at Fig.2 and at p.17; ask me at www.example.net.
The dot at the end, the point at issue, two at a time, one at 3.14; more at Sec.4.2 and at U.S. prices; write it at least once."""


def test_prose_is_left_alone():
    assert spans(PROSE) == {}
    for sentence in re.split(r"(?<=[.;]) ", PROSE):
        assert spans(sentence) == {}


def test_spoken_at_in_addresses():
    for text in ("jane.doe at example.com", "jane_d at mail.example.org", "jane7 at example.co.uk", "john dot doe at example.com", "jane at example dot com", "jane arroba ejemplo.es"):
        assert spans(f"say {text} now") == {"email": [text]}
    for cue in ("mail", "Email:", "contact", "write to", "e-mail me -"):
        assert spans(f"please {cue} jane at example.com.") == {"email": ["jane at example.com"]}
    assert spans(f"{'x' * 500} mail jane at example.com") == {"email": ["jane at example.com"]}


def test_long_disguised_runs_are_linear():
    for text in ("a dot " * 60_000 + "a at b.c", "a at b.c " * 40_000, "one dot " * 60_000, "a@b dot " * 50_000, "1 one " * 60_000, "a at " + "b." * 100_000):
        start = time.time()
        pii.disguised(text, pii.base(text))
        assert time.time() - start < 10


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "five " * 60_000):
        start = time.time()
        pii.base(text)
        pii.disguised(text, pii.base(text))
        assert time.time() - start < 5


def test_table(spark, edge_rows):
    rows = [*edge_rows, (800, "mail a.b@c.de or +49 (30) 123-4567, 10.0.0.1, 4111 1111 1111 1111 and 300.1.1.1"), (801, "x at y dot com")]
    got = {r.doc_id: r for r in pii.find(table(spark, rows)).collect()}
    assert len(pii.find(table(spark, rows)).collect()) == len(rows)
    r = got[800]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.masked == "mail <EMAIL> or <PHONE>, <IP>, <CARD> and 300.1.1.1"
    assert got[801].n_email == 0 and got[801].spans == "email:0:14"
    kept = pii.redacted(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    found = {r.doc_id: r for r in kept.collect()}
    assert found[100].text is None and found[801].text == "<EMAIL>" and found[801].n_chars == 7
    assert pii.find(table(spark, [])).collect() == []
