"""Personal data in texts, plain and disguised, with spans in the characters of the source.

*Base* detectors read the text as it stands: mail addresses, IPv4 addresses, card numbers (16 to 19 digits that pass Luhn's test) and
phone numbers (a plus sign, 8 to 15 digits), leftmost and non-overlapping for each kind; a match that fails its test is dropped.

*Disguised* ones go through transducers.  Each rewrites a text and keeps, for every character it writes, the source span it
came from, as a list of the pieces between edits: look-alike and full-width characters to ASCII (invisible ones go), spelled digits to digits, and bracketed or spoken
"at" and "dot" to their signs.  The base detectors then read the result, and their spans are mapped back.  A span inside a base
span of its kind adds nothing; one that goes beyond it stands beside it, and is masked with it.  A text without any cue isn't rewritten.

Every pattern is linear in the text: a run of digits or of address characters is tried from its first character only.
Defined cases: null text is empty and has no spans.  Rows that repeat stay rows.  Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.workspace import small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def base(text: str) -> dict[str, list[Span]]:
    digits = re.search("[0-9]", text) is not None
    return {"email": emails(text), "ip": ips(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits else []}


# Look-alikes of ASCII letters, digits and signs; characters that show nothing; digit words of the corpus languages.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "·": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "zéro": "0", "one": "1", "eins": "1", "uno": "1", "two": "2", "zwei": "2", "dos": "2", "deux": "2", "three": "3", "drei": "3", "tres": "3", "trois": "3",
    "four": "4", "vier": "4", "cuatro": "4", "quatre": "4", "five": "5", "fünf": "5", "cinco": "5", "cinq": "5", "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "siete": "7", "sept": "7",
    "eight": "8", "acht": "8", "ocho": "8", "huit": "8", "nine": "9", "neun": "9", "nueve": "9", "neuf": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase|ät", "dot|punto|punkt|point", "plus|más"

_LIKE = LOOKALIKES | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(z + d): str(d) for z in (0x660, 0x6F0, 0x966) for d in range(10)} | dict.fromkeys(INVISIBLE, "")
_LIKE_CUE = re.compile("[" + "".join(map(re.escape, _LIKE)) + "]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT, _GAP = rf"(?:(?:{_WORD})(?!\w)|[0-9]++(?!\w))", r"[ \t,.()-]{1,3}"
_DOT_BETWEEN = rf"(?:[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}|[ \t]?[\[({{<][ \t]?(?:{DOT_WORDS}|\.)[ \t]?[\])}}>][ \t]?)"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:(?:{PLUS_WORDS})(?!\w)|\+)[ \t]*)?{_UNIT}(?:(?:{_DOT_BETWEEN}|{_GAP}){_UNIT})++", re.I)
_SPELLED_CUE = re.compile(rf"(?<!\w)(?:{_WORD})(?:{_DOT_BETWEEN}|{_GAP}){_UNIT}|[0-9](?:{_DOT_BETWEEN}|{_GAP})(?:{_WORD})(?!\w)|[0-9]{_DOT_BETWEEN}[0-9]", re.I)
_SPOKEN_GAP = re.compile(_DOT_BETWEEN, re.I)
_SPELLED_PART = re.compile(rf"({PLUS_WORDS}|\+)|({_WORD})|([0-9]+)", re.I)
_BRACKET = re.compile(rf"[ \t]?[\[({{<][ \t]?(?:({AT_WORDS}|@)|({DOT_WORDS}|\.))[ \t]?[\])}}>][ \t]?", re.I)
_CHAIN = rf"[A-Za-z0-9-]++(?:(?:\.|[ \t](?:{DOT_WORDS})[ \t])[A-Za-z0-9-]++)+"
_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9])[ \t]({AT_WORDS})[ \t](?![0-9.]++(?![A-Za-z0-9-]))(?={_CHAIN})", re.I)
_CHAINED = re.compile(_CHAIN, re.I)
# Common endings of domains; words that announce an address, and short ones that may follow them; words that are no name.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io ai co me tv app dev xyz online site shop blog eu uk us ca au nz de fr es it nl be ch at lu pl se no dk fi is pt ie in jp cn kr tw hk sg br mx ar cl pe ru ua tr gr cz sk si hr hu ro bg lt lv ee za il".split()
)
CUES = frozenset("mail email e-mail mailto contact write reach ask ping correo escribe escribir courriel contactez écrivez schreib schreiben kontakt".split())
LINKS, NO_NAMES = frozenset("to a à an us me".split()), frozenset("me us him her them you it i we he she they this that mir uns ihm ihr ihnen moi nous lui leur mí nosotros".split())
_BEFORE = re.compile(r"(?:([\w-]+)[^\w\n]{1,3})?(?:([\w-]+)[^\w\n]{1,3})?(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)\Z")
#: Characters before a spoken "at" that are looked at for a name and its announcement.
REACH = 120
_MIXED = re.compile(rf"@(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+[ \t](?:{DOT_WORDS})[ \t][A-Za-z0-9-])", re.I)
_NAMED = re.compile(rf"[ \t](?:{DOT_WORDS})[ \t][A-Za-z0-9._%+-]++(?=@)", re.I)
_SPOKEN_BEFORE, _DOT_REACH = re.compile(rf"[ \t](?:{DOT_WORDS})[ \t]\Z", re.I), max(map(len, DOT_WORDS.split("|"))) + 2
_HOST = re.compile(r"[A-Za-z0-9-]+")
_SPOKEN_DOT = re.compile(rf"[ \t](?:{DOT_WORDS})[ \t](?=[A-Za-z0-9])", re.I)


class Rewritten:
    """A text and the source span of each of its characters, as pieces: from `at` on, characters stand each for one of the source
    from `start` on or, where an `end` is given, all for the span from start to end."""

    def __init__(self, text: str, at: list[int] | None = None, start: list[int] | None = None, end: list[int | None] | None = None):
        self.text, self.at, self.start, self.end = text, at or [0], start or [0], end or [None]

    def _of(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        if self.end[k] is not None:
            return self.start[k], self.end[k]
        return self.start[k] + i - self.at[k], self.start[k] + i - self.at[k] + 1

    def replaced(self, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
        """With edits (start, end, new characters), ascending and disjoint; each new character stands for the whole edited span."""
        text, at, start, end, done, size = [], [], [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            k = bisect_right(self.at, done) - 1
            while done < a:  # the pieces between two edits
                stop = min(a, self.at[k + 1]) if k + 1 < len(self.at) else a
                at.append(size)
                start.append(self.start[k] + (done - self.at[k] if self.end[k] is None else 0))
                end.append(self.end[k])
                text.append(self.text[done:stop])
                size, done, k = size + stop - done, stop, k + 1
            if new:
                at.append(size)
                start.append(self._of(a)[0])
                end.append(self._of(b - 1)[1])
                text.append(new)
                size += len(new)
            done = b
        return Rewritten("".join(text), at, start, end)

    def source(self, span: Span) -> Span:
        return self._of(span[0])[0], self._of(span[1] - 1)[1]


def lookalikes(t: Rewritten) -> Rewritten:
    return t.replaced((m.start(), m.end(), _LIKE[m[0]]) for m in _LIKE_CUE.finditer(t.text)) if not t.text.isascii() else t


def spelled_digits(t: Rewritten) -> Rewritten:
    """Runs of digit words, digits and spoken dots become digits and dots; single digits lose the blanks between them, groups keep one."""

    def edits():
        for m in _SPELLED.finditer(t.text):
            if not _SPELLED_CUE.search(m[0]):
                continue
            parts = list(_SPELLED_PART.finditer(t.text, m.start(), m.end()))
            gaps = [t.text[p.end() : q.start()] for p, q in zip(parts, parts[1:], strict=False)]
            spoken = [not p[1] and len(g) > 1 and _SPOKEN_GAP.fullmatch(g) is not None for p, g in zip(parts, gaps, strict=False)]
            four = sum(spoken) + gaps.count(".") == 3  # an address: its dots are dots
            for i, p in enumerate(parts):
                if i:
                    q, gap = parts[i - 1], gaps[i - 1]
                    alone = q[1] or (q[2] or len(q[3]) == 1) and (p[2] or len(p[3]) == 1)
                    between = "." if spoken[i - 1] or four and gap == "." else "" if alone else " "
                    if gap != between:
                        yield q.end(), p.start(), between
                if not p[3]:
                    yield p.start(), p.end(), "+" if p[1] else DIGIT_WORDS[p[2].lower()]

    out = list(edits())
    if not out:
        return t
    return t.replaced(out)


def _meant(text: str, m: re.Match) -> bool:
    """Whether a spoken "at" stands in an address: its domain has a spoken dot, or it has a common ending, and what is left of "at" is written
    like a name (a letter, and a point, underscore, digit or spoken dot) or announced as one.  Other languages' words for the sign mean nothing else."""
    if m[1].lower() != "at":
        return True
    domain = _CHAINED.match(text, m.end())[0]
    if " " in domain or "\t" in domain:
        return True
    if domain.rsplit(".", 1)[1].lower() not in ENDINGS or domain[:4].lower() == "www.":
        return False
    before = _BEFORE.search(text[max(0, m.start() - REACH) : m.start()])
    if not before:
        return False
    far, near, name = (x or "" for x in before.groups())
    if not near:
        far, near = "", far
    if any(c.isalpha() for c in name) and (any(c in "._" or c.isdigit() for c in name.strip(".")) or _SPOKEN_BEFORE.search(text[max(0, m.start() - len(name) - _DOT_REACH) : m.start() - len(name)])):
        return True
    return name.lower() not in NO_NAMES and (near.lower() in CUES or near.lower() in LINKS and far.lower() in CUES)


def at_and_dot(t: Rewritten) -> Rewritten:
    """Bracketed signs, spoken "at" in an address, and the spoken dots on either side of an at sign."""
    t = t.replaced((m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKET.finditer(t.text))
    signs = {(m.start(), m.end()) for m in _SPOKEN.finditer(t.text) if _meant(t.text, m)} | {(m.start(), m.start() + 1) for m in _MIXED.finditer(t.text)} | {(m.end(), m.end() + 1) for m in _NAMED.finditer(t.text)}
    edits: list[tuple[int, int, str]] = []
    done = 0
    for start, end in sorted(signs):
        if start < done:
            continue
        before, at = [], start
        while at > done:
            name = at
            while name > done and t.text[name - 1] in _LOCAL_CHARS:
                name -= 1
            m = _SPOKEN_BEFORE.search(t.text, max(done, name - _DOT_REACH), name) if name < at else None
            if not m:
                break
            before.append((m.start(), m.end(), "."))
            at = m.start()
        edits += [*reversed(before), (start, end, "@")]
        done = at = end
        while host := _HOST.match(t.text, at):
            done = host.end()
            if dot := _SPOKEN_DOT.match(t.text, done):
                edits.append((dot.start(), dot.end(), "."))
                done = at = dot.end()
            elif t.text[done : done + 1] == ".":
                at = done + 1
            else:
                break
    return t.replaced(edits) if edits else t


def _cue(text: str) -> bool:
    return bool(not text.isascii() and _LIKE_CUE.search(text) or any(p.search(text) for p in (_BRACKET, _SPOKEN, _MIXED, _NAMED, _SPELLED_CUE)))


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _cue(text):
        return out
    t = at_and_dot(spelled_digits(lookalikes(Rewritten(text))))
    for kind, spans in base(t.text).items():
        ends = [b for _, b in plain[kind]]
        for span in map(t.source, spans):
            i = bisect_left(ends, span[0] + 1)
            if i == len(ends) or plain[kind][i][0] > span[0] or ends[i] < span[1]:
                out[kind].append(span)
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, own in spans.items() for a, b in own):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(documents: DataFrame, mask: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end), masked (the text without them; null if mask is off), of each row of documents (doc_id, text)."""
    small_batches(documents.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                plain = base(text)
                more = disguised(text, plain)
                every = {k: plain[k] + more[k] for k in KINDS}
                rows.append((*(len(plain[k]) for k in KINDS), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every), masked(text, every) if mask else None))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            kinds = [*[pa.int64()] * 4, *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")


def redacted(documents: DataFrame) -> DataFrame:
    """documents with the spans of its text masked, null kept null, and n_chars, where there is one, the new length."""
    small_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                if text:
                    plain = base(text)
                    more = disguised(text, plain)
                    text = masked(text, {k: plain[k] + more[k] for k in KINDS})
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(documents.columns)
