"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

Every window of n consecutive words of a benchmark item is a pattern; an item of fewer words is one pattern of its own length.
The patterns of one length m make a matcher of three tables over blocks of two words:

* *shift*: how far the end of a window may move on, given the block there: m - 1 if no pattern holds the block, else its least
  distance to a pattern's end.  Only where it is 0 can a pattern end.
* *suffix*: patterns by the hash of their last block, with the hash of their first block to rule most out.
* the patterns themselves, compared word by word, at last as bytes.

A task scans many segments of its texts in step, each at its own place, as numpy vectors; the blocks of skipped words are never
hashed.  A benchmark beyond SLICE_BYTES of text is searched in slices, and the slices' hits are united; documents are never dealt out for
one slice.  A slice is a few arrays of about ten times its text; of more than HELD slices a task has one in memory at a time and reads it again,
from its machine's copy, for the next batch of texts.

Defined cases: null text has no words; an item without words or with a null id is no pattern; items with one id count once; rows of documents that repeat an id
are judged each by its own text; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import words as W
from corvane.llm.substring_dedup import with_row
from corvane.llm.workspace import small_batches

U64 = W.U64
#: Text of a benchmark that one broadcast slice may hold, slices that a task keeps; windows that one step scans; bits of a shift table.
SLICE_BYTES, HELD, SEGMENT, SHIFT_BITS = 4 << 20, 4, 512, 20
_K = U64(0x9FB21C651E98DF25)


class Matcher:
    """Patterns of m words, by their first words among all words of a slice."""

    def __init__(self, words: np.ndarray, first: np.ndarray, m: int):
        self.m, self.block, self.words, self.first = m, min(2, m), words, first
        self.shift = np.full(1 << SHIFT_BITS, m - self.block + 1, np.int32)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self.slot(self.hash(words, first + end)), m - 1 - end)
        suffix = self.hash(words, first + m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.head = self.hash(words, first + self.block - 1)

    def hash(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The blocks that end at words."""
        last = words[end]
        return last if self.block == 1 else (words[end - 1] * _K + last) * _K

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - SHIFT_BITS)).astype(np.int64)

    def ends(self, t: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Last words of the windows that the shift table doesn't skip."""
        lo, hi = first[:-1] + self.m - 1, first[1:]
        lo, hi = lo[lo < hi], hi[lo < hi]
        count = -(-(hi - lo) // SEGMENT)
        at = np.repeat(lo, count) + SEGMENT * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        stop, found = np.minimum(at + SEGMENT, np.repeat(hi, count)), []
        while len(at):
            step = self.shift[self.slot(self.hash(t, at))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else at

    def matches(self, t: np.ndarray, first: np.ndarray, same) -> list[tuple[int, int]]:
        """(first word, pattern) of each occurrence; same(i, j, m) compares m words from the text's word i with those of the slice's word j."""
        out, ends = [], self.ends(t, first)
        for a in range(0, len(ends), 1 << 16):
            end = ends[a : a + (1 << 16)]
            h = self.hash(t, end)
            lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
            while (some := lo < hi).any():  # one pattern of each bucket at a time
                end, h, lo, hi = end[some], h[some], lo[some], hi[some]
                p = self.order[lo]
                ok = np.flatnonzero(self.head[p] == self.hash(t, end - self.m + self.block))
                q, e = p[ok], end[ok]
                alike = (t[e[:, None] + np.arange(1 - self.m, 1)] == self.words[self.first[q][:, None] + np.arange(self.m)]).all(axis=1)
                out += [(s, k) for s, k in zip((e[alike] - self.m + 1).tolist(), q[alike].tolist(), strict=True) if same(s, int(self.first[k]), self.m)]
                lo = lo + 1
        return out


class Patterns:
    """Matchers of a slice of the benchmark, its words, and which items each pattern belongs to."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        data, offsets = W.column(pa.array([text for _, text in items], pa.string()))
        start, end, h, first = W.words(data, offsets, W.ALNUM)
        self.words, ids, size = W.Words(W.ALNUM.lower[data], start, end), np.array([i for i, _ in items], np.int64), np.diff(first)
        self.matchers = []
        for m in np.unique(np.minimum(size, n)).tolist():
            if not m:
                continue
            own = np.flatnonzero(np.minimum(size, n) == m)  # items whose windows have m words
            count = size[own] - m + 1
            at = np.repeat(first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = self.words.digests(at, at + m)
            order = np.lexsort((at, np.repeat(ids[own], count), hi, lo))  # equal windows are one pattern of several items
            lo, hi, at, item = lo[order], hi[order], at[order], np.repeat(ids[own], count)[order]
            edge = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
            self.matchers.append((Matcher(h, at[edge], m), np.append(edge, len(at)), item))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[list[tuple[int, int]], list[int]]]]:
        """Number of words of each text; for each its hit words as disjoint ascending (start, end), and the items found."""
        start, end, t, first = W.words(data, offsets, W.ALNUM)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)

        def same(i: int, j: int, m: int) -> bool:
            return b" ".join([W.ALNUM.lower[data[start[k] : end[k]]].tobytes() for k in range(i, i + m)]) == self.words.of(j, j + m)

        for matcher, edge, owners in self.matchers:
            found = matcher.matches(t, first, same)
            docs = np.searchsorted(first, [s for s, _ in found], "right") - 1
            for d, (s, k) in zip(docs.tolist(), found, strict=True):
                hits[d].append((s - int(first[d]), s - int(first[d]) + matcher.m))
                items[d].update(owners[edge[k] : edge[k + 1]].tolist())
        return np.diff(first), [(united(hits[d]), sorted(items[d])) if d in hits else ([], []) for d in range(len(first) - 1)]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slices(benchmark: DataFrame, n: int, limit: int = SLICE_BYTES) -> list:
    """The benchmark's patterns as broadcasts, each of at most about limit bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, out = -(-total // limit), []
    for i in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        out.append(benchmark.sparkSession.sparkContext.broadcast(Patterns([tuple(r) for r in part.toLocalIterator()], n)))
    return out


def found_in(batch: pa.RecordBatch, text: int, parts: list):
    """(first text, number of words, (hits, items)) of ranges of a batch's texts, hits of all slices united."""
    data, offsets = W.column(batch.column(text))
    for a, b in W.chunks(offsets, W.BLOCK if len(parts) <= HELD else 32 * W.BLOCK):
        n, each = None, None
        for part in parts:
            n, own = part.value.of(data, offsets[a : b + 1])
            if len(parts) > HELD and getattr(part, "_path", None):
                part.__dict__.pop("_value", None)  # read from the local copy again when it is next asked for
            each = own if each is None else [(united(x[0] + y[0]), sorted({*x[1], *y[1]})) for x, y in zip(each, own, strict=True)]
        if n is None:
            n = np.diff(W.words(data, offsets[a : b + 1], W.ALNUM)[3])
            each = [([], [])] * (b - a)
        yield a, n, each


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, hits (spans of hit words), items (ids of the items found, ascending) of each row of documents (doc_id, text)."""
    small_batches(documents.sparkSession)
    parts = slices(benchmark, n, limit)

    def run(batches):
        for batch in batches:
            for a, count, each in found_in(batch, 2, parts):
                hits = [[{"start": x, "end": y} for x, y in h] for h, _ in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(each)), pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([i for _, i in each], pa.list_(pa.int64()))], ["doc_id", "n_words", "hits", "items"])

    return with_row(documents).mapInArrow(run, "doc_id long, n_words long, hits array<struct<start int, end int>>, items array<long>")


def decontaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of documents, all columns, whose text holds no window of the benchmark."""
    small_batches(documents.sparkSession)
    parts, names, text = slices(benchmark, n, limit), documents.columns, documents.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = [not hits for _, _, each in found_in(batch, text, parts) for hits, _ in each]
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


