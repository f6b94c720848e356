"""Removal of passages seen before, by a log-structured index of window fingerprints.

A window is so many (50) consecutive words of one document.  Its fingerprint is the least hash of the runs of a third of a window (16 words)
inside it, so that windows with equal words have equal fingerprints while neighbours mostly share one: a *span* is a run of
consecutive windows with one fingerprint, about 18 of them, and known by its fingerprint, a digest of its words, its document and place.

The index is a list of immutable runs, tables of spans sorted by fingerprint, each (fingerprint, words) once with its smallest document.  A
batch is added as a run of its own and then merge-joined with all runs: a span whose very words belong to a smaller
document is found at once; one that shares only the fingerprint with a smaller document is *verified* window by
window, by the words of the windows of both sides, taken from the texts again.  When there are too many runs they are compacted before the
next batch: equal spans become one.  Fingerprints only bring spans together; words count as equal where the 128-bit digests (XXH3) of their very
bytes are equal, so among 10**12 spans some 10**-15 pairs would be expected to be taken for equal wrongly.

Scale: the spans of a batch are written once; only texts that take part in a match are dealt out (see filters.py); equal
spans are merged before rows are dealt out.  Spans at the edges of a common passage share a fingerprint and differ in words: their
joins are on salted fingerprints where Spark may not split the side at hand, and left to its skew joins elsewhere.

Defined cases: null or empty text: no words, kept text empty.  A null doc_id: neither removed from nor a source.  Rows
that repeat a doc_id are judged by their own text each, and never against one another.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import words as W
from corvane.llm.filters import KeyFilter
from corvane.llm.workspace import Workspace

SPAN = "f long, content long, guard long, doc_id long, row long, start int, len int"
#: Tasks that the rows of one fingerprint are dealt to, where a join could not split them.
SALTS = 16


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable[[], W.Words]]]:
    """Ranges of documents with their word hashes and first words, and a way to their words."""
    data, offsets = W.column(batch.column(text))
    for a, b in W.chunks(offsets):
        start, end, h, first = W.words(data, offsets[a : b + 1], W.PLAIN)
        yield a, b, h, first, lambda start=start, end=end: W.Words(data, start, end)


def _spans(window: int):
    part = max(1, window // 3)

    def of(h: np.ndarray, first: np.ndarray):
        """Document number, first word, number of windows and fingerprint of the spans of a range of documents."""
        if len(h) < window:
            return None
        f = least_of(W.grams(h, part), window - part + 1)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(f)]
        inside = np.arange(len(f)) + window <= first[doc + 1]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
        new &= inside
        start = np.flatnonzero(new)
        if not len(start):
            return None
        last = np.minimum(np.append(start[1:], len(f)), first[doc[start] + 1] - window + 1)
        return doc[start], start, last - start, f[start]

    def run(batches):
        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, _, h, first, own in _pieces(batch, 2):
                if (found := of(h, first)) is not None:
                    doc, start, n, f = found
                    content, guard = own().digests(start, start + n + window - 1)
                    columns = [f.view(np.int64), content, guard, ids[doc + a], rows[doc + a], (start - first[doc]).astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["f", "content", "guard", "doc_id", "row", "start", "len"])

    return run


def _windows(window: int):
    """Every window of the given spans: its fingerprint, a digest of its words, and its place."""

    def run(batches):
        for batch in batches:
            ids, rows, spans = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            edge, items = np.asarray(spans.offsets), spans.values
            f, start, n, asks = (np.asarray(items.field(k)) for k in ("f", "start", "len", "asks"))
            for a, b, _, first, own in _pieces(batch, 2):
                words = own()
                lo, hi = int(edge[a]), int(edge[b])
                doc = np.repeat(np.arange(a, b), np.diff(edge[a : b + 1]))
                at = start[lo:hi] + first[doc - a]
                for i in range(0, hi - lo, 20_000):
                    j = min(i + 20_000, hi - lo)
                    count = n[lo + i : lo + j].astype(np.int64)
                    of = np.repeat(np.arange(i, j), count)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    place = at[of] + step
                    ok = place + window <= first[doc[of] - a + 1]  # a repeated doc_id may bring another text
                    of, step, place = of[ok], step[ok], place[ok]
                    if len(of):
                        h, g = words.digests(place, place + window)
                        columns = [f[lo + of], h, g, ids[doc[of]], rows[doc[of]], (start[lo + of] + step).astype(np.int32), asks[lo + of]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["f", "h", "g", "doc_id", "row", "start", "asks"])

    return run


def _kept(window: int, marked: bool, skip=None):
    """The words left of each text.  marked: a fourth column has spans of repeats; skip: a test of places in a fourth column, of rows to leave out."""

    def run(batches):
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~skip(np.asarray(batch.column(3)))))
            data, offsets = W.column(batch.column(2))
            for a, b in W.chunks(offsets, 1 << 23):
                n, removed, kept = [], [], []
                for i in range(a, b):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    n.append(len(own))
                    if marked and batch.column(3)[i].is_valid:
                        spans = batch.column(3)[i].values
                        start, size = np.asarray(spans.field("start")), np.asarray(spans.field("len"))
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + size + window - 1, -1)
                        keep = np.cumsum(edge)[:-1] == 0
                        own = list(compress(own, keep.tolist()))
                    removed.append(n[-1] - len(own))
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "row", "n_words", "n_removed", "kept"])

    return run


def with_row(documents: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, to tell rows with one doc_id apart), text."""
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string"))


class FingerprintIndex:
    """Sorted immutable runs of spans; see the module's text.  fanout: runs held at most before a batch is added."""

    def __init__(self, spark: SparkSession, window: int = 50, fanout: int = 4):
        self.spark, self.window, self.fanout = spark, window, fanout
        self.space, self.runs, self.made = Workspace(spark, "spans"), [], 0

    def _write(self, spans: DataFrame) -> None:
        least = spans.groupBy("f", "content", "guard").agg(F.min(F.struct("doc_id", "start", "len")).alias("s"), F.max("last").alias("last"))
        name = f"run-{self.made}"
        self.made += 1
        self.runs.append((name, self.space.keep(least.select("f", "content", "guard", "s.*", "last").sortWithinPartitions("f", "content", "guard"), name)))

    def _all(self) -> DataFrame:
        out = self.runs[0][1]
        for _, run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def spans(self, documents: DataFrame) -> DataFrame:
        long_enough = F.length("text") >= 2 * self.window - 1
        return with_row(documents).where(F.col("doc_id").isNotNull() & long_enough).mapInArrow(_spans(self.window), SPAN)

    def compact(self) -> None:
        """One run of all; the old runs go once it is written."""
        old = self.runs
        merged = self._all()
        self.runs = []
        self._write(merged)
        for name, _ in old:
            self.space.drop(name)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Index a batch; return (doc_id, row, start, len), spans of windows of the batch that also start in a document with a
        smaller doc_id.  corpus: all documents added so far and the batch, to read texts of matches from."""
        if len(self.runs) >= self.fanout:
            self.compact()
        turn = self.made
        spans = self.space.keep(self.spans(batch), f"spans-{turn}")
        self._write(spans.withColumn("last", F.col("doc_id")))
        runs = self._all()
        shared = runs.groupBy("f").agg(F.min("doc_id").alias("least"), F.max("last").alias("last")).where("least < last").select("f", "least")
        shared = self.space.keep(shared, f"shared-{turn}")
        suspects = self.space.keep(spans.join(shared, "f").where("doc_id > least").drop("least"), f"suspects-{turn}")
        self.space.drop(f"spans-{turn}")
        words = ["f", "content", "guard"]
        variants = runs.join(shared.select("f"), "f", "left_semi")
        if len(self.runs) > 1:
            variants = variants.groupBy(*words).agg(F.min(F.struct("doc_id", "start", "len")).alias("s")).select(*words, "s.*")
        variants = self.space.keep(variants.select(*words, "doc_id", "start", "len"), f"variants-{turn}")
        first = variants.select(*words, F.col("doc_id").alias("first"))
        judged = self.space.keep(suspects.join(first, words).withColumn("found", F.expr("first < doc_id")).drop("first", "content", "guard"), f"judged-{turn}")
        found = judged.where("found").select("doc_id", "row", "start", "len")
        asked = judged.where("not found").select("f", "doc_id", "row", "start", "len")
        return found.unionByName(self._verified(asked, variants, corpus, turn))

    def _verified(self, asked: DataFrame, variants: DataFrame, corpus: DataFrame, turn: int) -> DataFrame:
        open_ = asked.select("f").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = variants.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
        sources = salted.join(open_, ["f", "salt"], "left_semi").select("f", "doc_id", F.lit(None).cast("long").alias("row"), "start", "len", F.lit(False).alias("asks"))
        wanted = asked.withColumn("asks", F.lit(True)).unionByName(sources)
        wanted = self.space.keep(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("f", "start", "len", "asks", "row")).alias("spans")), f"wanted-{turn}")
        texts = KeyFilter(wanted, "doc_id").keep(with_row(corpus).where("doc_id is not null"), "doc_id")
        texts = texts.join(wanted, "doc_id").select("doc_id", "row", "text", F.expr("transform(filter(spans, s -> s.row is null or s.row = row), s -> struct(s.f as f, s.start as start, s.len as len, s.asks as asks))").alias("spans"))
        rows = self.space.keep(texts.mapInArrow(_windows(self.window), "f long, h long, g long, doc_id long, row long, start int, asks boolean"), f"windows-{turn}")
        words = ["f", "h", "g"]
        least = self.space.keep(rows.groupBy(*words).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*words, "least"), f"known-{turn}")
        return rows.where("asks").join(least, words).where("doc_id > least").select("doc_id", "row", "start", F.lit(1).alias("len"))


def remove_repeats(documents: DataFrame, window: int = 50, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, one space between them) of each row of documents (doc_id, text).

    The table is added to an index in batches of rising doc_id, as a growing corpus would be.
    """
    spark, documents = documents.sparkSession, documents.select("doc_id", "text")
    index = FingerprintIndex(spark, window, fanout)
    lo, hi = documents.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    marks = None
    edges = [] if lo is None else sorted({lo + (hi - lo + 1) * i // batches for i in range(batches)})
    for i, edge in enumerate(edges):
        below = edges[i + 1] if i + 1 < len(edges) else None
        upto = documents if below is None else documents.where(F.col("doc_id") < below)
        found = index.space.keep(index.add(upto.where(F.col("doc_id") >= edge), upto), f"found-{i}")
        marks = found if marks is None else marks.unionByName(found)
    schema = "doc_id long, row long, n_words long, n_removed long, kept string"
    texts = with_row(documents)
    if marks is None:
        return texts.mapInArrow(_kept(window, False), schema).drop("row")
    marks = marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "len")).alias("spans")).withColumn("key", F.xxhash64("doc_id", "row"))
    marks = index.space.keep(marks, "marks")
    index.space.only("marks")
    wanted = KeyFilter(marks, "key")
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "row"))
    clean = keyed.select("doc_id", "row", "text", wanted.place("key")).mapInArrow(_kept(window, False, wanted.test()), schema)
    cut = wanted.keep(keyed, "key").drop("key").join(marks.drop("key"), ["doc_id", "row"], "left").select("doc_id", "row", "text", "spans").mapInArrow(_kept(window, True), schema)
    return clean.unionByName(cut).drop("row")
