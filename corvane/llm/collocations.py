"""Phrases of two to four words that stand together, by count tries.

*Tries.*  A shard of texts interns its words in byte order and counts its phrases level by level: a node of depth d is its parent of depth d-1 and one
more word, so nodes come out sorted by phrase.  A shard writes its trie as sorted rows.  Ranges of phrases are then merged by Spark's
sorted shuffle, and counts of equal phrases summed; a phrase has one row a shard at most, so no word or phrase is hot.
*Two descents.*  The first counts words and pairs.  The second counts phrases of three and four words all of whose pairs are frequent,
which any frequent phrase's are; a bit table of bounded size (filters.py) tells which, and lets a few others through that are counted as well and then dropped.
*Scores.*  A candidate's left parts are the nodes on the walk to it, its right parts those that suffix links lead to.  Both are nodes of the merged trie,
so each cut of a candidate is joined with its two nodes; only frequent phrases take part.

Everything is exact: words are compared by their bytes, and products are decimals of 38 digits.

Defined cases: a null or empty text has no words; a null language is `und`; a candidate is left out if any longer one with 80 % of its count holds it, whether that one is
kept or not (it is enough to look at those of one word more, whose counts are no smaller); ties go to the more frequent phrase, then in byte order; a
language without candidates has no rows; rows that repeat a doc_id count each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.filters import KeyFilter
from corvane.llm.words import grams, hashed, mix
from corvane.llm.workspace import Workspace

#: Bytes of text in a shard; the scale of scores; parts that the best of a language are first taken in.
SHARD, SCALE, SALTS = 16 << 20, 2_000_000, 64
DEPTH = 4
#: What ends a piece, and what stands between words of a piece.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
NODES = "lang string, phrase string, depth int, n long"


class Shard:
    """The words of some texts, in byte order, and which of them follow each other in a piece."""

    def __init__(self, texts: bytes):
        data = _LOWER[np.frombuffer(texts, np.uint8)]
        inside = _INSIDE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(_ENDS[data])[start] if len(start) else start
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
        coded = raw.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        self.words = coded.dictionary.take(order)
        self.id = rank[np.asarray(coded.indices)] if len(start) else np.zeros(0, np.int64)
        self.next = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        """A mixing hash of each word of the dictionary."""
        return hashed(self.words)

    def level(self, parent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By place, whether a phrase of so many words of one piece starts there that parent (-1: not counted) knows, and its parent and last word as one number."""
        n = max(0, len(self.id) - depth + 1)
        whole = np.ones(n, bool)
        for i in range(depth - 1):
            whole &= self.next[i : i + n]
        whole &= parent[:n] >= 0
        return whole, parent[:n] * len(self.words) + self.id[depth - 1 : depth - 1 + n]

    def trie(self, first: int, last: int, wanted=None):
        """Depth, phrases in byte order and counts of each level from first to last; wanted: by place, whether the pair there may be counted."""
        node, phrases = self.id, self.words
        if first == 1 and len(self.id):
            yield 1, phrases, np.bincount(node, minlength=len(phrases))
        for depth in range(2, last + 1):
            whole, key = self.level(node, depth)
            if wanted is not None:
                whole &= wanted[depth - 2 : depth - 2 + len(whole)]
            place = np.flatnonzero(whole)
            if not len(place):
                return
            held, at, n = np.unique(key[place], return_inverse=True, return_counts=True)
            parent, word = np.divmod(held, len(self.words))
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(parent)), self.words.take(pa.array(word)), pa.scalar(b" ", pa.large_binary()))
            if depth >= first:
                yield depth, phrases, n
            node = np.full(len(whole), -1, np.int64)
            node[place] = at


def pair_hashes(hashes: np.ndarray, lang: str) -> np.ndarray:
    """A hash of each pair of neighbours in a run of word hashes, by language."""
    own = hashed(pa.array([lang.encode()], pa.large_binary()))[0]
    return mix(grams(hashes, 2) ^ own) if len(hashes) > 1 else np.zeros(0, np.uint64)


def _shards(first: int, last: int, test=None):
    """Sorted tries of shards as rows; the root of a shard, a phrase of no word, counts all its words."""

    def rows(lang: str, texts: list[bytes]):
        shard = Shard(b"\n".join(texts))  # a line's end ends a piece, so texts stay apart
        wanted = None
        if test is not None:
            wanted = test(pair_hashes(shard.hashes()[shard.id], lang)) if len(shard.id) else np.zeros(0, bool)
        levels = [(0, pa.array([b""], pa.large_binary()), np.array([len(shard.id)]))] if first == 1 else []
        for depth, phrases, n in [*levels, *shard.trie(first, last, wanted)]:
            for at in range(0, len(n), 50_000):
                some = phrases.slice(at, 50_000)
                k = len(some)
                text = pa.StringArray.from_buffers(k, *_string(some)) if k else pa.array([], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), text, pa.array(np.full(k, depth, np.int32)), pa.array(n[at : at + k].astype(np.int64))], ["lang", "phrase", "depth", "n"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                if raw is None or not raw.size:
                    continue
                for part in _parts(raw.to_pybytes()):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= SHARD:
                        for k, v in held.items():
                            yield from rows(k, v)
                        held, size = {}, 0
        for k, v in held.items():
            yield from rows(k, v)

    return run


def _string(values: pa.Array) -> tuple[pa.Buffer, pa.Buffer]:
    """Offsets and bytes of a slice of large binaries, as those of a string array."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return pa.py_buffer((offsets - offsets[0]).astype(np.int32)), data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _parts(text: bytes):
    """A text in parts of about a shard, cut where a piece ends; a longer piece stays whole."""
    at = 0
    while len(text) - at > SHARD:
        window = np.frombuffer(text, np.uint8, offset=at + SHARD)
        cut = next((at + SHARD + x + int(np.flatnonzero(some)[0]) for x in range(0, len(window), 1 << 20) if (some := _ENDS[window[x : x + (1 << 20)]]).any()), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _merged(space: Workspace, shards: DataFrame, least: int, name: str) -> DataFrame:
    """Nodes of the merged trie that are frequent, and roots."""
    ranges = space.keep(shards, f"{name}-shards").repartitionByRange("lang", "phrase")
    merged = ranges.groupBy("lang", "phrase", "depth").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("depth") == 0))
    merged = space.keep(merged.sortWithinPartitions("lang", "phrase"), name)
    space.drop(f"{name}-shards")
    return merged


def counts(docs: DataFrame, least: int, space: Workspace) -> DataFrame:
    """lang, phrase, depth and n of every phrase of up to four words that occurs `least` times, and of roots (depth 0), which count all words."""
    docs = _text(docs)
    short = _merged(space, docs.mapInArrow(_shards(1, 2), NODES), least, "short")

    def hashes(batches):
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                phrases = batch.filter(pc.equal(batch.column(0), lang)).column(1)
                words = pc.split_pattern(phrases, " ").flatten()  # two of each phrase
                yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(hashed(words.cast(pa.large_binary())), lang)[::2].view(np.int64))], ["pair"])

    pairs = space.keep(short.where("depth = 2").select("lang", "phrase").mapInArrow(hashes, "pair long"), "pairs")
    frequent = KeyFilter(pairs, "pair", hashed=True)
    long = _merged(space, docs.mapInArrow(_shards(3, DEPTH, frequent.test()), NODES), least, "long")
    return short.unionByName(long)


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases; docs have text and lang.

    a, l, r: how often the phrase, its left and its right part occur, at the cut of the lowest score, floor(2000000 a / (l + r)); n: the language's words.
    """
    space = Workspace(docs.sparkSession, "collocations")
    nodes = counts(docs, least, space)
    found = nodes.where("depth >= 2").withColumn("words", F.split("phrase", " "))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    # A candidate's count as part of the phrases of one more word.
    outer = found.where("depth > 2").select("lang", "n", F.explode(F.array(part(F.lit(1), F.col("depth") - 1), part(F.lit(2), F.col("depth") - 1))).alias("phrase"))
    outer = outer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    cuts = found.select("lang", "phrase", "n", "depth", "words", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("depth") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(nodes.where("depth > 0").select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side]).drop(side)
    score = F.expr(f"(cast(a as decimal(19,0)) * {SCALE}BD) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    hidden = F.col("longer").isNotNull() & (_exact(F.col("longer")) * 100 >= _exact(F.col("a")) * percent)
    kept = lowest.join(outer, ["lang", "phrase"], "left").where(~hidden)
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    roots = nodes.where("depth = 0").select("lang", F.col("n").alias("n"))
    return best.join(roots, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

