"""Alignment of two tokenizers over a corpus, by a dictionary of token groups.

*Groups.*  The byte offsets where tokens of both tokenizers end cut a text's tokens into groups, each some A ids beside the B ids of the same bytes.
Two tokens are linked if they end at the same byte; inside a group that is its last A and its last B token.
*Dictionary.*  A block of documents interns its groups: it writes each distinct one once, with its frequency, and the documents as references.
The distinct groups of all blocks are summed by key, expanded to links once each, and a pair's count is the sum of the frequencies of its groups.
Counts go back to the blocks by group key.  A key has one row a block at most, so no key is hot, and what a block gets back is bounded by the block.

Texts are cut before each blank that follows a visible character, which tokens of neither tokenizer cross; so a task encodes a
distinct stretch once and remembers it.  A vocabulary for which this isn't so is noticed when it is loaded, and whole texts are encoded.

Defined cases: a text that is null or empty, or whose tokens' bytes don't give it back (U+2581 reads as a blank), has no tokens: zeros, and an
empty digest; special tokens' strings are plain text; rows that repeat a doc_id, and rows without one, stay rows of their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.workspace import Workspace

#: Characters of text in a block; characters of a stretch from which on the quick encoder isn't asked.
BLOCK, LONG = 1 << 20, 64
CUT = re.compile(r"(?<=[\x21-\x7e\w]) (?!\Z)")
#: A blank at which a text isn't cut.
WHOLE = re.compile(r"[^\x21-\x7e\w] |\A | \Z")
BLOCKS = "block long, documents array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,groups_sha256:string>>, refs binary, dictionary array<struct<key:string,n:long>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: visible Latin-1 ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Two loaded tokenizers, and how their tokens of many texts are grouped."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x[0-9A-F]{2}>")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte.fullmatch(p) else p.replace("▁", " ").encode() for p in names]
        self.a_bytes = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.kind = np.uint16 if max(len(self.a_bytes), len(names)) <= 1 << 16 else np.uint32
        told = json.loads(self.a.to_str())
        before, model = told["pre_tokenizer"] or {}, told["model"]
        level = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.separable = level and not any(re.search("[^▁]▁", p) for p in names)
        # Where ids come in the order of merges, as here, ranks say all: a faster encoder for short stretches.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.quick = None
        if level and [model["vocab"]["".join(m)] for m in merges] == [*range(256, 256 + len(merges))] and not model.get("ignore_merges"):
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t}, special_tokens={}).encode_ordinary

    def cut(self, text: str) -> list[str]:
        if not self.separable:
            return [text]
        return CUT.split(text) if WHOLE.search(text) else text.split(" ")

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.quick(" " + t) if self.quick and len(t) <= LONG else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        return a, self.b.encode(texts, num_threads=1) if texts else []

    def grouped(self, texts: list[str]) -> Groups:
        """The groups of stretches, each with a blank before it.  One whose tokens' bytes don't give it back has none."""
        a, b = self._encoded(texts)
        whole, each = " ".join(["", *texts]).encode(), list(range(len(texts)))
        if b"".join([self.a_bytes[i] for x in a for i in x]) != whole or b"".join([self.b_bytes[i] for x in b for i in x]) != whole:
            each = [n for n, t in enumerate(texts) if b"".join([self.a_bytes[i] for i in a[n]]) == (" " + t).encode() == b"".join([self.b_bytes[i] for i in b[n]])]
            a, b = [a[n] for n in each], [b[n] for n in each]
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        ends = [np.cumsum(size[f]) for f, size in zip(flat, (self.a_size, self.b_size), strict=True)]
        count = np.zeros((2, len(texts)), np.int64)
        count[:, each] = [[len(x) for x in a], [len(x) for x in b]]
        place = np.searchsorted(ends[1], ends[0])
        cut = ends[1][np.minimum(place, len(ends[1]) - 1)] == ends[0] if len(ends[0]) else np.zeros(0, bool)
        last = [np.flatnonzero(cut) + 1, place[cut] + 1]  # of each group, among either's tokens
        first = [np.concatenate(([0], x))[: len(x)] for x in last]
        number, keys = self._interned(flat, first, last)
        stops = np.searchsorted(last[0], np.cumsum(count[0]), "right")  # groups up to the end of each stretch
        return Groups(keys, number, np.concatenate(([0], stops)), count, np.isin(np.arange(len(texts)), each))

    def _interned(self, flat: list[np.ndarray], first: list[np.ndarray], last: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
        """A number for each group, and the distinct groups as text; groups of one shape are compared as runs of ids."""
        sizes = [b - a for a, b in zip(first, last, strict=True)]
        number, keys = np.zeros(len(sizes[0]), np.int64), []
        shape = sizes[0] << 32 | sizes[1]
        for own in np.unique(shape).tolist():
            m, n = own >> 32, own & 0xFFFFFFFF
            rows = np.flatnonzero(shape == own)
            ids = np.concatenate([flat[x][first[x][rows, None] + np.arange(w)] for x, w in ((0, m), (1, n))], axis=1).astype(self.kind)
            _, at, place = np.unique(ids.view(np.dtype((np.void, ids.itemsize * (m + n)))).ravel() if ids.itemsize * (m + n) > 8 else _packed(ids), return_index=True, return_inverse=True)
            number[rows] = place + len(keys)
            keys += [f"{','.join(map(str, r[:m]))}|{','.join(map(str, r[m:]))}" for r in ids[at].tolist()]
        return number, keys


def _packed(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint64)
    for x in ids.T:
        out = out << np.uint64(8 * ids.itemsize) | x.astype(np.uint64)
    return out


class Groups:
    """Distinct groups (keys), the groups of stretches by number (from first[i] to first[i + 1]), A and B tokens of each, and whether it has any."""

    def __init__(self, keys: list[str], number: np.ndarray, first: np.ndarray, count: np.ndarray, good: np.ndarray):
        self.keys, self.number, self.first, self.count, self.good = keys, number, first, count, good

    def texts(self) -> list[str]:
        names = [self.keys[i] for i in self.number.tolist()]
        return [";".join(names[a:b]) for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group numbers of a run of stretches, and how many groups there are up to each."""
        size = np.diff(self.first)[stretches]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.number[np.repeat(self.first[stretches] - stop + size, size) + np.arange(total)], np.concatenate(([0], stop))


@lru_cache(maxsize=2)
def aligner(byte_bpe: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pieces)


def _blocks(byte_bpe: str, pieces: str, by_document: bool):
    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        own = aligner(byte_bpe, pieces)
        cut = [own.cut(t) if t else [] for _, t in rows]
        known: dict[str, int] = {}  # the block's stretches
        place = np.array([known.setdefault(s, len(known)) for c in cut for s in c], np.int64)
        groups = own.grouped(list(known))
        ends = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        bad = np.concatenate(([0], np.cumsum(~groups.good[place])))
        good = (np.diff(ends) > 0) & (bad[ends[1:]] == bad[ends[:-1]])
        place = place[np.repeat(good, np.diff(ends))]  # stretches of texts that have tokens
        ends = np.concatenate(([0], np.cumsum(np.where(good, np.diff(ends), 0))))
        refs, stop = groups.of(place)
        texts = groups.texts()
        sums = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(groups.count[:, place], axis=1)), axis=1)
        sums = sums[:, ends[1:]] - sums[:, ends[:-1]]
        sizes, spans = stop[ends[1:]] - stop[ends[:-1]], zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        order = place.tolist()
        digests = [hashlib.sha256(";".join([texts[x] for x in order[a:b]]).encode()).hexdigest() if b > a else "" for a, b in spans]
        documents = list(zip([r[0] for r in rows], *sums.tolist(), sizes.tolist(), digests, strict=True))
        n = np.bincount(refs, minlength=len(groups.keys))
        if by_document:
            parts = [np.unique(refs[a:b]) for a, b in zip(stop[ends[:-1]].tolist(), stop[ends[1:]].tolist(), strict=True)]
            n = np.bincount(np.concatenate(parts) if parts else refs, minlength=len(groups.keys))
        held = np.flatnonzero(n)  # not those of texts that have no tokens after all
        renumbered = np.zeros(len(groups.keys), np.int64)
        renumbered[held] = np.arange(len(held))
        keys, place, n = groups.keys, renumbered[refs], n[held]
        rows = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), zip(*documents, strict=True), strict=True))
        rows = pa.StructArray.from_arrays([pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in rows.items()], list(rows))
        entries = pa.StructArray.from_arrays([pa.array([keys[x] for x in held.tolist()], pa.string()), pa.array(n, pa.int64())], ["key", "n"])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, entries)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], pa.array([place.astype("<u2" if len(held) <= 1 << 16 else "<u4").tobytes()], pa.binary()), lists[1]], ["block", "documents", "refs", "dictionary"])

    def run(batches):
        from pyspark import TaskContext

        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                rows.append((doc_id, text))
                size += 64 + len(text or "")
                if size >= BLOCK:
                    yield block(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block(number, rows)

    return run


def _summed(batches):
    """Documents of blocks with what the counts of their groups sum up to."""
    for batch in batches:
        for documents, refs, counts in zip(batch.column("documents"), batch.column("refs"), batch.column("counts"), strict=True):
            rows = pa.RecordBatch.from_struct_array(documents.values)
            ends = np.concatenate(([0], np.cumsum(np.asarray(rows.column("n_groups")))))
            raw, total = refs.as_buffer(), np.zeros((2, 0), np.int64)
            refs = np.frombuffer(raw, "<u2" if raw.size == 2 * ends[-1] else "<u4")
            if counts.values is not None and len(counts.values):
                pos, count, best = (np.asarray(counts.values.field(k)).astype(np.int64) for k in ("pos", "count", "best"))
                total = np.zeros((2, len(pos)), np.int64)
                total[:, pos] = best, count
            sums = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(total[:, refs], axis=1)), axis=1)
            best, count = sums[:, ends[1:]] - sums[:, ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), pa.array(best), pa.array(count), rows.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


class Alignment:
    """Blocks, dictionary and links of documents (doc_id, text), encoded by a byte-level BPE (JSON) and a piece model with byte fallback.

    Both paths must be readable where tasks run.  by="documents" counts a group once a document that holds it in place of once an occurrence.
    """

    def __init__(self, docs: DataFrame, byte_bpe: str, pieces: str, by: str = "occurrences"):
        if by not in ("occurrences", "documents"):
            raise ValueError(f"by is occurrences or documents, not {by}")
        self.space = Workspace(docs.sparkSession, "alignment")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.blocks = self.space.keep(texts.mapInArrow(_blocks(byte_bpe, pieces, by == "documents"), BLOCKS), "blocks")
        self.entries = self.blocks.select("block", F.posexplode("dictionary").alias("pos", "entry")).select("block", "pos", "entry.key", "entry.n")
        last = lambda side: F.element_at(F.split(F.split("key", r"\|")[side], ","), -1).cast("int")
        self.links = self.space.keep(self.entries.groupBy("key").agg(F.sum("n").alias("n")).select("key", "n", last(0).alias("a"), last(1).alias("b")), "groups")

    def pairs(self) -> DataFrame:
        """a, b, count and best (none of b's pairs has a higher count) of each pair of linked ids."""
        pairs = self.space.keep(self.links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
        most = pairs.groupBy("b").agg(F.max("count").alias("most"))
        return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
        valued = self.links.join(self.pairs(), ["a", "b"]).select("key", "count", "best")
        back = self.entries.join(valued, "key").groupBy("block").agg(F.collect_list(F.struct("pos", "count", "best")).alias("counts"))
        return self.blocks.drop("dictionary").join(back, "block", "left").select("documents", "refs", "counts").mapInArrow(_summed, RESULT)
