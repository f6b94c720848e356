"""Words and word hashes of Arrow text columns, a few hundred kilobytes of bytes at a time.

Texts stay UTF-8 bytes: both word rules of the operators name ASCII separators only, so a byte table
decides what belongs to a word and no text is ever cut inside a character.  A word's hash takes its bytes
eight at a time, each time through a mixing bijection of 64 bits, so no structure of words makes them
collide; a long word's is the XXH3 hash of its bytes.  Runs of words are hashed as trees of such mixes.  Blocks end
at separators, so memory is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK = 1 << 19
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 64
_SIZE, _LEFT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: The bytes of a lane that belong to a word with so many bytes left.
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rule:
    """Which bytes make words, and what each byte is read as."""

    def __init__(self, word_bytes: np.ndarray, lower: bool):
        self.inside = word_bytes
        self.lower = np.arange(256, dtype=np.uint8)
        if lower:
            self.lower[65:91] += 32


def _spaces() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def _alnum() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        inside[a:b] = True
    return inside


#: Runs of anything but blank, tab, and the line separators, unchanged; the same with A-Z lower-cased;
#: runs of letters, digits and everything beyond ASCII, lower-cased.
PLAIN, FOLDED, ALNUM = Rule(_spaces(), False), Rule(_spaces(), True), Rule(_alnum(), True)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word; data has eight bytes more than its last word."""
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = end - start
    h, at, left, rows = mix(size.astype(U64) * _SIZE), start, size, None
    while len(at):
        if rows is None:
            h = mix(h ^ (lanes[at] & _LANE[np.minimum(left, 8)]))
        else:
            h[rows] = mix(h[rows] ^ (lanes[at] & _LANE[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG_WORD) if rows is None else left > 8)
        rows, at, left = more if rows is None else rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def hashed(values: pa.LargeBinaryArray) -> np.ndarray:
    """The hash of each of some words, which stand side by side."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, U64)
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    read = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(read) > 8:
        read[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return _hashes(read, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _block(data: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of a block; no word crosses one of bounds (sorted inner offsets)."""
    inside = rule.inside[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[bounds[bounds < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[bounds[(bounds > 0) & (bounds <= len(data))] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    read = np.empty(len(data) + 8, np.uint8)
    np.take(rule.lower, data, out=read[:-8])
    read[-8:] = 0
    return start, end, _hashes(read, start, end)


def words(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of the texts data[offsets[i]:offsets[i + 1]], and the first word of each text."""
    base, parts = int(offsets[0]), []
    at, stop = base, int(offsets[-1])
    while at < stop:
        to = min(at + BLOCK, stop)
        if to < stop:  # end at a separator or a text's end; a word longer than a block makes the block longer
            cut = np.flatnonzero(~rule.inside[data[at:to]])
            edge = offsets[np.searchsorted(offsets, to, "right") - 1]
            back = max(at + int(cut[-1]) + 1 if len(cut) else at, int(edge))
            while back <= at and to < stop:
                nxt = min(to + BLOCK, stop)
                ahead = np.flatnonzero(~rule.inside[data[to:nxt]])
                back, to = (to + int(ahead[0]) + 1, nxt) if len(ahead) else (at, nxt)
            to = back if back > at else stop
        lo, hi = np.searchsorted(offsets, [at, to])
        start, end, h = _block(data[at:to], offsets[lo : hi + 1] - at, rule)
        parts.append((start + at, end + at, h))
        at = to
    if len(parts) == 1:
        start, end, h = parts[0]
    else:
        start, end, h = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i == 2 else np.int64) for i in range(3))
    return start, end, h, np.searchsorted(start, offsets)


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The given words, one space between them."""
    raw = data.tobytes() if len(start) > 64 else data
    return b" ".join([bytes(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _LEFT + b)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by its first word; runs may cross texts, which the caller masks.

    Runs of powers of two words are pairs of halves; n words are pairs of those that n is the sum of.
    """
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out, at, width, level = None, 0, 1, h
    while width <= n:
        if n & width:
            part = level[at : at + count]
            out = part if out is None else _pair(out, part)
            at += width
        if 2 * width <= n:
            level = _pair(level[:-width], level[width:])
        width *= 2
    return mix(out + U64(n))


class Words:
    """The words of texts as one run of bytes, a blank after each, to digest runs of them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        buffer = np.full(int(self.at[-1]), 0x20, np.uint8)
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        buffer[place] = data[place + np.repeat(start - self.at[:-1], size)]
        self.bytes = buffer.tobytes()

    def of(self, first: int, last: int) -> bytes:
        return self.bytes[self.at[first] : self.at[last] - 1]

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests, as two numbers, of the bytes of the words first to last (exclusive)."""
        raw, digest = memoryview(self.bytes), xxhash.xxh3_128_digest
        spans = zip(self.at[first].tolist(), (self.at[last] - 1).tolist(), strict=True)
        both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()
