"""Near-duplicate vectors by cosine, found by lattice hashing.

*Cells.*  A unit vector is projected to BLOCKS times eight random directions and moved by a random offset; each eight coordinates
are decoded to the nearest point of the E8 lattice.  The points of a table's blocks together name a cell.  There are TABLES such tables.
*Probing.*  A vector lies in its home cell, and also probes the PROBES cells beside it that it lies nearest to: one block's point moves
to one of its 240 neighbours in the lattice.  Two vectors meet in a cell that is home to one of them.  Measured on random directions at a cosine
of exactly 0.95, a pair meets in a table with probability 0.32, and in some table with 0.995; at 0.97 it is 0.9999.
Two random vectors share a cell with probability 1e-7, so candidates stay few among very many rows.
*Verification.*  Vectors that meet are compared by cosine in double precision.  A pair that meets in several cells counts in the first only,
which both vectors' cells tell.  Equal vectors (by 128-bit digests of their numbers) are one vector with a weight, and cells of very many vectors are compared in tiles of bounded size
by several tasks; a tile gives each vector its number of links and one link to its group in the tile, so pairs are never written out.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay their own component; vectors of
different lengths never link; components of any finite size are scaled first, so nothing overflows; rows that repeat a vec_id are vectors of
their own (the component is named by the smallest vec_id); a null vec_id takes part in links and names no component unless all are null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvane.llm.filters import KeyFilter
from corvane.llm.graph import components
from corvane.llm.words import mix
from corvane.llm.workspace import Workspace

BLOCKS, SCALE, TABLES, PROBES = 3, 0.5, 14, 4
#: A key's low bits name its table.
TABLE_BITS = 4
#: Vectors of one side of a tile; larger runs of a tile are compared by matrix products; pairs whose cells are compared at once.
TILE, SMALL, PAIRS = 1024, 48, 32768
FOUND, ENTRIES = "row long, n long, root long", "row long, key long, home boolean"


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8, whole numbers with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.argmax(np.abs(off[odd]), axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight numbers: of D8, or of D8 moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.stack(out)


@cache
def _table(width: int, table: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offset, the key's factors and what each neighbour adds to the key, of a table for vectors of a length."""
    rng = np.random.default_rng([seed, width, table])
    turn, offset = rng.normal(size=(width, 8 * BLOCKS)) * SCALE, rng.uniform(0, 2, 8 * BLOCKS)
    factor = rng.integers(0, 1 << 64, 8 * BLOCKS, np.uint64) | np.uint64(1)
    doubled = (2 * neighbours()).astype(np.int64).view(np.uint64)
    add = np.concatenate([(doubled * factor[8 * b : 8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(BLOCKS)])
    return turn, offset, factor, add


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(u: np.ndarray) -> np.ndarray:
    """Keys of each unit vector's cells: by row, table, and home first, then the cells that it probes."""
    out = np.empty((len(u), TABLES, 1 + PROBES), np.uint64)
    last = np.uint64((1 << TABLE_BITS) - 1)
    for t in range(TABLES):
        turn, offset, factor, add = _table(u.shape[1], t)
        place = u @ turn + offset
        point = np.concatenate([decoded(place[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        home = ((2 * point).astype(np.int64).view(np.uint64) * factor).sum(axis=1, dtype=np.uint64)
        near = np.concatenate([(place - point)[:, 8 * b : 8 * b + 8] @ neighbours().T for b in range(BLOCKS)], axis=1)
        beside = np.argpartition(-near, PROBES, axis=1)[:, :PROBES]
        keys = np.concatenate([home[:, None], home[:, None] + add[beside]], axis=1)
        out[:, t] = mix(keys + np.uint64(u.shape[1])) & ~last | np.uint64(t)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _digested(batches):
    """Rows with 128-bit digests of their vectors; zeros have no sign."""
    for batch in batches:
        v = batch.column("v")
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        digests = [None if x is None else xxhash.xxh3_128_digest(np.asarray(x.values, float) + 0.0) for x in (x if x.is_valid else None for x in v)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])


def _entries(wanted):
    """row, key and home of the cells whose key may be wanted."""

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column("cells").flatten())
            place = np.flatnonzero(wanted(keys))
            rows = np.asarray(batch.column("row"))
            yield pa.RecordBatch.from_arrays([pa.array(rows[place // (TABLES * (1 + PROBES))]), pa.array(keys[place]), pa.array(place % (1 + PROBES) == 0)], ["row", "key", "home"])

    return run


def _hashed(batches):
    """Rows with their cells; rows come with any lengths of vectors."""
    for batch in batches:
        size = np.diff(np.asarray(batch.column("v").offsets))
        for width in np.unique(size):
            rows = batch.filter(pa.array(size == width))
            keys = cells(unit(_matrix(rows.column("v")))).view(np.int64).reshape(len(rows), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "cells"])


def _first(own: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the pairs i, j of rows with cells `own` meet in the cell `key` first."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), PAIRS):
        a, b, k = own[i[at : at + PAIRS]], own[j[at : at + PAIRS]], key[at : at + PAIRS]
        in_a, in_b = (a[:, :, :1] == b).any(axis=2), (b[:, :, :1] == a).any(axis=2)  # a's home, b's home, by table
        rows, table = np.arange(len(k)), np.argmax(in_a | in_b, axis=1)
        most = np.uint64(0xFFFFFFFFFFFFFFFF)
        home_a = np.where(in_a[rows, table], a[rows, table, 0], most)
        home_b = np.where(in_b[rows, table], b[rows, table, 0], most)
        out[at : at + PAIRS] = np.minimum(home_a, home_b) == k
    return out


def _pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within the runs first[x] to last[x] (exclusive)."""
    place = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    more = np.repeat(last, last - first) - 1 - place
    i = np.repeat(place, more)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)


def _grouped(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that links lead to, of each of n places."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Tiles:
    """Whole tiles, sorted, as arrays: compared, and summed up by row."""

    def __init__(self, batch: pa.RecordBatch, least: float):
        name = batch.schema.names
        self.col = {c: np.asarray(batch.column(c)) for c in name if c not in ("v", "cells")}
        self.u, self.least = unit(_matrix(batch.column("v"))), least
        self.cells = np.asarray(batch.column("cells").flatten()).view(np.uint64).reshape(len(batch), TABLES, 1 + PROBES)

    def _large(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a large tile that are alike, one stripe of the matrix after the other."""
        found = []
        for x in range(a, b, 256):
            to = min(x + 256, b)
            i, j = np.nonzero(self.u[x:to] @ self.u[x:b].T >= self.least)
            found.append((i[i < j] + x, j[i < j] + x))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def result(self) -> pa.RecordBatch:
        key, p, q = (self.col[c] for c in ("key", "p", "q"))
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new, [len(key)]))
        small, total = last - first <= SMALL, np.zeros(len(key), np.int64)
        links = []
        sizes = (last - first)[small]
        for part in np.array_split(np.arange(len(sizes)), max(1, int((sizes * sizes).sum()) // (1 << 18))):
            i, j = _pairs(first[small][part], last[small][part]) if len(part) else (np.zeros(0, int),) * 2
            links.append((i, j, (self.u[i] * self.u[j]).sum(axis=1) >= self.least))
        for a, b in zip(first[~small].tolist(), last[~small].tolist(), strict=True):
            i, j = self._large(a, b)
            links.append((i, j, np.ones(len(i), bool)))
        kept = []
        for i, j, good in links:
            good &= (self.col["home"][i] | self.col["home"][j]) & ((self.col["own"][i] != self.col["own"][j]) | (p[i] == q[i]))
            i, j = i[good], j[good]
            good = _first(self.cells, i, j, key[i].view(np.uint64))
            kept.append((i[good], j[good]))
        i, j = (np.concatenate([k[x] for k in kept]) for x in (0, 1))
        np.add.at(total, i, self.col["weight"][j])
        np.add.at(total, j, self.col["weight"][i])
        rows, root = np.flatnonzero(total), _grouped(len(key), i, j)
        return pa.RecordBatch.from_arrays([pa.array(self.col["row"][rows]), pa.array(total[rows]), pa.array(self.col["row"][root[rows]])], ["row", "n", "root"])


def _compared(least: float):
    """Compares sorted tiles; a tile that goes on in the next batch waits for it, and vectors of another length are another tile's."""

    def whole(batch: pa.RecordBatch):
        size = np.diff(np.asarray(batch.column("v").offsets))
        for width in np.unique(size):
            yield _Tiles(batch.filter(pa.array(size == width)), least).result()

    def run(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            k = [np.asarray(batch.column(c)) for c in ("key", "p", "q")]
            cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in k], axis=0))
            same = held and all(np.asarray(held[-1].column(c))[-1] == x[0] for c, x in zip(("key", "p", "q"), k, strict=True))
            if held and not same:
                yield from whole(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if len(cut):
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]) + 1)]).combine_chunks().to_batches()[0])
                held, batch = [], batch.slice(int(cut[-1]) + 1)
            held.append(batch)
        if held:
            yield from whole(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def near_duplicates(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows have vec_id and embedding.  Vectors whose cosine is `least` or more are linked, as far as they are found."""
    space = Workspace(rows.sparkSession, "lattice")
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(finite, F.lit(False)), v).alias("v"))
    rows = space.keep(rows.mapInArrow(_digested, "vec_id long, v array<double>, digest binary"), "rows")
    # A vector for all rows that have it; equal ones link with each other.
    distinct = rows.where("digest is not null").groupBy("digest").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id")).withColumn("row", F.monotonically_increasing_id())
    hashed = space.keep(space.keep(distinct, "distinct").mapInArrow(_hashed, "digest binary, v array<double>, weight long, least_id long, row long, cells array<long>"), "vectors")
    # Most cells that are probed are home to none, and most homes are one vector's: bit tables leave those out before entries are dealt out.
    homes = KeyFilter(hashed.select(F.explode(F.expr(f"filter(cells, (x, i) -> i % {1 + PROBES} = 0)")).alias("key")), "key", hashed=True)
    entries = hashed.select("row", "cells").mapInArrow(_entries(homes.test()), ENTRIES)
    met = entries.groupBy("key").agg(F.count("*").alias("size"), F.max("home").alias("any_home")).where("size > 1 and any_home")
    met = space.keep(met.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("sides")), "met")
    entries = hashed.select("row", "cells").mapInArrow(_entries(KeyFilter(met, "key", hashed=True).test()), ENTRIES)
    own = F.pmod(F.xxhash64("row", "key"), F.col("sides")).cast("int")
    entries = entries.join(met, "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    entries = entries.select("row", "key", "home", "own", other.alias("other")).select("row", "key", "home", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    tiles = entries.join(hashed.select("row", "weight", "v", "cells"), "row").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = space.keep(tiles.mapInArrow(_compared(least), FOUND), "found")
    names = components(found, "row", "root", space, "components")
    named = names.withColumnRenamed("node", "row").join(hashed.select("row", "least_id"), "row")
    named = named.select("row", "component").join(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("row", "component_id")
    linked = found.groupBy("row").agg(F.sum("n").alias("n")).join(named, "row")
    known = hashed.select("row", "digest", "weight", "least_id").join(linked, "row", "left")
    known = known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.select("vec_id", "digest").join(known, "digest", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
