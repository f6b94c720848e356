"""Approximate nearest neighbours by cosine, by multi-index hashing of learned binary codes.

*Codes.*  A rotation is learned from a bounded sample: principal axes, then iterative quantisation, which turns them so that signs
lose least.  A vector's code is the signs of its turned coordinates, in at most 64 bits.
*Radius.*  The Hamming radius that holds nearly all (KEEP) of the true neighbours of some queries (ASKED), which are compared with every row for that: neighbours among
more rows are nearer, so a radius learned from the sample alone would be too wide.  It is never wider than the sample's.
*Index.*  Codes are cut into PARTS substrings, each with a table from its values to rows.  By the pigeonhole principle a
code within radius r agrees with the query within r // PARTS in some substring (for some parts one less), so probing the values that
near finds every code within r; the whole code's distance then decides, and floats rerank by exact cosine.  The values to probe are enumerated
while they are fewer than the values that a block holds; beyond that, which happens where neighbours are nearly as far as other rows, the held values
are compared instead.

Rows are indexed once, in written blocks of bounded size, each one row of a table.  Queries go round by round, so many that a broadcast of them is
bounded; each block answers a round's queries with its k best within r, and the k best of those are the answer.  Only queries for which all blocks together have fewer than
k rows within r are compared with every row.

Defined cases: a vector that is null, zero, or holds null or non-finite numbers takes no part; vectors of one length are compared with each other, each length with an index of its own; components of
any finite size are scaled by powers of two first; rows that repeat a vec_id are one query, and no candidate of it; a candidate's best row counts; ties go to the smaller vec_id; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm.workspace import Workspace

#: Rows the rotation and radius are learned from; queries of a round; rows of an index block.
SAMPLE, QUERIES, ROWS = 8192, 8192, 16384
#: Queries that are compared with every row to learn the radius.
ASKED = 64
#: Bytes of vectors in a round or an index block, whatever their length.
BYTES = 16 << 20
PARTS, TURNS, KEEP = 4, 40, 0.995
SCHEMA, RESULT = "query_id long, vec_id long, score double, apart int", "query_id long, rank int, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one: nothing overflows, and cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def matrix(column: pa.Array) -> np.ndarray:
    return scaled(np.asarray(column.flatten(), float).reshape(len(column), -1))


class Codes:
    """A learned rotation and the radius that goes with it."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 5):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.bits = min(64, x.shape[1])
        rng = np.random.default_rng(seed)
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        y, turn = x @ axes, np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(TURNS):
            a, _, b = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (a @ b).T
        self.turn = axes @ turn
        ask = x[:512]
        near = ask @ x.T
        near[np.arange(len(ask)), np.arange(len(ask))] = -2
        best = np.argsort(-near, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
        code = self.of(x)
        apart = np.bitwise_count(code[: len(ask), None] ^ code[best]) if len(x) > 1 else np.zeros(1)
        self.radius = int(np.quantile(apart, KEEP, method="higher"))
        edges = np.linspace(0, self.bits, PARTS + 1).astype(int)
        self.parts = [(int(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]

    def of(self, x: np.ndarray) -> np.ndarray:
        signs = (x @ self.turn >= 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def reach(self, part: int) -> int:
        """How far a substring's value may be: some part is that near for every code within the radius."""
        return self.radius // len(self.parts) - (part > self.radius % len(self.parts))


@cache
def ball(bits: int, reach: int) -> np.ndarray:
    """The numbers of so many bits that have at most `reach` ones."""
    x = np.arange(1 << bits, dtype=np.uint64)
    return x[np.bitwise_count(x) <= reach]


class Block:
    """A multi-index of some rows; order: what rows are by each substring, if that is known."""

    def __init__(self, codes: Codes, ids: np.ndarray, v: np.ndarray, order: np.ndarray | None = None):
        self.codes, self.ids, self.v, self.code = codes, ids, v, codes.of(v)
        self.norm = np.sqrt((v * v).sum(axis=1))
        part = [(self.code >> np.uint64(shift)) & mask for shift, mask in codes.parts]
        self.order = order if order is not None else np.stack([np.argsort(x, kind="stable") for x in part]).astype(np.int32)
        self.tables = []
        for (_, mask), x, by in zip(codes.parts, part, self.order, strict=True):
            first = np.zeros(int(mask) + 2, np.int64)  # where the rows of each value begin in by
            np.cumsum(np.bincount(x.astype(np.int64), minlength=int(mask) + 1), out=first[1:])
            self.tables.append((first, np.flatnonzero(np.diff(first)).astype(np.uint64), by))

    def within(self, code: np.uint64) -> np.ndarray:
        """Rows whose code is within the radius, by probing each substring's table."""
        found = []
        for part, ((shift, mask), (first, held, by)) in enumerate(zip(self.codes.parts, self.tables, strict=True)):
            if (reach := self.codes.reach(part)) < 0:
                continue
            own, bits = (code >> np.uint64(shift)) & mask, int(mask).bit_length()
            if sum(comb(bits, i) for i in range(reach + 1)) < len(held):
                at = (ball(bits, reach) ^ own).astype(np.int64)
                at = at[first[at] < first[at + 1]]
            else:
                at = held[np.bitwise_count(held ^ own) <= reach].astype(np.int64)
            count = first[at + 1] - first[at]
            if count.sum():
                found.append(by[np.repeat(first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        rows = np.concatenate(found) if found else np.zeros(0, int)
        rows = rows[np.bitwise_count(self.code[rows] ^ code) <= self.codes.radius]
        return np.unique(rows)

    def nearest(self, query: int, v: np.ndarray, norm: float, code: np.uint64 | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best rows within the radius, fewer if there are fewer; of all rows if there is no code."""
        rows = self.within(code) if code is not None else np.arange(len(self.ids))
        rows = rows[self.ids[rows] != query]
        score = (self.v[rows] * v).sum(axis=1) / (self.norm[rows] * norm)
        order = np.lexsort((self.ids[rows], -score))
        _, once = np.unique(self.ids[rows][order], return_index=True)  # the best row of each id
        best = order[np.sort(once)[:k]]
        return rows[best], score[best]


def _indexed(held):
    """Blocks of rows as bytes: ids, vectors, and the orders of rows by each substring."""

    def run(batches):
        codes = held.value

        def block(parts):
            own = Block(codes, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts]))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.ids, own.v, own.order)], ["ids", "v", "by"])

        parts, n = [], 0
        for batch in batches:
            if len(batch):
                parts.append((np.asarray(batch.column(0)), matrix(batch.column(1))))
                n += len(batch)
            if n >= ROWS or sum(x.nbytes for _, x in parts) >= BYTES:
                yield block(parts)
                parts, n = [], 0
        if n:
            yield block(parts)

    return run


def _search(held, k: int, whole: bool = False):
    """Each block's k best rows of each query, among those within the radius or (whole) all, and how many bits they are away."""

    def run(batches):
        codes, ids, v = held.value
        own_codes, norms = codes.of(v), np.sqrt((v * v).sum(axis=1))
        asked = [None] * len(ids) if whole else own_codes
        for batch in batches:
            for own, vectors, by in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = np.frombuffer(own.as_buffer(), np.int64)
                block = Block(codes, own, np.frombuffer(vectors.as_buffer(), float).reshape(len(own), -1), np.frombuffer(by.as_buffer(), np.int32).reshape(len(codes.parts), -1))
                out = [block.nearest(int(q), x, float(n), c, k) for q, x, n, c in zip(ids, v, norms, asked, strict=True)]
                place = np.concatenate([p for p, _ in out])
                query = np.repeat(np.arange(len(ids)), [len(p) for p, _ in out])
                apart = np.bitwise_count(block.code[place] ^ own_codes[query]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own[place]), pa.array(np.concatenate([s for _, s in out])), pa.array(apart)], ["query_id", "vec_id", "score", "apart"])

    return run


def _best(blocks: DataFrame, codes: Codes, some, k: int, whole: bool) -> DataFrame:
    """The k best of all blocks for some queries (vec_id, v in pandas), as many as a broadcast may hold."""
    query = blocks.sparkSession.sparkContext.broadcast((codes, some["vec_id"].to_numpy(np.int64), scaled(np.stack(some["v"].to_list()))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    part = blocks.mapInArrow(_search(query, k, whole), SCHEMA).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("apart").alias("apart"))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each of queries; both have vec_id and embedding."""
    spark = rows.sparkSession
    space, found = Workspace(spark, "ann"), []
    widths = [r["w"] for r in usable(rows).select(F.size("v").alias("w")).distinct().orderBy("w").collect()]  # as a rule one
    for width in widths:
        found += _of_width(usable(rows).where(F.size("v") == width), usable(queries).where(F.size("v") == width), width, k, space)
    space.only(*(name for name, _ in found))
    out = spark.createDataFrame([], RESULT)
    for at, (_, part) in enumerate(found):
        out = out.unionByName(part) if at else part
    return out


def _of_width(rows: DataFrame, queries: DataFrame, width: int, k: int, space: Workspace) -> list[tuple[str, DataFrame]]:
    """Written results of the queries, round by round."""
    spark, found = rows.sparkSession, []
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).toPandas()
    codes = Codes(scaled(np.stack(sample["v"].to_list())), k)
    blocks = space.keep(rows.mapInArrow(_indexed(spark.sparkContext.broadcast(codes)), "ids binary, v binary, by binary"), f"index-{width}")
    asked = space.keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")), f"queries-{width}")
    few = asked.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(ASKED).toPandas()
    if not len(few):
        return []
    apart = [r["apart"] for r in _best(blocks, codes, few, k, True).select("apart").collect()]  # k of each of ASKED
    if apart:
        codes.radius = min(codes.radius, int(np.quantile(apart, KEEP, method="higher")))
    rounds = -(-asked.count() // max(1, min(QUERIES, BYTES // (8 * width))))
    for i in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == i).toPandas()
        if not len(some):
            continue
        names = [f"found-{width}-{i}", f"whole-{width}-{i}"]
        columns = ["query_id", "rank", "vec_id", "score"]
        part = space.keep(_best(blocks, codes, some, k, False).select(columns), names[0])
        full = {r["query_id"] for r in part.groupBy("query_id").count().where(F.col("count") >= k).select("query_id").collect()}  # of a round's
        short = some[~some["vec_id"].isin(full)]
        if len(short):  # fewer than k rows within the radius anywhere
            known = part.where(~F.col("query_id").isin([int(q) for q in short["vec_id"]]))
            found.append((names[1], space.keep(_best(blocks, codes, short, k, True).select(columns), names[1])))
            part = known
        found.append((names[0], part))
    return found
