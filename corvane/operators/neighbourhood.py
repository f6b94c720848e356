"""Close pairs of vectors without comparing all: cells around centroids, and only cells that can hold a close pair meet.

Centroids are taken from a bounded sample.  A vector lies in the cell of its nearest centroid; a cell's radius is the greatest distance in it.  Two vectors at most
`limit` apart, of cells one and two, satisfy that the first is at most the second cell's radius plus limit from the second cell's centroid.  So a
vector visits the later cells for which that holds and no others: no close pair is lost, whatever the centroids.  Cosine is served by the distance of unit vectors.

Cells of many vectors are cut into groups of bounded size, and pairs of groups are compared by a task each.  Where nothing can be told apart (far
neighbours of scattered vectors) all cells would be visited: visits are counted first, and beyond VISITS a vector the tiles of geometry.pairs() compare all pairs,
as a vector then travels less.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corvane.functions import vectors
from corvane.operators import geometry
from corvane.session import checkpointed, small_batches

#: Vectors that centroids are learned from, centroids at most, turns of learning, vectors of a group, and what rounding may add to a distance.
SAMPLE, CELLS, TURNS, GROUP, SLACK = 8192, 512, 5, 1024, 1e-7
#: Visits a vector beyond which all pairs are compared.
VISITS = 32


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def centroids(x: np.ndarray, n: int) -> np.ndarray:
    """n points of x that lie far from one another, then moved to the means of what is nearest to them."""
    at, far = [0], np.full(len(x), np.inf)
    while len(at) < n:
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        at.append(int(far.argmax()))
    out = x[at].copy()
    for _ in range(TURNS):
        own = _apart(x, out).argmin(axis=1)
        count = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], out)
    return out


def _items(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), vectors.doubles(F.col(vector)).alias("v"))


class Cells(NamedTuple):
    """Vectors in their cells (key, v, cell): how many, the sizes of cells, and which cells a batch of vectors visits."""

    rows: DataFrame
    n: int
    sizes: dict[int, int]
    visited: Callable

    def visits(self) -> int:
        """Visits of all vectors."""
        visited = self.visited

        def count(batches):
            for batch in batches:
                if len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([len(visited(batch)[0])])], ["n"])

        return self.rows.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def cells(df: DataFrame, key: str, vector: str, metric: str, limit: float) -> Cells | None:
    """The vectors of df in cells; None for an empty table."""
    rows = _items(geometry.taking_part(df, vector), key, vector)
    n, turn = rows.count(), _unit if metric == "cosine" else (lambda v: v)
    if not n:
        return None
    apart = float(np.sqrt(max(2 - 2 * limit, 0))) if metric == "cosine" else float(limit)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toPandas()
    points = centroids(turn(np.stack(sample["v"].to_list())), max(1, min(CELLS, int(np.sqrt(n)))))
    kind = dict(rows.dtypes)["key"]

    def placed(batches):
        for batch in batches:
            if len(batch):
                far = _apart(turn(np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)), points)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["key", "v", "cell", "far"])

    rows = checkpointed(rows.mapInArrow(placed, f"key {kind}, v array<double>, cell int, far double"))
    found = {r["cell"]: (r["n"], r["far"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # CELLS at most
    reach = np.array([found[c][1] if c in found else -np.inf for c in range(len(points))]) + apart + SLACK

    def visited(batch):
        far = _apart(turn(np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)), points)
        own = np.asarray(batch.column(2))
        return np.nonzero((far <= reach) & (np.arange(len(points)) > own[:, None]))

    return Cells(rows, n, {c: m for c, (m, _) in found.items()}, visited)


def meetings(df: DataFrame, key: str, vector: str, metric: str, limit: float) -> DataFrame | None:
    """Groups of vectors that have to be compared: items_a, items_b (key, v) and whether they are one group; None for an empty table."""
    held = cells(df, key, vector, metric, limit)
    return held and _met(held)


def _met(held: Cells) -> DataFrame:
    rows, n, visited = held.rows, held.n, held.visited
    kind = dict(rows.dtypes)["key"]
    small_batches(rows.sparkSession)

    def visits(batches):
        for batch in batches:
            if not len(batch):
                continue
            row, cell = visited(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["key", "v", "cell"])

    item = F.struct("key", "v")
    sizes = F.create_map(*(x for c, m in held.sizes.items() for x in (F.lit(c), F.lit(-(-m // GROUP)))))
    homes = rows.select("cell", item.alias("item"), F.pmod(F.xxhash64("key"), sizes[F.col("cell")]).alias("part"))
    homes = checkpointed(homes.groupBy("cell", "part").agg(F.array_sort(F.collect_list("item")).alias("items")))
    asked = rows.mapInArrow(visits, f"key {kind}, v array<double>, cell int")
    # A cell has as many visitors as there are; they come in groups as large as those at home, by a hash over enough numbers.
    room = max(1, -(-n // GROUP))
    asked = asked.groupBy("cell", F.pmod(F.xxhash64("key"), F.lit(room)).alias("part")).agg(F.collect_list(F.struct("key", "v")).alias("items_b"))
    one = homes.select("cell", F.col("part").alias("part_a"), F.col("items").alias("items_a"))
    two = homes.select("cell", F.col("part").alias("part_b"), F.col("items").alias("items_b"))
    inside = one.join(two, "cell").where("part_a <= part_b").select("items_a", "items_b", (F.col("part_a") == F.col("part_b")).alias("same"))
    across = one.join(asked, "cell").select("items_a", "items_b", F.lit(False).alias("same"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inside.unionByName(across).repartition(tasks)


def close_pairs(df: DataFrame, key: str, vector: str, limit: float, metric: str = "cosine") -> DataFrame:
    """key_a < key_b and value of all pairs whose cosine is limit or more, or (metric euclidean) whose distance is limit or less; equal to geometry.pairs with where."""
    kind = dict(df.dtypes)[key]
    schema, held = f"key_a {kind}, key_b {kind}, value double", cells(df, key, vector, metric, limit)
    if held is None:
        return df.sparkSession.createDataFrame([], schema)
    if held.visits() > VISITS * held.n:
        return geometry.pairs(df, key, vector, metric, where=(">=" if metric == "cosine" else "<=", limit))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (geometry._side(batch.column(c)[r].values, metric, []) for c in ("items_a", "items_b"))
                same = batch.column("same")[r].as_py()
                for at, to, value in geometry.strips(a, b, metric, same):
                    ok = value >= limit if metric == "cosine" else value <= limit
                    if same and (above := geometry._above(at, to, value.shape)) is not None:
                        ok &= above
                    i, j = np.nonzero(ok)
                    one, two = a.keys.take(pa.array(i + at)), b.keys.take(pa.array(j + to))
                    swap = pc.greater(one, two)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(value[i, j])], ["key_a", "key_b", "value"])

    return _met(held).mapInArrow(run, schema)
