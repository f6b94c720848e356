"""Redundancy reduction: which rows stand for others at a threshold, and what is left.

Two reducers that must not be confused: *one pass* drops a row if any earlier row is close; *greedy* drops a row only if an earlier row
that is itself kept is close.  Greedy is the sequential rule; here ranges of keys are decided in order, each by one task, as far as the earlier rows
of other ranges are decided, and rounds go on with the pairs whose earlier row is open.

Values are similarities unless a caller says that they are distances; the closest is the greatest of the ones, the least of the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as reduce_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corvane.functions import stats
from corvane.operators import geometry, neighbourhood


def one_pass(close: DataFrame, distance: bool = False) -> DataFrame:
    """removed_id, representative_id (its closest earlier row, ties to the smaller id), cluster_id of close pairs (key_a < key_b, value)."""
    apart = F.round("value", 9) * (1 if distance else -1)
    out = close.groupBy(F.col("key_b").alias("removed_id")).agg(F.min(F.struct(apart.alias("v"), F.col("key_a").alias("k"))).alias("b"))
    return out.select("removed_id", F.col("b.k").alias("representative_id"), F.col("b.k").alias("cluster_id"))


#: Pairs of a range of keys; rows that are decided by one task at once; rows that the number of close pairs is judged by; and close pairs a row that may stand in a table.
RANGE, FIRST, JUDGED, DEGREE = 1 << 19, 8192, 4096, 32


def _decided(frame: pd.DataFrame) -> pd.DataFrame:
    """key and kept (1 or 0) of the later rows of a range's pairs, as far as they follow from what is known of the earlier ones (1, 0, or -1: not known)."""
    frame = frame.sort_values("key_b", kind="stable")
    state: dict = {}
    now, kept, sure = None, 1, True
    for a, b, known in zip(frame["key_a"].tolist(), frame["key_b"].tolist(), frame["known"].tolist(), strict=True):
        if b != now:
            if now is not None and (sure or not kept):
                state[now] = kept
            now, kept, sure = b, 1, True
        own = known if known >= 0 else state.get(a, -1)
        if own == 1:
            kept = 0
        elif own < 0:
            sure = False
    if now is not None and (sure or not kept):
        state[now] = kept
    return pd.DataFrame({"key": pd.Series(list(state), dtype=frame["key_b"].dtype), "kept": pd.Series(list(state.values()), dtype="int32")})


def greedy(close: DataFrame, keep: Callable[[DataFrame], DataFrame], distance: bool = False) -> DataFrame:
    """The same columns by the greedy rule; keep writes a table and returns it, to cut lineage each round (DataFrame.checkpoint does).

    A round decides the first open range at least; rounds are as many as decisions hang on one another across ranges.
    """
    edges = keep(close.select("key_a", "key_b", "value"))
    kind, ranges = dict(edges.dtypes)["key_a"], max(1, -(-edges.count() // RANGE))
    open_ = keep(edges.select("key_a", "key_b").repartitionByRange(ranges, "key_b").withColumn("range", F.spark_partition_id()))
    later = open_.select(F.col("key_b").alias("key")).distinct()
    new = keep(open_.select(F.col("key_a").alias("key")).distinct().join(later, "key", "left_anti").withColumn("kept", F.lit(1)))  # rows without an earlier one stay
    parts = []
    while open_.limit(1).count():
        known = open_.join(new.select(F.col("key").alias("key_a"), F.col("kept").alias("known")), "key_a", "left").fillna(-1, ["known"])
        new = keep(known.groupBy("range").applyInPandas(lambda f: _decided(f), f"key {kind}, kept int"))
        parts.append(new)
        # What is removed decides nothing more; a row that is open has no earlier one that is known to stay.
        left = known.where("known = -1").join(new.select(F.col("key").alias("key_b")), "key_b", "left_anti")
        open_ = keep(left.select("key_a", "key_b", "range"))
    if not parts:
        return one_pass(edges, distance)
    gone = reduce_left(DataFrame.unionByName, parts).where("kept = 0").select("key")
    kept = edges.join(gone.withColumnRenamed("key", "key_b"), "key_b", "left_semi").join(gone.withColumnRenamed("key", "key_a"), "key_a", "left_anti")
    return one_pass(kept, distance)


def _first_kept(key: str, vector: str, limit: float, metric: str):
    """Of batches of rows by rising key, those that the greedy rule keeps."""
    within = (lambda v: v >= limit) if metric == "cosine" else (lambda v: v <= limit)

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not len(table):
            return
        order = pc.sort_indices(table.column(key))
        table = table.take(order)
        items = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in (key, vector)], ["key", "v"])
        side = geometry._side(items, metric, [])
        alive = np.ones(len(table), bool)
        for at in range(0, len(table), geometry.STRIP):
            here = slice(at, at + geometry.STRIP)
            close = within(geometry.values(side, side, metric, here, here))
            for i in range(len(close)):  # a strip row by row, then what it keeps against all later rows
                if alive[at + i]:
                    alive[at + i + 1 : at + len(close)] &= ~close[i, i + 1 :]
            lead = at + np.flatnonzero(alive[here])
            for to in range(at + geometry.STRIP, len(table), geometry.WIDE):
                there = slice(to, to + geometry.WIDE)
                alive[there] &= ~within(geometry.values(side, side, metric, lead, there)).any(axis=0)
        yield from table.filter(pa.array(alive)).to_batches()

    return run


def few_close(df: DataFrame, key: str, vector: str, limit: float, metric: str = "cosine") -> bool:
    """Whether rows have DEGREE close pairs each at most, judged by those of some."""
    n, some = df.count(), df.orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(JUDGED)
    close = geometry.pair_thresholds(some, key, vector, [limit], metric, metric == "cosine").first()["n_pairs"]
    return close * (n / min(n, JUDGED)) ** 2 <= DEGREE * n if n else True


def greedy_of(df: DataFrame, key: str, vector: str, limit: float, keep: Callable[[DataFrame], DataFrame], metric: str = "cosine") -> DataFrame:
    """greedy() of all rows by their vectors, without a table of close pairs where there are many.

    While the rows that are left may have more than DEGREE close pairs each, the first FIRST of them by key are decided by one task, and what is close to a kept one goes;
    rows are left that are far from all of those.  Where few pairs are close they stand in a table, and greedy() decides.  Work is of rows times kept rows, or of all pairs once.
    """
    rows = geometry.taking_part(df, vector).select(key, vector)
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    rest, leads = keep(rows), None
    while n := rest.count():
        if n > FIRST and few_close(rest, key, vector, limit, metric):
            break
        first = rest.orderBy(key).limit(FIRST)
        kept = keep(first.coalesce(1).mapInArrow(_first_kept(key, vector, limit, metric), kind))
        leads = kept if leads is None else leads.unionByName(kept)
        if n <= FIRST:
            rest = rest.limit(0)
            break
        last = first.agg(F.max(key)).first()[0]
        later = rest.where(F.col(key) > F.lit(last))
        gone = geometry.closest_earlier(later, key, vector, limit, metric, leads=kept).select(F.col("removed_id").alias(key))
        rest = keep(later.join(gone, key, "left_anti"))
    else:
        rest = rest.limit(0)
    if leads is None:
        return greedy(neighbourhood.close_pairs(rest, key, vector, limit, metric), keep, metric != "cosine")
    if rest.limit(1).count():
        own = greedy(neighbourhood.close_pairs(rest, key, vector, limit, metric), keep, metric != "cosine")
        leads = keep(leads.unionByName(rest.join(own.select(F.col("removed_id").alias(key)), key, "left_anti")))
    gone = rows.join(leads.select(key), key, "left_anti")
    return _map(geometry.closest_earlier(gone, key, vector, limit, metric, leads=leads))


def one_pass_of(df: DataFrame, key: str, vector: str, limit: float, metric: str = "cosine") -> DataFrame:
    """one_pass() of all rows by their vectors, without a table of close pairs."""
    return _map(geometry.closest_earlier(df, key, vector, limit, metric))


def _map(found: DataFrame) -> DataFrame:
    return found.select("removed_id", "representative_id", F.col("representative_id").alias("cluster_id"))


def reduction_ladder(df: DataFrame, key: str, vector: str, label: str, ladder: list[tuple[float, float]], keep: Callable[[DataFrame], DataFrame], metric: str = "cosine", rule: str = "greedy", labels: list[int] = (0, 1)) -> tuple[DataFrame, DataFrame]:
    """Reductions at each (percentile, threshold) of a ladder.

    Returns the maps (percentile, removed_id, representative_id, cluster_id) and the summary, a row a percentile.  Thresholds of
    distances may not grow with the percentile, those of similarities not fall.
    """
    distance, ladder = metric != "cosine", sorted(ladder)
    limits = [t for _, t in ladder]
    if len({p for p, _ in ladder}) < len(ladder):
        raise ValueError("percentiles repeat")
    if distance and min(limits) < 0 or limits != sorted(limits, reverse=distance):
        raise ValueError("distance thresholds may not be negative nor grow with the percentile" if distance else "similarity thresholds may not fall with the percentile")
    maps, summaries = [], []
    for percent, limit in ladder:
        removed = greedy_of(df, key, vector, limit, keep, metric) if rule == "greedy" else one_pass_of(df, key, vector, limit, metric)
        removed = keep(removed.select(F.lit(percent).alias("percentile"), "*"))
        maps.append(removed)
        summaries.append(retention(df, removed, key, label, labels).select(F.lit(percent).alias("percentile"), F.lit(float(limit)).alias("threshold"), "*"))
    return reduce_left(DataFrame.unionByName, maps), reduce_left(DataFrame.unionByName, summaries)


def retained(df: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Rows of df that the map doesn't remove."""
    return df.join(removed.select(F.col("removed_id").alias(key)), key, "left_anti")


def retention(df: DataFrame, removed: DataFrame, key: str, label: str, labels: list[int] = (0, 1)) -> DataFrame:
    """n_original, n_reduced, removed, kept_fraction and n_<label> of what is kept, from one pass over df."""
    gone = removed.select(F.col("removed_id").alias(key), F.lit(True).alias("_gone"))  # ids, one row each
    kept = F.col("_gone").isNull()
    out = df.join(gone, key, "left").agg(F.count("*").alias("n_original"), F.count_if(kept).alias("n_reduced"), *(F.count_if(kept & (F.col(label) == x)).alias(f"n_{x}") for x in labels))
    return out.withColumns({"removed": F.col("n_original") - F.col("n_reduced"), "kept_fraction": stats.ratio(F.col("n_reduced"), F.col("n_original"))})


def retention_ladder(close: DataFrame, df: DataFrame, key: str, limits: list[float], at_least: bool = True) -> DataFrame:
    """One-pass retention at each threshold from one table of close pairs: a row goes from its closest earlier row on."""
    return ladder_of(close.groupBy(F.col("key_b").alias("removed_id")).agg((F.max if at_least else F.min)("value").alias("value")), df, key, limits, at_least)


def ladder_of(closest: DataFrame, df: DataFrame, key: str, limits: list[float], at_least: bool = True) -> DataFrame:
    """retention_ladder() from each row's closest earlier one (removed_id, value)."""
    best = closest.select(F.col("removed_id").alias(key), F.col("value").alias("near"))
    gone = [F.count_if(F.round("near", 9) >= t) if at_least else F.count_if(F.round("near", 9) <= t) for t in limits]
    out = df.select(key).join(best, key, "left").agg(F.count("*").alias("n_original"), F.array(*gone).alias("n"), F.array(*(F.lit(float(t)) for t in limits)).alias("t"))
    out = out.select("n_original", F.explode(F.arrays_zip("t", "n")).alias("z")).select(F.col("z.t").alias("threshold"), "n_original", (F.col("n_original") - F.col("z.n")).alias("n_reduced"))
    return out.withColumns({"removed": F.col("n_original") - F.col("n_reduced"), "kept_fraction": stats.ratio(F.col("n_reduced"), F.col("n_original"))})


def label_retention(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Counts of each label before and after, 0 where one side lacks it, and the percentage kept."""
    one = before.groupBy(label).agg(F.count("*").alias("n_before"))
    two = after.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n_after"))
    out = one.join(two, F.col(label).eqNullSafe(F.col("_label")), "full_outer").select(F.coalesce(label, "_label").alias(label), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_before", "n_after")))
    return out.withColumn("retained_pct", stats.ratio(F.col("n_after") * 100, F.col("n_before")))


def matched_reduction(df: DataFrame, key: str, vector: str, target: int, low: float, high: float, keep: Callable[[DataFrame], DataFrame], metric: str = "cosine", within: int = 15, steps: int = 16) -> tuple[float, DataFrame, DataFrame]:
    """The greedy reduction between two thresholds that leaves nearest to target rows: its threshold, its map, and the history of tries.

    Pairs stand in a table only from a threshold on that calls few of them close; that table serves the narrower tries.
    """
    distance, n = metric != "cosine", df.count()
    tables: list[tuple[float, DataFrame]] = []

    def at(limit: float) -> DataFrame:
        wider = [(t, close) for t, close in tables if (t >= limit if distance else t <= limit)]
        if not wider and few_close(df, key, vector, limit, metric):
            wider = [(limit, keep(neighbourhood.close_pairs(df, key, vector, limit, metric)))]
            tables.extend(wider)
        if not wider:
            return greedy_of(df, key, vector, limit, keep, metric)
        close = wider[-1][1]
        return greedy(close.where(F.col("value") <= limit if distance else F.col("value") >= limit), keep, distance)

    # What is left grows with a limit on similarities and shrinks with one on distances.
    limit, history = matched_threshold(lambda x: n - at(-x if distance else x).count(), *((-high, -low) if distance else (low, high)), target, within, steps)
    history = [h | {"threshold": -h["threshold"] if distance else h["threshold"]} for h in history]
    found = df.sparkSession.createDataFrame([tuple(h.values()) for h in history], "iteration int, threshold double, n_retained long, difference long")
    limit = -limit if distance else limit
    return limit, keep(at(limit)), found


def checked_map(removed: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A reduction map, or an error: ids and representatives are known, none is removed twice, no representative is removed, clusters are named."""
    known = ids.select(F.col(key).alias("_id"))
    gone, lead = removed.select(F.col("removed_id").alias("_id")), removed.select(F.col("representative_id").alias("_id"))
    wrong = {
        "removed twice": gone.groupBy("_id").count().where("count > 1"),
        "of unknown ids": gone.unionByName(lead).join(known, "_id", "left_anti"),
        "with removed representatives": lead.join(gone, "_id", "left_semi"),
        "without a cluster": removed.where("cluster_id is null or representative_id is null or removed_id is null"),
    }
    for what, rows in wrong.items():
        if found := rows.limit(3).collect():
            raise ValueError(f"rows {what}: {found}")
    return removed


def homology_rows(removed: DataFrame, df: DataFrame, key: str, label: str, identity: str = "min_seq_id", labels: list[int] = (0, 1)) -> DataFrame:
    """A summary row of each identity threshold of a table of maps (identity, removed_id): counts before and after, of each label too."""
    limits = removed.select(identity).distinct()
    total = df.agg(F.count("*").alias("n_original"), *(F.count_if(F.col(label) == y).alias(f"all_{y}") for y in labels))
    gone = removed.select(identity, F.col("removed_id").alias(key)).distinct().join(df.select(key, label), key)
    gone = gone.groupBy(identity).agg(F.count("*").alias("removed"), *(F.count_if(F.col(label) == y).alias(f"gone_{y}") for y in labels))
    out = limits.join(gone, identity, "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    kept = F.col("n_original") - F.col("removed")
    return out.select(identity, "n_original", kept.alias("n_reduced"), "removed", stats.ratio(kept, F.col("n_original")).alias("kept_fraction"), *((F.col(f"all_{y}") - F.col(f"gone_{y}")).alias(f"n_{y}") for y in labels))


def matched_threshold(count_at: Callable[[float], int], low: float, high: float, target: int, within: int = 15, steps: int = 16) -> tuple[float, list[dict]]:
    """The threshold between low and high whose count is nearest to target, by bisection; and its history, nearest first.

    The count is taken to grow with the threshold where two tries differ; the best try counts, as a step may miss.
    """
    history: list[dict] = []
    for step in range(steps):
        at = (low + high) / 2
        n = count_at(at)
        history.append({"iteration": step + 1, "threshold": at, "n_retained": n, "difference": abs(n - target)})
        if abs(n - target) <= within:
            break
        low, high = (at, high) if n < target else (low, at)
    history.sort(key=lambda h: (h["difference"], h["iteration"]))
    return history[0]["threshold"], history
