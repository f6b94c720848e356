"""What stands out in deltas and rankings: outliers, enrichment, overlaps, paired comparisons with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import keys, stats


def outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows strictly beyond 1.5 interquartile ranges of their group's quartiles, with bounds and outlier_type (high or low)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    edge = df.groupBy(*by).agg(q.alias("q")).select(*by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    edge = edge.withColumns({"lower_bound": F.col("q1") - reach, "upper_bound": F.col("q3") + reach})
    kind = F.when(F.col(value) > F.col("upper_bound"), "high").when(F.col(value) < F.col("lower_bound"), "low")
    return df.join(edge, by).withColumn("outlier_type", kind).where("outlier_type is not null")


def positive_outliers(found: DataFrame, by: list[str], value: str, baseline: str) -> DataFrame:
    """High outliers above zero in each group, and how many of them start from a baseline of zero."""
    high = (F.col("outlier_type") == "high") & (F.col(value) > 0)
    return found.groupBy(*by).agg(F.count_if(high).alias("n_positive"), F.count_if(high & stats.is_close(F.col(baseline), 0.0)).alias("n_zero_baseline"))


def enrichment(ranking: DataFrame, features: list[str], top: int, rank: str = "rank_by_lowest_loss") -> DataFrame:
    """How often each feature value is among the top ranks, against all ranks: counts, fractions and their ratio."""
    features = keys.existing(ranking, features)
    ranked = ranking.where(F.col(rank).isNotNull())
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit("nan")).alias("value")) for f in features)))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias(f"{name}_count"))

    first = ranked.orderBy(F.col(rank).asc(), *features).limit(top)  # each task offers its first few
    total = ranked.agg(F.count("*").alias("n_all"))
    out = counts(first, "top").join(counts(ranked, "all"), ["feature", "value"], "left").crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"top_fraction": stats.ratio(F.col("top_count"), F.least(F.col("n_all"), F.lit(top))), "all_fraction": stats.ratio(F.col("all_count"), F.col("n_all"))})
    return out.withColumn("enrichment", stats.ratio(F.col("top_fraction"), F.col("all_fraction"))).drop("n_all")


def enrichment_share(ranking: DataFrame, features: list[str], fraction: float, least: int = 5, rank: str = "rank_by_lowest_loss") -> DataFrame:
    """enrichment() of the top fraction, rounded up, of the ranked rows, at least `least`."""
    n = ranking.where(F.col(rank).isNotNull()).count()
    return enrichment(ranking, features, stats.nearest_rank_count(n, fraction, least), rank)


def venn3(df: DataFrame, key: str, a: Column, b: Column, c: Column) -> DataFrame:
    """Keys in each region of three sets, named by the sets they are in."""
    flags = df.groupBy(key).agg(*(F.bool_or(F.coalesce(x, F.lit(False))).alias(n) for n, x in zip("abc", (a, b, c), strict=True)))
    region = F.concat(*(F.when(F.col(n), n.upper()).otherwise("") for n in "abc")).alias("region")
    return flags.groupBy(region).agg(F.count("*").alias("n")).where("region <> ''")


def bootstrap(values: np.ndarray, statistic: Callable = np.mean, n_boot: int = 2000, ci: float = 95, seed: int = 123) -> tuple[float, float]:
    """A percentile interval of a statistic; of one value the value twice, of none NaN."""
    values = values[~np.isnan(values)]
    if len(values) < 2:
        return (float(values[0]), float(values[0])) if len(values) else (float("nan"), float("nan"))
    rng = np.random.default_rng(seed)
    found = np.array([statistic(values[rng.integers(0, len(values), len(values))]) for _ in range(n_boot)])
    low = (100 - ci) / 2
    return tuple(np.percentile(found, [low, 100 - low]))


#: What draws are made of: a prime, and shares of rows that a resample has at most 0, 1, 2 .. times (Poisson of mean 1).
PRIME = 2147483647
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]
#: Groups whose sums a task holds at once, and draws made at once.
GROUPS, DRAWS = 256, 1 << 19


def draw_key(columns: list[str]) -> Column:
    """A number of 52 bits for the values of some columns."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def draws(keys: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is in each resample: by whole numbers that SQL has too."""
    a = ((keys % PRIME)[:, None] + resamples * 69621 % PRIME + seed * 40692) % PRIME
    b = (a * a + 3 * a + 7) % PRIME
    c = (b * 16807 + (keys // PRIME)[:, None]) % PRIME
    d = (c * c + 5 * c + 11) % PRIME
    return np.searchsorted(np.array(POISSON), (d * 48271 % PRIME) / PRIME, "right")


def bootstrap_ci(df: DataFrame, by: list[str], value: str, n_boot: int = 2000, ci: float = 95, seed: int = 123, statistic: Callable = np.mean, key: list[str] = ()) -> DataFrame:
    """by, n, estimate, low, high of the mean, where key names a row in its group: resamples hold a row as often as a hash of key and resample
    says, so tasks sum rows where they are, and no group has to be in one.  Without a key a group is one task's, which any statistic may be asked of."""
    types, by = dict(df.dtypes), list(by)
    if key and statistic is not np.mean:
        raise ValueError("draws by key give means")
    if not key:

        def run(own, frame):
            x = frame[value].to_numpy(float)
            low, high = bootstrap(x, statistic, n_boot, ci, seed)
            x = x[~np.isnan(x)]
            return pd.DataFrame([(*own, len(x), float(statistic(x)) if len(x) else None, low, high)])

        return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{b} {types[b]}" for b in by), "n long, estimate double, low double, high double"]))

    resamples = np.arange(n_boot)

    def sums(frames):
        def rows(held):
            named = {b: pd.Series([None if pd.isna(own[i]) else own[i] for own in held], dtype=object) for i, b in enumerate(by)}
            yield pd.DataFrame({**named, "w": [w for w, _ in held.values()], "x": [x for _, x in held.values()]})

        held: dict[tuple, list] = {}
        for frame in frames:
            for own, part in frame.groupby(by, dropna=False):
                w, x = held.setdefault(own, [np.zeros(n_boot), np.zeros(n_boot)])
                keys, values = part["_key"].to_numpy(np.int64), part["_x"].to_numpy(float)
                for at in range(0, len(keys), max(1, DRAWS // n_boot)):
                    times = draws(keys[at : at + max(1, DRAWS // n_boot)], resamples, seed)
                    w += times.sum(axis=0)
                    x += values[at : at + len(times)] @ times
                if len(held) >= GROUPS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, draw_key(list(key)).alias("_key"), F.col(value).cast("double").alias("_x"))
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "w array<double>, x array<double>"])
    each = rows.mapInPandas(sums, schema).select(*by, F.posexplode(F.arrays_zip("w", "x")).alias("i", "z")).groupBy(*by, "i").agg(F.sum("z.w").alias("w"), F.sum("z.x").alias("x"))
    low = (100 - ci) / 200
    found = each.where("w > 0").groupBy(*by).agg(F.percentile(F.col("x") / F.col("w"), F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    known = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("estimate"))
    same = F.lit(True)
    for b in by:
        same = same & known[b].eqNullSafe(found[b])
    out = known.join(found, same, "left").select(*(known[b] for b in by), "n", "estimate", "q")
    one = F.col("n") < 2  # of one value the value twice
    return out.select(*by, "n", "estimate", F.when(one, F.col("estimate")).otherwise(F.col("q")[0]).alias("low"), F.when(one, F.col("estimate")).otherwise(F.col("q")[1]).alias("high"))


def pair_differences(df: DataFrame, config: str, units: list[str], metric: str, configs: DataFrame) -> DataFrame:
    """first, second (by rank), the units both have, and the difference of their means there; configs: config, rank."""
    each = df.join(configs, config, "left_semi").groupBy(config, *units).agg(F.avg(metric).alias("m")).join(configs, config)
    one = each.select(*units, F.col(config).alias("first"), F.col("rank").alias("r1"), F.col("m").alias("m1"))
    two = each.select(*units, F.col(config).alias("second"), F.col("rank").alias("r2"), F.col("m").alias("m2"))
    return one.join(two, units).where("r1 < r2").withColumn("difference", F.col("m1") - F.col("m2")).drop("m1", "m2")


def pair_means(differences: DataFrame) -> DataFrame:
    """n, mean, median and deviation (0 for one) of each pair's differences, and whether the first is higher."""
    x = F.col("difference")
    out = differences.groupBy("first", "second").agg(F.count(x).alias("n_pairs"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))
    return out.where("n_pairs > 0").withColumn("first_higher", F.col("mean") > 0)


def compared_pairs(differences: DataFrame, n_boot: int = 2000, ci: float = 95, seed: int = 123, key: list[str] = ()) -> DataFrame:
    """pair_means() with the bootstrap interval of each mean, and whether it holds zero; key: the units of a pair's differences, by which they are drawn."""
    found = bootstrap_ci(differences, ["first", "second"], "difference", n_boot, ci, seed, key=key).select("first", "second", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    return pair_means(differences).join(found, ["first", "second"]).withColumn("ci_crosses_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
