"""From source tables to one labelled table: repeats, consensus of sources, quality control, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import naming, stats
from corvane.session import checkpointed

ABSENT = 999


def grouped_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row a key: its number of rows, of different labels (null counts as one), and the sorted labels."""
    kinds = F.count_distinct(label) + F.when(F.count_if(F.col(label).isNull()) > 0, 1).otherwise(0)
    return df.groupBy(key).agg(F.count("*").alias("n_duplicates"), kinds.alias("n_labels"), F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("labels"), F.max(label).alias(label))


def repeated_texts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Texts of several rows, their number and labels: long keys are grouped by a 128-bit digest, and only repeated ones are dealt out."""
    df = df.select(text, label, F.md5(F.col(text).cast("binary")).alias("_digest"))
    many = df.groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_digest").alias("_many"))
    again = df.join(many, F.col("_digest").eqNullSafe(F.col("_many")), "left_semi")
    return grouped_labels(again, text, label).where("n_duplicates > 1")


def duplicates(df: DataFrame, key: str, label: str, without_null: bool = False) -> dict[str, DataFrame]:
    """Keys repeated with one label (consistent), with several (conflicts), and keys of one row (unique), from one grouping.

    A null label is a label, unless rows without one are left out before.
    """
    one = grouped_labels(df.where(F.col(label).isNotNull()) if without_null else df, key, label)
    again = one.where("n_duplicates > 1")
    return {
        "consistent": again.where("n_labels = 1").select(key, label, "n_duplicates"),
        "conflicts": again.where("n_labels > 1").select(key, "labels", "n_duplicates"),
        "unique": one.where("n_duplicates = 1").select(key, label),
    }


def source_pivot(df: DataFrame, key: str, source: str, label: str, order: str, sources: list[str], absent: int | None = ABSENT) -> DataFrame:
    """One column a source with its first label by `order`, `absent` where it has none."""
    wide = df.groupBy(key).pivot(source, sources).agg(F.min_by(label, F.when(F.col(label).isNotNull(), F.col(order))))
    return wide.fillna(absent, sources) if absent is not None else wide


def votes(df: DataFrame, key: str, source: str, label: str, order: str) -> DataFrame:
    """Per key how many sources say 0 and 1, by each source's first label, without a wide table between."""
    first = df.where(F.col(label).isNotNull()).groupBy(key, source).agg(F.min_by(label, order).alias("vote"))
    out = first.groupBy(key).agg(F.count_if(F.col("vote") == 0).alias("count_0"), F.count_if(F.col("vote") == 1).alias("count_1"))
    out = out.withColumn("n_valid_sources", F.col("count_0") + F.col("count_1"))
    return out.withColumns({f"count_{i}_norm": stats.ratio(F.col(f"count_{i}"), F.col("n_valid_sources")) for i in (0, 1)})


def consensus(counted: DataFrame) -> DataFrame:
    """Votes with label: 1 or 0 where all sources that say anything agree, else null (a conflict)."""
    return counted.withColumn("label", F.when(F.col("count_1") == F.col("n_valid_sources"), 1).when(F.col("count_0") == F.col("n_valid_sources"), 0)).where("n_valid_sources > 0")


def quality_control(df: DataFrame, sequence: str, pattern: Column | None = None, least: int = naming.MIN_LENGTH, most: int = naming.MAX_LENGTH) -> DataFrame:
    """df with length, is_canon, is_in_length and passes."""
    s = F.col(sequence)
    canon = pattern if pattern is not None else naming.canonical(s)
    return df.withColumns({"length": F.length(s), "is_canon": canon, "is_in_length": naming.in_length(s, least, most)}).withColumn("passes", F.col("is_canon") & F.col("is_in_length"))


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with its rows' numbers (from 1) by a total order; ranges are sorted apart and joined by their sizes, so no task sees all rows.

    The offsets of ranges are one small row a partition.  Ranges are drawn from a sample, so they are checkpointed: both sides of the
    join must see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def sequential_ids(df: DataFrame, order: list, prefix: str = "") -> DataFrame:
    """id seq_1, seq_2 .. by a total order."""
    tag = f"seq_{prefix}_" if prefix else "seq_"
    return numbered(df, order, "_number").withColumn("id", F.concat(F.lit(tag), F.col("_number").cast("string"))).drop("_number")


def support_subsets(df: DataFrame, n_sources: str) -> DataFrame:
    """Each row once for each subset of support that it belongs to (tag: all, single, multi, high)."""
    n = F.col(n_sources)
    tags = F.array(F.lit("all"), F.when(n == 1, "single"), F.when(n >= 2, "multi"), F.when(n >= 3, "high"))
    return df.withColumn("tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def support_counts(df: DataFrame, n_sources: str) -> DataFrame:
    """Rows of each support group, in order, none left out."""
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(naming.SUPPORT_ORDER)), "position int, support_group string")
    counts = df.groupBy(naming.support_group(F.col(n_sources)).alias("support_group")).agg(F.count("*").alias("n"))
    return order.join(counts, "support_group", "left").select("position", "support_group", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def support_summary(df: DataFrame, n_sources: str) -> DataFrame:
    """Rows of one source, of two or more, and of three or more (high), with their percentages."""
    n = F.col(n_sources)
    out = df.agg(F.count("*").alias("n_total"), F.count_if(n == 1).alias("n_single"), F.count_if(n >= 2).alias("n_multi"), F.count_if(n >= 3).alias("n_high"))
    return out.withColumns({f"pct_{k}": F.coalesce(stats.ratio(F.col(f"n_{k}") * 100, F.col("n_total")), F.lit(0.0)) for k in ("single", "multi", "high")})


def class_balance(df: DataFrame, group: Column | str, label: str) -> DataFrame:
    """Rows of each class in each group and their percentages; 0 where a group is empty."""
    out = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("n_1"), F.count_if(F.col(label) == 0).alias("n_0"))
    total = F.col("n_1") + F.col("n_0")
    return out.withColumns({f"pct_{i}": F.coalesce(stats.ratio(F.col(f"n_{i}") * 100, total), F.lit(0.0)) for i in (1, 0)})


def dataset_metadata(df: DataFrame, sequence: str, label: str) -> DataFrame:
    s = F.length(sequence)
    return df.agg(F.count("*").alias("n_total"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label).isNull()).alias("n_conflict"), F.min(s).alias("min_length"), F.max(s).alias("max_length"))


def recovered_labels(df: DataFrame, original: DataFrame, label: str, on: list[str], order: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df with its labels, or if it has no column of them, those of the original by the first of the `on` columns that both have; and
    how many rows have none (n_rows, n_missing).

    An original that repeats a key gives the label of its first row by order (all columns, if none is given).
    """
    if label not in df.columns:
        key = next((c for c in on if c in df.columns and c in original.columns), None)
        if key is None:
            raise ValueError(f"no column {label}, and none of {', '.join(on)} to recover it by")
        along = F.struct(*(F.col(c) for c in order or [c for c, t in original.dtypes if not t.startswith("map")]))
        known = original.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(label), along).alias("_known"))
        df = df.join(known, key, "left").withColumn(label, F.col(f"_known.{label}")).drop("_known")
    return df, df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(label).isNull()).alias("n_missing"))


def materialized(source: DataFrame, features: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key (the first by order) with its features; where both sides have a column, the source's value unless it is null."""
    first = source.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    shared = [c for c in features.columns if c in source.columns and c != key]
    joined = first.join(features.withColumnsRenamed({c: f"_{c}" for c in shared}), key)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in shared}).drop(*(f"_{c}" for c in shared))


def mapped_by_name(df: DataFrame, names: DataFrame, column: str, name: str, value: str, output: str, order: str) -> DataFrame:
    """df with value looked up by a trimmed, case-free name; a name listed several times gives its last value by order, null or not."""
    low = names.groupBy(F.lower(F.trim(name)).alias("_name")).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    low = low.select("_name", F.col("_last.v").alias(output))
    return df.withColumn("_name", F.lower(F.trim(column))).join(low, "_name", "left").drop("_name")


def mapping_report(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_total"), F.count(column).alias("n_mapped")).withColumn("pct_mapped", F.coalesce(stats.ratio(F.col("n_mapped") * 100, F.col("n_total")), F.lit(0.0)))
