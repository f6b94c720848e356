"""Cluster assignments from reduction maps, and how well two clusterings agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corvane.functions import stats


def assignments(ids: DataFrame, removed: DataFrame, method: str, key: str = "id") -> DataFrame:
    """id, method, cluster_id, is_representative: removed rows in their cluster, representatives in theirs, the others alone."""
    gone = removed.select(F.col("removed_id").alias(key), F.col("cluster_id").alias("_own"))
    lead = removed.groupBy(F.col("representative_id").alias(key)).agg(F.min("cluster_id").alias("_led"))
    out = ids.select(key).join(gone, key, "left").join(lead, key, "left")
    return out.select(key, F.lit(method).alias("method"), F.coalesce("_own", "_led", key).alias("cluster_id"), F.col("_own").isNull().alias("is_representative"))


def cluster_stats(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    own = assigned.groupBy(cluster).agg(F.count("*").alias("size"))
    n = F.count("*")
    return own.agg(n.alias("n_clusters"), F.count_if(F.col("size") == 1).alias("n_singletons"), stats.ratio(F.count_if(F.col("size") == 1), n).alias("singleton_fraction"), F.avg("size").alias("mean_size"), F.percentile("size", F.lit(0.5)).alias("median_size"), F.percentile("size", F.lit(0.95)).alias("p95_size"), F.max("size").alias("max_size"))


def agreement(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Pair precision, recall, f1 and Jaccard, adjusted Rand index and normalised mutual information of two cluster columns, from their contingency table."""
    cells = df.groupBy(reference, candidate).agg(F.count("*").alias("c"))
    rows = cells.groupBy(reference).agg(F.sum("c").alias("c"))
    columns = cells.groupBy(candidate).agg(F.sum("c").alias("c"))

    def sums(table: DataFrame, tag: str) -> DataFrame:
        c = F.col("c").cast("double")
        return table.agg(F.sum(stats.pairs_of(F.col("c"))).alias(f"pairs_{tag}"), F.sum("c").alias(f"n_{tag}"), F.sum(c * F.log(c)).alias(f"log_{tag}"))

    one = [sums(t, tag).withColumn("_", F.lit(1)) for t, tag in ((cells, "both"), (rows, "ref"), (columns, "cand"))]
    out = reduce(lambda a, b: a.join(b, "_"), one)  # three tables of one row
    both, ref, cand, n = (F.col(c).cast("double") for c in ("pairs_both", "pairs_ref", "pairs_cand", "n_both"))
    expected = stats.ratio(ref * cand, n * (n - 1) / 2)
    h_ref, h_cand, h_both = (F.log(n) - F.col(f"log_{t}") / n for t in ("ref", "cand", "both"))
    mean = (h_ref + h_cand) / 2
    precision, recall = stats.ratio(both, cand), stats.ratio(both, ref)
    return out.select(
        F.col("pairs_ref").alias("reference_pairs"), F.col("pairs_cand").alias("candidate_pairs"), F.col("pairs_both").alias("shared_pairs"),
        precision.alias("precision"), recall.alias("recall"), stats.ratio(2 * both, ref + cand).alias("f1"), stats.ratio(both, ref + cand - both).alias("jaccard"),
        F.coalesce(stats.ratio(both - expected, (ref + cand) / 2 - expected), F.lit(1.0)).alias("adjusted_rand"),
        F.when(mean < 1e-12, 1.0).otherwise(stats.ratio(h_ref + h_cand - h_both, mean)).alias("normalized_mutual_info"),
    )


def set_jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared and all different keys of two tables, and their ratio."""
    tagged = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = tagged.agg(F.count_if((F.col("a") + F.col("b")) == 2).alias("n_shared"), F.count("*").alias("n_union"))
    return out.withColumn("jaccard", stats.ratio(F.col("n_shared"), F.col("n_union")))
