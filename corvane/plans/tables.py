"""The driver tables, read as the tables that the operators are about; and rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import stats


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fold results: supplier is the seed, line number the configuration, flag the reduction, status the partition."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("seed"), F.col("l_linenumber").alias("cfg"), F.col("l_returnflag").alias("reduction"), F.col("l_linestatus").alias("partition"), F.col("l_discount").alias("val"), F.col("l_tax").alias("test"), F.col("l_orderkey").alias("run"))


FOLD_RESULTS = "SELECT l_suppkey AS seed, l_linenumber AS cfg, l_returnflag AS reduction, l_linestatus AS partition, l_discount AS val, l_tax AS test, l_orderkey AS run FROM lineitem"


def mean_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a configuration, seed, reduction and partition."""
    return fold_results(spark, sf_dir).groupBy("seed", "cfg", "reduction", "partition").agg(F.avg("val").alias("val"), F.avg("test").alias("test"))


MEAN_RESULTS = f"SELECT seed, cfg, reduction, partition, avg(val) AS val, avg(test) AS test FROM ({FOLD_RESULTS}) GROUP BY ALL"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare; zero without a sign."""
    return df.withColumns({c: stats.rounded(F.col(c), digits) for c, t in df.dtypes if t in ("double", "float")})


def r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0::DOUBLE)"
