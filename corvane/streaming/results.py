"""Fold results as they arrive: the batch aggregates, kept up by Structured Streaming.

The library's batch operators need whole tables; what can be kept up with a stream are additive aggregates, and those are here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.results import fold_aggregates


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet fold results of a folder, new files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def kept_up(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """fold_aggregates() of a stream, for output mode complete or update."""
    return fold_aggregates(rows, by, metrics)


def drained(aggregates: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what is there, write the aggregates so far to a Parquet table, and stop; the next call goes on from there."""
    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(target)

    query = aggregates.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
