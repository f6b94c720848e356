"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.session import shared_folder

#: Rows and bytes of one Arrow batch at most: texts can be long, and a batch stands in memory several times.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what the session hands to Python at once, from now on: plans are lazy, so the setting has to stay."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Workspace:
    """A folder of Parquet tables for one run.  A lost executor costs tasks of the stage at hand, never a table."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _at(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, files = self._at(f"{self.path}/{name}")
        files.delete(path, True)

    def only(self, *names: str) -> None:
        """Drop all tables but these, which a lazy result still reads."""
        path, files = self._at(self.path)
        for status in files.listStatus(path) if files.exists(path) else []:
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)

    def close(self) -> None:
        """Drop the whole folder, once results are read."""
        path, files = self._at(self.path)
        files.delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as make them none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
