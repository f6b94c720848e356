"""A session with the settings the library expects; on a cluster, pass your own."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "corvane", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of one Arrow batch at most.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that the session hands to Python at once, from now on: plans are lazy, so the setting has to stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.match(r"(\d+)b?$", spark.conf.get(name).lower())
    if not found or not 0 < int(found[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where none is set and all tasks run in the driver (tests), one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
