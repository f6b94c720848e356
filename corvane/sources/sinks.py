"""Writing tables, and small documents beside them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] = ()) -> None:
    df.write.mode(mode).option("header", "true").partitionBy(*by).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_aligned(df: DataFrame, path: str) -> None:
    """Append to a Parquet table in its own columns and types; columns that df lacks are null, others are left out."""
    target = df.sparkSession.read.parquet(path).schema
    empty = df.sparkSession.createDataFrame([], target)
    empty.unionByName(df, allowMissingColumns=True).select(*(f.name for f in target)).write.mode("append").parquet(path)


def write_named(df: DataFrame, folder: str, name: str) -> None:
    """Rows as CSV files below a folder, each under the path that its rows have in the column name; a task writes a file, and only then is it there by its name."""
    from urllib.parse import unquote

    spark, aside = df.sparkSession, f"{folder.rstrip('/')}/_writing"
    df.repartition(name).write.mode("overwrite").option("header", "true").partitionBy(name).csv(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own in files.listStatus(path(aside)):
        if own.isDirectory():
            target = path(f"{folder.rstrip('/')}/{unquote(own.getPath().getName().split('=', 1)[1])}")
            parts = [x.getPath() for x in files.listStatus(own.getPath()) if x.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise ValueError(f"{target} has {len(parts)} parts")
            files.mkdirs(target.getParent())
            files.delete(target, False)
            files.rename(parts[0], target)
    files.delete(path(aside), True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as one readable file, in any file system that Spark knows."""
    write_text(spark, json.dumps(document, indent=2, ensure_ascii=False, sort_keys=True), path)


def write_parameters(spark: SparkSession, document: dict, path: str) -> None:
    """Parameters as YAML, in their order; where no YAML writer is at hand, as JSON, which YAML readers read too."""
    try:
        import yaml

        text = yaml.safe_dump(document, sort_keys=False, allow_unicode=True)
    except ImportError:
        text = json.dumps(document, indent=2, ensure_ascii=False)
    write_text(spark, text, path)


def mark_done(spark: SparkSession, folder: str, name: str = "DONE", document: dict | None = None) -> str:
    """Leave a marker that a run is complete; its path."""
    path = f"{folder.rstrip('/')}/{name}"
    write_text(spark, json.dumps(document or {}, sort_keys=True, default=str), path)
    return path


def write_splits(assigned: DataFrame, status: DataFrame, path: str, by: list[str]) -> None:
    """Assignments as Parquet, a folder each of by below one of the run, without those of splits that status doesn't call kept; status goes beside them.

    Only splits that status names are replaced, and by writing status last: until then, and if a run fails before, read_splits() gives what was there.
    What earlier runs wrote of those splits is removed at the end.
    """
    spark, run = assigned.sparkSession, uuid.uuid4().hex
    kept = status.groupBy(*by).agg(F.min((F.col("status") == "kept").cast("int")).alias("_ok")).where("_ok = 1").drop("_ok")
    assigned.join(kept, by, "left_semi").write.partitionBy(*by).parquet(f"{path}/assignments/run={run}")
    status.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/status")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for own in status.select(*(F.col(b).cast("string") for b in by)).distinct().collect():  # the splits of a run, not their rows
        folder = "/".join(f"{b}={escaped(v) if v is not None else '__HIVE_DEFAULT_PARTITION__'}" for b, v in zip(by, own, strict=True))
        for old in files.globStatus(at(f"{path}/assignments/run=*/")) or []:
            if old.getPath().getName() != f"run={run}":
                files.delete(at(f"{old.getPath().toString()}/{folder}"), True)


def read_splits(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Assignments of the splits whose last status is kept."""
    status = spark.read.parquet(f"{path}/status").groupBy(*by, "run").agg(F.min((F.col("status") == "kept").cast("int")).alias("_ok")).where("_ok = 1").drop("_ok")
    return spark.read.parquet(f"{path}/assignments").join(status, [*by, "run"], "left_semi").drop("run")


def summary_document(df: DataFrame, limit: int = 1000) -> list[dict]:
    """A small result as plain rows, or an error if it isn't small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    return [r.asDict(recursive=True) for r in rows]


def write_workbook(sheets: dict[str, DataFrame], path: str, limit: int = 100_000, csv: str | None = None, widest: int = 60) -> None:
    """Small results as sheets of one local workbook, with filters and columns as wide as their texts; and beside them, in the folder csv, as CSV.

    Workbooks need a writer of that format (openpyxl) beside pandas; the CSV files are written without it too.
    """
    if csv is not None:
        for name, df in sheets.items():
            write_csv(df.coalesce(1), f"{csv.rstrip('/')}/{name}")
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise RuntimeError("workbooks need openpyxl; write_csv does without") from error
    import pandas as pd

    with pd.ExcelWriter(path) as out:
        for name, df in sheets.items():
            frame = pd.DataFrame(summary_document(df, limit), columns=df.columns)
            frame.to_excel(out, sheet_name=name[:31], index=False)
            sheet = out.sheets[name[:31]]
            sheet.auto_filter.ref = sheet.dimensions
            for cells in sheet.columns:
                sheet.column_dimensions[cells[0].column_letter].width = min(widest, 2 + max(len(str(c.value or "")) for c in cells))
