"""Sequence files: FASTA in its variants, and sheets of alternating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_fasta(spark: SparkSession, path: str, description: bool = False) -> DataFrame:
    """id, sequence (and description) of each record; files are cut at records, so a large one is read in parallel."""
    lines = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    head = F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), r"^>|\r$", "")
    body = F.regexp_replace(F.regexp_replace(F.col("value"), r"^[^\n]*(\n|$)", ""), r"\s", "")
    out = lines.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), body.alias("sequence"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"))
    return out if description else out.drop("description")


def gene_sequences(records: DataFrame, order: str) -> DataFrame:
    """gene (GN= of the description), sequence: the last record of each gene by `order`."""
    gene = F.regexp_extract("description", r"\bGN=(\S+)", 1)
    return records.withColumn("gene", gene).where("gene <> ''").groupBy("gene").agg(F.max_by("sequence", order).alias("sequence"))


def read_quoted_fasta(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, id, sequence of files whose records begin with a quoted header, each file whole."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).withColumn("path", F.col("_metadata.file_path"))
    parts = files.select("path", F.explode(F.split(F.regexp_replace("value", r'^"?>', ""), r'"?\n"?>')).alias("r"))
    return parts.select("path", F.regexp_replace(F.split_part("r", F.lit("\n"), F.lit(1)), r'["\r]', "").alias("id"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*(\n|$)", ""), r'[\s"]', "").alias("sequence"))


def running_headers(lines: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """id, sequence of lines of a printed FASTA: lines of capital letters belong to the last header above them, in each file."""
    order = Window.partitionBy(file).orderBy(number)
    head = F.when(F.col(text).startswith(">"), F.col(number))
    marked = lines.withColumn("_head", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col(text).rlike("^[A-Z]+$"), F.struct(F.col(number).alias("n"), F.col(text).alias("t"))))), lambda x: x["t"])
    out = marked.where("_head is not null").groupBy(file, "_head").agg(F.max(F.when(F.col(number) == F.col("_head"), F.substr(F.col(text), F.lit(2)))).alias("id"), F.array_join(body, "").alias("sequence"))
    return out.select(file, "id", "sequence")


def alternating(rows: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """id, sequence of sheets whose even rows (from 0) are headers and odd rows the sequences."""
    order = Window.partitionBy(file).orderBy(number)
    return rows.withColumn("sequence", F.lead(text).over(order)).withColumn("_i", F.row_number().over(order) - 1).where("_i % 2 = 0").select(file, F.col(text).alias("id"), "sequence")


# Label rules of source tables.
def last_token(id: Column, separator: str = "|") -> Column:
    return F.split_part(id, F.lit(separator), F.lit(-1))


def label_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def label_by_place(number: Column, positive_until: int) -> Column:
    """1 for the first rows of a file, 0 for the others."""
    return F.when(number < positive_until, 1).otherwise(0)
