"""Source tables by name: what files a source has, how their labels are told, and the labelled table and metadata that come of them.

Each source is a list of pieces; a piece is a reader of records (id, sequence, position, or a sheet's columns) and a rule for the label.
Source files are small and read whole where positions count; their union is judged by one grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.operators import curate
from corvane.sources import sequences, tables

Rule = Callable[[DataFrame], Column]


def always(label: int) -> Rule:
    return lambda df: F.lit(label)


def token(replaced: dict[str, int] | None = None) -> Rule:
    """The last token of an id, or what stands for it."""
    def rule(df: DataFrame) -> Column:
        last = sequences.last_token(F.col("id"))
        out = last.try_cast("int")
        for text, label in (replaced or {}).items():
            out = F.when(last == text, label).otherwise(out)
        return out

    return rule


def places(first: int, last: int | None = None) -> Rule:
    """1 for records at positions first to last (from 0, inclusive; to the end if last is None)."""
    return lambda df: sequences.label_if(F.col("position") >= first if last is None else F.col("position").between(first, last))


def unless(column: str, text: str) -> Rule:
    """0 where a column holds the text, else 1."""
    return lambda df: sequences.label_if(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def not_equal(column: str, text: str) -> Rule:
    return lambda df: sequences.label_if(~F.coalesce(F.col(column) == text, F.lit(False)))


def begins(text: str, or_length: int | None = None) -> Rule:
    """1 for ids that begin with the text, or have so many characters."""
    def rule(df: DataFrame) -> Column:
        fits = F.col("id").startswith(text)
        return sequences.label_if(fits if or_length is None else fits | (F.length("id") == or_length))

    return rule


def numbered_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, position (from 0) of the records of a file, which is read whole."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s*>", "").alias("t"))
    rows = text.select(F.posexplode(F.split("t", r"\n>")).alias("position", "r")).where(F.trim("r") != "")
    head = F.regexp_replace(F.split_part("r", F.lit("\n"), F.lit(1)), r"\r$", "")
    return rows.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*(\n|$)", ""), r"\s", "").alias("sequence"), "position")


def printed_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of text taken from a printed page, whose page feeds go."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\f", "").alias("t"))
    lines = text.select(F.lit(path).alias("file"), F.posexplode(F.split("t", "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\r$", "")))
    return sequences.running_headers(lines, "file", "n", "line").select("id", "sequence")


def quoted_folder(spark: SparkSession, path: str) -> DataFrame:
    return sequences.read_quoted_fasta(spark, path).select("id", "sequence")


def table(column: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    """A delimited table whose column has the sequences."""
    return lambda spark, path: tables.read_table(spark, path, **options).withColumnRenamed(column, "sequence")


def sheet(name: str | None = None, column: str | int = "sequence", header: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """A sheet of a workbook (which needs openpyxl), as text; the column, by name or place, has the sequences; rows of headers (>) go."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        import pandas as pd

        frame = pd.read_excel(path.removeprefix("file://"), sheet_name=name or 0, header=0 if header else None, dtype=str)
        own = frame.columns[column] if isinstance(column, int) else column
        frame = frame.rename(columns={own: "sequence"}).rename(columns=str)
        frame = frame[~frame["sequence"].str.contains(">", na=False)].astype(object).where(lambda x: x.notna(), None)
        return spark.createDataFrame(frame.to_dict("records"), ", ".join(f"`{c}` string" for c in frame.columns))

    return read


def alternating_sheet(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A sheet of one column whose even rows are headers and odd rows sequences."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        import pandas as pd

        column = pd.read_excel(path.removeprefix("file://"), sheet_name=name, header=None, dtype=str)[0]
        lines = spark.createDataFrame([(path, i, None if pd.isna(t) else t) for i, t in enumerate(column)], "file string, n int, line string")
        return sequences.alternating(lines, "file", "n", "line").select("id", "sequence")

    return read


@dataclass
class Piece:
    """A file of a source, how it is read, and the rule of its labels."""

    file: str
    label: Rule
    read: Callable[[SparkSession, str], DataFrame] = field(default=numbered_fasta)


# The files of each source and the places and words that tell their labels.
SOURCES: dict[str, list[Piece]] = {
    "AMPDB v1": [Piece("Antioxidant dataset.tsv", always(1), table(" Sequence"))],
    "ANOX": [Piece("anti_protein_positive_negative.txt", token())],
    "AOD": [Piece("", always(1), quoted_folder)],
    "AOPxSVM": [Piece("AOPP.test.2023.fasta", token({"ANOXI": 0})), Piece("AOPP.test.fasta", token()), Piece("AOPP.train.fasta", token())],
    "Ahmad et al": [Piece("independent dataset.txt", places(392, 464)), Piece("Training_dataset.txt", places(100, 199))],
    "Butt et al": [Piece("1-s2.0-S0022519319301602-mmc1.xlsx", always(1), sheet("Independent-Antioxidants-120", 0, False)), Piece("1-s2.0-S0022519319301602-mmc1.xlsx", always(1), sheet("Training-Antioxidants-250", 0, False)), Piece("1-s2.0-S0022519319301602-mmc1.xlsx", always(0), sheet("Sheet3", 1, False))],
    "Feng et al": [Piece("full_text.txt", begins("antioxidant", 6), printed_fasta)],
    "Lam et al": [Piece("data.xlsx", unless("id", "non"), alternating_sheet("training")), Piece("data.xlsx", always(1), sheet("independent_1", 0, False)), Piece("data.xlsx", not_equal("SEQCLASS", "non-antioxidant"), sheet("independent_2", "SEQUENCE"))],
    "PredAoDP": [Piece("nonanti.txt", always(0)), Piece("Indpendent dataset.txt", begins("anti")), Piece("independent dataset.txt", places(392)), Piece("Antioxident666.txt", unless("id", "non-antioxidant")), Piece("anti.txt", always(1))],
    "Thanh-Lam et al": [Piece("data.xlsx", not_equal("SEQCLASS", "non-antioxidant"), sheet(None, "SEQUENCE"))],
    "Zhai et al": [Piece("anti.txt", always(1)), Piece("nonanti.txt", always(0))],
    "Zhang et al": [Piece("pone.0163274.s001.xlsx", not_equal("Class", "Non-antioxidant"), sheet(s, "Sequence")) for s in ("Training Dataset", "Independent Testing Dataset")],
}


def records(spark: SparkSession, folder: str, pieces: list[Piece]) -> DataFrame:
    """sequence and label of all records of a source's files."""
    out = []
    for piece in pieces:
        df = piece.read(spark, f"{folder.rstrip('/')}/{piece.file}".rstrip("/"))
        out.append(df.select(F.col("sequence").cast("string").alias("sequence"), piece.label(df).cast("int").alias("label")))
    return reduce(DataFrame.unionByName, out)


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row a sequence with its label; sequences whose labels conflict; and the counts that go into a source's metadata."""
    parts = curate.duplicates(rows, "sequence", "label")
    right = parts["consistent"].select("sequence", "label").unionByName(parts["unique"].select("sequence", "label"))
    counts = rows.agg(F.count("*").alias("number_of_records")).crossJoin(right.agg(F.count("*").alias("number_of_unique_sequences"), F.count_if(F.col("label") == 1).alias("positive_examples"), F.count_if(F.col("label") == 0).alias("negative_examples")))
    return right, parts["conflicts"], counts.crossJoin(parts["conflicts"].agg(F.count("*").alias("number_of_sequences_with_errors")))  # one row each


def source_metadata(described: DataFrame, name: str, column: str = "source") -> DataFrame:
    """One row of what a table of descriptions says of a source: the only value of each column, or several, sorted and joined by semicolons."""
    own = described.where(F.col(column) == name)
    return own.agg(F.count("*").alias("number_of_sources"), *(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(c) for c in described.columns))


def parsed(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """judged() of a source by its name; its files lie in folder."""
    return judged(records(spark, folder, SOURCES[name]))
