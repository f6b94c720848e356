"""Reading tables by their ending and finding them by where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.functions import naming, vectors


def read_table(spark: SparkSession, path: str, columns: Iterable[str] | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """CSV (.csv, .tsv, .txt) with a header, Parquet or JSON lines by the path's ending; only the given columns are read."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if ending in ("csv", "tsv", "txt"):
        df = reader.option("header", "true").option("sep", "," if ending == "csv" else "\t").option("inferSchema", str(schema is None).lower()).csv(path)
    elif ending in ("parquet", "pq"):
        df = reader.parquet(path)
    elif ending in ("json", "jsonl"):
        df = reader.json(path)
    else:
        raise ValueError(f"no reader for .{ending}: {path}")
    return df.select(*columns) if columns is not None else df


def packed_features(df: DataFrame, prefix: str = "p_", metadata: Iterable[str] | None = None, name: str = "features") -> DataFrame:
    """Wide numeric columns prefix0, prefix1 .. by their numbers as one array of doubles; metadata: columns to keep (all others if None)."""
    wide = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: (int(c[len(prefix) :]) if c[len(prefix) :].isdigit() else 10**9, c))
    if not wide:
        raise ValueError(f"no column begins with {prefix}")
    kept = [c for c in df.columns if c not in wide] if metadata is None else [c for c in metadata if c in df.columns]
    return df.select(*kept, F.array(*(F.col(c).cast("double") for c in wide)).alias(name))


def wide_features(df: DataFrame, name: str = "features", prefix: str = "p_", size: int | None = None) -> DataFrame:
    """The other way; size is that of the longest array if it isn't given, and shorter arrays end in nulls."""
    size = size if size is not None else df.agg(F.coalesce(F.max(F.size(name)), F.lit(0))).first()[0]
    return df.select(*(c for c in df.columns if c != name), *(F.get(vectors.doubles(F.col(name)), F.lit(i)).alias(f"{prefix}{i}") for i in range(size)))


def found_files(spark: SparkSession, folder: str, pattern: str = "*.csv", without: Iterable[str] = ()) -> DataFrame:
    """Paths and sizes below a folder by name, without those whose path holds one of `without` or a hidden part; file contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    df = df.where(~F.col("path").rlike(r"/[._][^/]*(?:/|$)"))
    for part in without:
        df = df.where(~F.col("path").contains(part))
    return df


def read_found(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """All tables of one schema below a folder, with source_path and what the path says of them."""
    df = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).csv(folder)
    return df.withColumn("source_path", F.col("_metadata.file_path")).withColumns(path_metadata(F.col("source_path")))


def read_folds(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The tables fold_<n>/{train,val,test}.csv below a folder as one, with fold, part, and what the path says of them."""
    found = lambda reader: reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "{train,val,test}.csv")
    df = found(spark.read.schema(schema).option("header", "true")).csv(folder).withColumn("source_path", F.col("_metadata.file_path"))
    # A path is read once a file, not once a row: the files' names come from a listing, which the driver holds for either.
    files = found(spark.read.format("binaryFile")).load(folder).select(F.col("_metadata.file_path").alias("source_path")).where(F.col("source_path").rlike(r"/fold_[0-9]+/(?:train|val|test)\.csv$"))
    told = {k: v for k, v in path_metadata(F.col("source_path")).items() if k not in df.columns}
    files = files.withColumns({**told, "part": F.regexp_extract("source_path", r"/(train|val|test)\.csv$", 1)})
    return df.join(F.broadcast(files), "source_path").select(*df.columns, *told, "part")


def read_seed_summaries(spark: SparkSession, folder: str, pattern: str = "split_summary.csv") -> DataFrame:
    """Split statuses (reduction_levels, status, reason) of all seeds below a folder, with scenario, strategy and seed from their paths.

    A missing status is unknown, a missing reason empty; is_kept and is_invalid (anything but kept) flag them; the level's parameter is told apart.
    Hidden folders and those of analyses are passed over, and files that can't be read.
    """
    schema = "reduction_levels string, status string, reason string"
    reader = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    df = reader.csv(folder).withColumn("source_path", F.col("_metadata.file_path"))
    df = df.where(~F.col("source_path").rlike(r"/(?:split_analysis|_summary|\.[^/]*)/"))
    told, level = path_metadata(F.col("source_path")), F.col("reduction_levels")
    df = df.withColumns({k: told[k] for k in ("scenario", "strategy", "seed")})
    df = df.withColumns({"status": F.coalesce("status", F.lit("unknown")), "reason": naming.clean_reason(F.col("reason")), "threshold": F.when(level == "no_threshold", "").otherwise(level)})
    return df.withColumns({"is_kept": (F.col("status") == "kept").cast("int"), "is_invalid": (F.col("status") != "kept").cast("int"), "parameter_type": naming.parameter_type(F.coalesce(level, F.lit(""))), "parameter_value": naming.parameter_value(level)})


def path_metadata(path: Column) -> dict[str, Column]:
    """scenario, strategy, seed, level and fold of a path .../scenario/strategy/seed_N/level/fold_NN/..., or .../scenario/strategy/level/seed_N/..,
    or .../scenario/level/strategy/seed_N/..; null for what a path doesn't say."""
    pick = lambda p, g: F.nullif(F.regexp_extract(path, p, g), F.lit(""))
    tree, level = r"([^/]+)/([^/]+)/seed_?([0-9]+)(?:/|$)", r"(?:p[0-9]+_[0-9]+|minseqid_[0-9]+(?:_[0-9]+)?|threshold_[0-9.]+|no_threshold|no_level)"
    after, between = rf"([^/]+)/([^/]+)/{level}/seed_?([0-9]+)(?:/|$)", rf"([^/]+)/{level}/([^/]+)/seed_?([0-9]+)(?:/|$)"
    one = lambda g: F.coalesce(pick(after, g), pick(between, g), pick(tree, g))
    return {"scenario": one(1), "strategy": one(2), "seed": one(3).cast("int"), "reduction_level": naming.reduction_level(path), "fold": pick(r"/fold_([0-9]+)(?:/|$)", 1).cast("int")}


def without_done(files: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Files whose key has no marker yet."""
    return files.join(markers.select(key).distinct(), key, "left_anti")


def sheet(spark: SparkSession, path: str, wanted: dict[str, Iterable[str]], least: int = 5) -> DataFrame:
    """The sheet of a workbook that has most of the wanted columns (by alias), at least `least`; a workbook is a driver-sized file."""
    import pandas as pd

    names = {a.lower() for k, v in wanted.items() for a in (k, *v)}
    sheets = pd.read_excel(path, sheet_name=None)
    score = lambda df: sum(str(c).strip().lower() in names for c in df.columns)
    best = max(sheets, key=lambda s: (score(sheets[s]), s), default=None)
    if best is None or score(sheets[best]) < least:
        raise ValueError(f"no sheet of {path} has {least} of the columns")
    return spark.createDataFrame(sheets[best])


def read_summaries(spark: SparkSession, folder: str, schema: str, ending: str = "_reduced_distance_reduction_summary.csv", files: str = "ignore") -> DataFrame:
    """Reduction summaries of one schema below a folder, with model, what a file's name says before the ending.

    files: "ignore" leaves out unreadable files, "fail" doesn't.
    """
    reader = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").option("ignoreCorruptFiles", str(files == "ignore").lower())
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return reader.csv(folder).withColumn("model", F.substr(name, F.lit(1), F.length(name) - len(ending)))


def fetched(df: DataFrame, key: str, fetch: Callable[[str], str], output: str = "content", at_once: int = 4, error: str = "error") -> DataFrame:
    """df with what fetch returns for each key, "" where it fails, and why it failed, null where it didn't; at_once tasks ask at a time.

    fetch runs on executors.  That a source is out shows in the errors, not in the contents.
    """
    names, schema = [*df.columns, output, error], StructType([*df.schema.fields, StructField(output, StringType()), StructField(error, StringType())])

    def run(frames):
        for frame in frames:
            found, wrong = [], []
            for value in frame[key]:
                try:
                    found.append(fetch(value) or "")
                    wrong.append(None)
                except Exception as reason:  # one key that fails doesn't end the others
                    found.append("")
                    wrong.append(f"{type(reason).__name__}: {reason}"[:500])
            yield frame.assign(**{output: found, error: wrong})[names]

    return df.repartition(at_once).mapInPandas(run, schema)
