"""Keys that compare safely, and schemas that may lack columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

MISSING = "not_applicable"


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of columns that df has, once each, in order."""
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def filled_keys(df: DataFrame, columns: Iterable[str], token: str = MISSING) -> DataFrame:
    """Key columns as strings, null as a token, so that equal joins match missing with missing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in existing(df, columns)})


def combo_key(df: DataFrame, columns: Iterable[str], separator: str = " | ", token: str = MISSING) -> Column:
    """One string of several columns; columns that df lacks are left out."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in existing(df, columns)))


def resolve(df: DataFrame, aliases: Mapping[str, Iterable[str]], required: Iterable[str] = ()) -> DataFrame:
    """df with logical names: for each, the first of its physical names that df has, in any letter case."""
    there = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((there[a.lower()] for a in (name, *options) if a.lower() in there), None) for name, options in aliases.items()}
    if lost := [n for n in required if not found.get(n)]:
        raise ValueError(f"no column for {', '.join(lost)} among {', '.join(df.columns)}")
    return df.select("*", *(F.col(c).alias(n) for n, c in found.items() if c and c != n))


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def selected(df: DataFrame, column: str, choice: str | Iterable[str] | None) -> DataFrame:
    """Rows whose column is one of choice; None, "auto" or "all" is no filter."""
    if choice is None or isinstance(choice, str) and choice.lower() in ("auto", "all"):
        return df
    return df.where(F.col(column).isin([choice] if isinstance(choice, str) else list(choice)))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if (row := repeated(df, keys).limit(1).collect()):
        raise ValueError(f"several rows for {row[0].asDict()}")
    return df
