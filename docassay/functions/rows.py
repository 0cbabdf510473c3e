"""Row-level helpers that keep expensive columns from being planned twice.

The optimizer moves a filter below the projection that computes its column and repeats the whole
computation there, and it adds such filters below ``explode``. Both are a loss when the column
costs far more than the rows it would drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keys: list[str], array: str | Column) -> DataFrame:
    """``explode`` of an array of structs into its fields, without inferred filters."""
    out = df.select(*keys, F.explode_outer(array).alias("_row")).filter(F.col("_row").isNotNull())
    return out.select(*keys, "_row.*")


def explode_values(df: DataFrame, keys: list[str], array: str | Column, name: str) -> DataFrame:
    """``explode`` of an array of plain values, without inferred filters."""
    return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the columns it reads."""
    kept = df.select("*", F.explode_outer(F.array(condition)).alias("_keep"))
    return kept.filter("_keep").drop("_keep")


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column once: later filters on it are not moved below its computation."""
    rest = [k for k in df.columns if k != name]
    return df.select(*rest, F.explode_outer(F.array(value)).alias(name))
