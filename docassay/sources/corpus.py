"""Table sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.text import js_trim


def read_corpus(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    fmt: str = "parquet",
    partitions: int | None = None,
) -> DataFrame:
    """``(doc_id, text, *keep)`` from a table; only these columns are read.

    The input stays as it is stored. A caller to whom scoring costs far more than moving the
    documents once passes ``partitions``; a table that is read in as many splits is not moved. Files
    of ``fmt="text"`` are documents whose id is the SHA-256 of their path.
    """
    if fmt == "text":
        df = spark.read.text(path, wholetext=True)
        df = df.select(F.sha2(F.input_file_name(), 256).alias("doc_id"), F.col("value").alias("text"))
    else:
        df = spark.read.format(fmt).load(path)
        df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return df.repartition(partitions) if partitions and splits(df) < partitions else df


def splits(df: DataFrame) -> int:
    """Number of tasks that read a table."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def min_length_gate(df: DataFrame, n: int = 120, text_col: str = "text") -> DataFrame:
    """Rows whose trimmed text has at least ``n`` characters."""
    return df.filter(F.length(js_trim(F.col(text_col))) >= n)


def low_text(density: Column) -> Column:
    """Flag documents that carry almost no text; they are scored all the same."""
    return density < 200
