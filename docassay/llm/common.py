"""Shared folder, stored tables, connected components and batch helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors repeat no earlier work."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(rows: DataFrame, n: int, group: str) -> DataFrame:
    """``(doc_id, group)``: the ``n`` distinct pairs of each group that come first by a hash of doc_id.

    Only rows below a bound on the hash are ordered. The bound follows from the group's number of rows
    and is widened until enough distinct ids are below it, so some multiples of ``n`` meet in a task,
    however large a group is. Groups must be few; rows without doc_id or group are left out.
    """
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col(group).isNotNull()).select("doc_id", group, F.xxhash64("doc_id").alias("_h"))
    counts = rows.groupBy(group).count().collect()
    share = {g: min(1.0, 2 * n / c) for g, c in counts}
    kind = rows.schema[group].dataType.simpleString()
    while True:
        bounds = rows.sparkSession.createDataFrame([(g, int(s * 2**64) - 2**63 if s < 1 else 2**63 - 1) for g, s in share.items()], f"`{group}` {kind}, _bound long")
        below = rows.join(F.broadcast(bounds), group).filter("_h <= _bound").select("doc_id", group, "_h").distinct()
        below = stored(below, "first-by-hash")
        have = dict(below.groupBy(group).count().collect())
        short = [g for g, s in share.items() if s < 1 and have.get(g, 0) < n]
        if not short:
            break
        share.update({g: min(1.0, 4 * share[g]) for g in short})
    first = Window.partitionBy(group).orderBy("_h", "doc_id")
    return below.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= n).select("doc_id", group)


def spans_of(sizes: Sequence[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about ``limit``; a larger single item is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, list[str]]]:
    """Index ranges of a batch's texts of about ``limit`` bytes, and these texts; null is empty.

    A worker holds the batch once, and few of its texts as strings.
    """
    for a, b in spans_of(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    Alternating large-star and small-star steps: neighbours are only ever reduced to their minimum
    and joined back by node, so no component is gathered anywhere.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
