"""Revision streams: quiet periods, scores, score changes and matches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import text as tx
from docassay.functions.phrasing import percent
from docassay.operators.facts import text_documents
from docassay.operators.revisions import debounce_sessions
from docassay.plans.score import score_documents


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; local only where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return f"{tempfile.mkdtemp(prefix='spark-')}/{name}"
    import uuid

    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, tables: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet tables of a folder as a stream, each a file or a folder of files; the schema comes from what is there.

    The name is always a pattern, since a streaming source takes a plain path to be a folder.
    """
    path = f"{folder}/{{{tables}}}"
    schema = spark.read.option("basePath", folder).parquet(path).schema
    return (
        spark.readStream.schema(schema)
        .option("basePath", folder)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything there is into a parquet table and return that table."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def debounce_stream(events: DataFrame, keys: list[str], ts: str, order: str, gap: str, late: str) -> DataFrame:
    """Last revision before a quiet gap; emitted once the watermark has passed the gap."""
    return debounce_sessions(events.withWatermark(ts, late), keys, ts, order, gap)


def score_stream(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of a document stream: a projection, no state."""
    scored = score_documents(text_documents(docs), keep=keep)
    return scored.select("doc_id", *keep, "score", "total_score", "total_weight", "band_id")


def match_stream(docs: DataFrame, mined: DataFrame) -> DataFrame:
    """Coverage of each revision against its posting: a stream-static join, no state.

    ``docs`` is ``(doc_id, rev, posting_id, text)``, ``mined`` has one row per posting. A revision
    whose posting has no terms is reported with zeros.
    """
    joined = docs.join(mined, "posting_id", "left").withColumn("lower", F.lower("text"))
    joined = joined.withColumn("heads", tx.heads(F.col("lower")))
    present = F.expr(
        "transform(filter(terms, t -> array_contains(heads, t.term) OR (NOT (t.term rlike '^[.]*[a-z0-9+#]+$') AND contains(lower, t.term) "
        "AND regexp_like(lower, concat('(^|[^a-z0-9+#.])', regexp_replace(t.term, '([^a-z0-9 ])', '\\\\\\\\$1'), '($|[^a-z0-9+#])')))), t -> t.term)"
    )
    joined = joined.withColumn("present", present)
    asked, found = (F.greatest(F.size(name), F.lit(0)) for name in ("terms", "present"))
    return joined.select(
        "doc_id", "rev", "posting_id", asked.alias("n_terms"), found.alias("n_matched"), percent(found, asked).alias("coverage"),
    )


