"""Histories of revisions: quiet periods and score changes, safe for one very long history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: float) -> DataFrame:
    """The last revision before every quiet period longer than ``gap_seconds``.

    Time is cut into slots one gap wide. Only the last revision of a slot can be the last before
    a quiet period, and it is one unless the next slot starts within the gap. So a slot reduces
    to its last row and its first time stamp (combined map-side), and slots meet their
    neighbour by key and number: no window, no history in one task.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = int(gap_seconds * 1_000_000)
    rest = [k for k in events.columns if k not in keys]
    slots = events.groupBy(*keys, F.floor(micros / gap).cast("long").alias("_slot")).agg(
        F.max_by(F.struct(*rest), F.struct(ts, order)).alias("_last"), F.min(micros).alias("_first")
    )
    following = slots.select(*keys, (F.col("_slot") - 1).alias("_slot"), F.col("_first").alias("_next"))
    joined = slots.join(following, [*keys, "_slot"], "left")
    quiet = F.col("_next").isNull() | (F.col("_next") - F.unix_micros(F.col("_last")[ts].cast("timestamp")) > gap)
    return joined.filter(quiet).select(*keys, "_last.*")


def debounce_sessions(events: DataFrame, keys: list[str], ts: str, order: str, gap: str) -> DataFrame:
    """The same with ``session_window``, which also works on a stream with a watermark."""
    rest = [k for k in events.columns if k not in keys]
    return (
        events.groupBy(*keys, F.session_window(ts, gap).alias("_s"))
        .agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("_last"))
        .select(*keys, "_last.*")
    )


def previous(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Add the value of the row before, in two levels.

    Rows look back inside their block of ``width`` order numbers. The first and last rows of the
    blocks, which come out of that same exchange, then look back among each other, where the row
    before a first one is the last one of the block before. So a long history is spread over its
    blocks, at most two rows of a block meet the others', and ``df`` is computed once.
    """
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    marked = df.withColumn("_block", F.floor(F.col(order) / width)).withColumns(
        {"_in": F.lag(value).over(inner), "_nth": F.row_number().over(inner), "_last": F.lead(F.lit(True), 1, False).over(inner)}
    )
    first, last = F.col("_nth") == 1, ~F.col("_last")
    among = Window.partitionBy(*keys).orderBy(order)
    edges = marked.filter(first | last).withColumn("_in", F.lag(value).over(among)).filter(first)
    helpers = ("_block", "_nth", "_last")
    return marked.filter(~first).union(edges).drop(*helpers).withColumnRenamed("_in", name)


def change(score: Column, before: Column) -> Column:
    """Signed change, null for a first or an equal score."""
    return F.nullif(score - before, F.lit(0))


def score_delta(revisions: DataFrame) -> DataFrame:
    """Change against the score shown before, per document and generation."""
    df = previous(revisions, ["doc_id", "generation"], "rev", "score", "_before")
    return df.withColumn("delta", change(F.col("score"), F.col("_before"))).drop("_before")
