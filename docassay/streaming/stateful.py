"""Keyed operators on streams that hold rows until the watermark, with timers and expiring state.

Both see the rows of a key in event time, whatever order they arrive in, and drop what is later than
the watermark (which starts at 1970, so earlier times are always late). What is open at the end of a finite source comes out when the stream goes on with a
closing row, so the source is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from docassay.streaming.streams import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for queries started meanwhile."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Held(StatefulProcessor):
    """Rows of a key held until the watermark has passed their ``_due`` time, in milliseconds."""

    def __init__(self, schema: StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def arrive(self, held: list[Row]) -> list[Row]:
        """What is kept of the rows held before and the new ones."""
        return held

    def release(self, key, ready: list[Row], rest: list[Row], now: int, watermark: int) -> Iterator[Row]:
        """What the rows that are due give; without any, the timer was the subclass's own."""
        raise NotImplementedError

    def _read(self) -> list[Row]:
        return [Row(*self.schema.names)(*r) for r in self.rows.get()]

    def _write(self, rows: list[Row]) -> None:
        if rows:
            self.rows.put([tuple(r[n] for n in self.schema.names) for r in rows])
        else:
            self.rows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._read()
        held = self.arrive(before + [Row(*self.schema.names)(*[r[n] for n in self.schema.names]) for r in rows])
        for due in {r["_due"] for r in held} - {r["_due"] for r in before}:
            self.handle.registerTimer(due)
        self._write(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), self._read()
        ready, rest = [r for r in held if r["_due"] <= now], [r for r in held if r["_due"] > now]
        if ready:
            self._write(rest)
        return self.release(key, ready, rest, now, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Quiet(Held):
    """Sessions of rows no more than ``gap`` microseconds apart; the last row of one is its result.

    A session is held as its last row and its first time (``_from``), so a row that arrives late but
    in time joins the sessions on both sides. A key has one timer, that of its earliest session, and
    it releases every session that the watermark has passed: a key's state is read and written once
    a batch, however many sessions end in it.
    """

    def __init__(self, schema: StructType, order: str, gap: int):
        super().__init__(schema)
        self.order, self.gap = order, gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, make = self._read(), Row(*self.schema.names)
        held = self.arrive(before + [make(*r) for r in rows])
        old, new = (min((r["_due"] for r in some), default=None) for some in (before, held))
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self._write(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, held = timerValues.getCurrentWatermarkInMs(), self._read()
        ready, rest = [r for r in held if r["_due"] <= passed], [r for r in held if r["_due"] > passed]
        if ready:
            self._write(rest)
            if rest:
                self.handle.registerTimer(min(r["_due"] for r in rest))
        return iter(ready)

    def arrive(self, held: list[Row]) -> list[Row]:
        out: list[Row] = []
        for row in sorted(held, key=lambda r: r["_from"]):
            if out and row["_from"] - out[-1]["_at"] <= self.gap:
                first = out[-1]["_from"]
                last = max(out.pop(), row, key=lambda r: (r["_at"], r[self.order]))
                row = Row(*self.schema.names)(*[first if n == "_from" else last[n] for n in self.schema.names])
            out.append(row)
        return out


class Changes(Held):
    """Every score with its change against the one before, within a generation; the last one is kept for ``keep`` milliseconds."""

    LAST = StructType([StructField(n, LongType()) for n in ("generation", "score", "expires")])

    def __init__(self, schema: StructType, keep: int):
        super().__init__(schema)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.LAST)

    def release(self, key, ready: list[Row], rest: list[Row], now: int, watermark: int) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in sorted(ready, key=lambda r: (r["generation"], r["rev"])):
            same = last is not None and last[0] == r["generation"] and r["score"] is not None and last[1] is not None
            change = r["score"] - last[1] if same else None
            out.append(Row("doc_id", "generation", "rev", "score", "delta")(key[0], r["generation"], r["rev"], r["score"], change or None))
            last = (r["generation"], r["score"], now + self.keep)
        if last is not None and last[2] <= max(now, watermark) and not any(r["_due"] <= last[2] for r in rest):
            self.last.clear()  # nothing can come any more before it expires
        elif ready:
            self.last.update(last)
            self.handle.registerTimer(last[2])
        return iter(out)


class Asked(Held):
    """Revisions with the posting asked for last, for ``keep`` milliseconds."""

    LAST = StructType([StructField(n, LongType()) for n in ("posting_id", "expires")])

    def __init__(self, schema: StructType, keep: int):
        super().__init__(schema)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.LAST)

    def release(self, key, ready: list[Row], rest: list[Row], now: int, watermark: int) -> Iterator[Row]:
        last, out, new = (self.last.get() if self.last.exists() else None), [], False
        for r in sorted(ready, key=lambda r: (r["_at"], r["rev"] is not None, r["posting_id"] or 0, r["rev"] or 0)):
            if r["rev"] is None:
                last, new = (r["posting_id"], r["_at"] // 1000 + self.keep), True
            elif last is not None and r["_at"] // 1000 <= last[1]:
                out.append(Row("doc_id", "rev", "ts", "posting_id", "text")(key[0], r["rev"], r["ts"], last[0], r["text"]))
        if last is not None and last[1] < max(now, watermark) and not any(r["_at"] // 1000 <= last[1] for r in rest):
            self.last.clear()  # nothing it holds for can come any more
        elif new:
            self.last.update(last)
            self.handle.registerTimer(last[1] + 1)
        return iter(out)


def quiet_stream(events: DataFrame, keys: list[str], ts: str, order: str, gap_seconds: float, late: str) -> DataFrame:
    """The last of ``events`` before every quiet period longer than ``gap_seconds``, when the watermark has passed it.

    Rows that are later than the watermark (by more than ``late``) are dropped. Ties in time go to
    the larger ``order``.
    """
    gap = int(gap_seconds * 1_000_000)
    at = F.unix_micros(ts)
    timed = events.withColumns({"_at": at, "_from": at, "_due": F.floor((at + gap) / 1000) + 1}).withWatermark(ts, late)
    out = timed.groupBy(*keys).transformWithState(Quiet(timed.schema, order, gap), timed.schema, "append", "eventTime")
    return out.select(events.columns)


def change_stream(scores: DataFrame, ts: str, late: str, keep_seconds: int) -> DataFrame:
    """``(doc_id, generation, rev, score, delta)`` for a stream that also has the time of every revision.

    Revisions may arrive in any order within ``late``; they are taken in the order of their times,
    those of one time by generation and revision. A document's last score is forgotten
    ``keep_seconds`` of event time after it; the next one then counts as a first one.
    """
    timed = scores.select("doc_id", "generation", "rev", "score", ts, (F.floor(F.unix_micros(ts) / 1000) + 1).alias("_due")).withWatermark(ts, late)
    return timed.groupBy("doc_id").transformWithState(
        Changes(timed.schema, keep_seconds * 1000), "doc_id long, generation long, rev long, score int, delta int", "append", "eventTime"
    )


def run_to_end(streams: list[tuple[DataFrame, str]], path: str, build: Callable[..., DataFrame]) -> DataFrame:
    """All results of ``build(*streams)`` on finite streams, also those that wait for the watermark at the end.

    ``streams`` come with the names of their times. Each is joined by one of closing rows. After
    everything there is has been processed, one row without a key and with the last possible time is
    put into each of these and the same query goes on: its watermark passes everything that waits, and
    nothing is read again. No rows can follow after that.
    """
    spark, closed = streams[0][0].sparkSession, []
    for i, (stream, _) in enumerate(streams):
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/closing-{i}")
        closed.append(stream.union(spark.readStream.schema(stream.schema).parquet(f"{path}/closing-{i}")))
    out = build(*closed)
    with state_store(spark):
        run_available(out, path)
        for i, (stream, ts) in enumerate(streams):
            end = [F.lit("9999-01-01").cast("timestamp") if f.name == ts else F.lit(None).cast(f.dataType) for f in stream.schema]
            spark.range(1).select(*[c.alias(f.name) for c, f in zip(end, stream.schema, strict=True)]).write.mode("append").parquet(f"{path}/closing-{i}")
        return run_available(out, path)


def comparisons(asked: DataFrame, revisions: DataFrame, late: str, lasts_seconds: int) -> DataFrame:
    """``(doc_id, rev, ts, posting_id, text)``: every revision with the comparison asked for last before it.

    ``asked`` is a stream ``(doc_id, posting_id, asked_at)``, ``revisions`` one of ``(doc_id, rev, ts,
    text)``. A comparison holds for revisions of its time and later ones for ``lasts_seconds``, until
    another is asked for; of two of one time that of the larger posting counts. Revisions without one
    are left out. Both are held until the watermark of the slower stream, then a document needs one
    comparison only, so state does not grow with the past.
    """
    a = asked.withWatermark("asked_at", late).select(
        "doc_id", F.lit(None).cast("long").alias("rev"), F.col("asked_at").alias("ts"), "posting_id", F.lit(None).cast("string").alias("text")
    )
    r = revisions.withWatermark("ts", late).select("doc_id", "rev", "ts", F.lit(None).cast("long").alias("posting_id"), "text")
    both = a.union(r)
    timed = both.withColumns({"_at": F.unix_micros("ts"), "_due": F.floor(F.unix_micros("ts") / 1000) + 1})
    return timed.groupBy("doc_id").transformWithState(Asked(timed.schema, lasts_seconds * 1000), both.schema, "append", "eventTime")
