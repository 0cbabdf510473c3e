import datetime as dt
import random

from pyspark.sql import Row, functions as F

from docassay.operators import revisions as rv
from docassay.operators.facts import text_documents
from docassay.plans.score import score_documents
from docassay.sources import intake, sinks
from docassay.streaming import stateful as sl, streams as st

T0 = dt.datetime(2024, 1, 1)


def events(spark, offsets_ms):
    rows = [(1, i, T0 + dt.timedelta(milliseconds=ms)) for i, ms in enumerate(offsets_ms)]
    return spark.createDataFrame(rows, "key long, rev long, ts timestamp")


def test_debounce_boundaries(spark):
    df = events(spark, [0, 200, 700, 1201, 1300, 5000])
    quick = {r.rev for r in rv.debounce(df, ["key"], "ts", "rev", 0.5).collect()}
    windows = {r.rev for r in rv.debounce_sessions(df, ["key"], "ts", "rev", "500 milliseconds").collect()}
    assert quick == windows == {2, 4, 5}


def test_previous_crosses_blocks(spark):
    rows = [(1, 0, r, r * r % 7) for r in (0, 1, 4095, 4096, 9000, 20000)] + [(1, 1, 0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, generation long, rev long, score int")
    got = {(r.generation, r.rev): r._before for r in rv.previous(df, ["doc_id", "generation"], "rev", "score", "_before").collect()}
    scores = {r: r * r % 7 for r in (0, 1, 4095, 4096, 9000, 20000)}
    revs = sorted(scores)
    want = {(0, r): (scores[revs[i - 1]] if i else None) for i, r in enumerate(revs)} | {(1, 0): None}
    assert got == want


def test_previous_computes_its_input_once_and_spreads_one_history(spark, tmp_path):
    path = str(tmp_path / "history")
    spark.range(1_000_000).selectExpr("1L AS doc_id", "0L AS generation", "id AS rev", "cast(id * id % 97 AS int) AS score").write.parquet(path)
    out = rv.score_delta(spark.read.parquet(path))
    assert out.filter("delta <=> nullif(score - cast((rev - 1) * (rev - 1) % 97 AS int), 0) OR rev = 0").count() == 1_000_000
    out.collect()[:1]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "Join" not in plan
    blocks = spark.read.parquet(path).selectExpr("rev div 4096 AS b").groupBy("b").count()
    assert blocks.count() == 245 and blocks.agg(F.max("count")).first()[0] == 4096


SCORES = "doc_id long, generation long, rev long, score int, ts timestamp"


def write_parts(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(40).selectExpr("id", "id % 2 AS part").repartition(3).write.partitionBy("part").parquet(f"{folder}/many.parquet")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("*.parquet")).rename(tmp_path / "in" / "one.parquet")
    many = st.run_available(st.table_stream(spark, folder, "many.parquet"), str(tmp_path / "out-many"))
    one = st.run_available(st.table_stream(spark, folder, "one.parquet"), str(tmp_path / "out-one"))
    assert sorted(map(tuple, many.collect())) == [(i, i % 2) for i in range(40)] and one.count() == 7


def test_changes_of_shuffled_revisions_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(d, r // 5, r, rng.randint(0, 9) * 10, T0 + dt.timedelta(seconds=r)) for d in range(4) for r in range(20)]
    rng.shuffle(rows)
    write_parts(spark, str(tmp_path / "in"), [rows[i::4] for i in range(4)], SCORES)
    stream = st.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    out = sl.run_to_end([(stream, "ts")], str(tmp_path / "out"), lambda s: sl.change_stream(s, "ts", "1 hour", 3600))
    cols = ["doc_id", "generation", "rev", "score", "delta"]
    want = rv.score_delta(spark.createDataFrame(rows, SCORES))
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_a_forgotten_score_leaves_no_state(spark, tmp_path):
    later = [(1, 0, 0, 50, T0), (2, 0, 0, 10, T0)], [(3, 0, 0, 1, T0 + dt.timedelta(seconds=30))], [(3, 0, 1, 2, T0 + dt.timedelta(hours=9))], [(1, 0, 1, 60, T0 + dt.timedelta(hours=9))]
    write_parts(spark, str(tmp_path / "in"), later, SCORES)
    stream = st.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    seen = []
    with sl.state_store(spark):
        query = sl.change_stream(stream, "ts", "1 second", 3600).writeStream.format("memory").queryName("forgotten").outputMode("append").option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = [sum(int(v) for op in p.stateOperators for v in [op.numRowsTotal]) for p in query.recentProgress]
    got = {(r.doc_id, r.rev): r.delta for r in spark.table("forgotten").collect()}
    assert got == {(1, 0): None, (2, 0): None, (3, 0): None} and max(seen) > seen[-1]


def test_quiet_periods_of_rows_out_of_order(spark, tmp_path):
    times = [0, 400, 800, 1400, 1500, 2500, 2900, 2900, 9000]
    rows = [(1, i, T0 + dt.timedelta(milliseconds=ms)) for i, ms in enumerate(times)]
    parts = [[rows[2], rows[6]], [rows[0], rows[4], rows[7]], [rows[1], rows[5]], [rows[3], rows[8]]]
    write_parts(spark, str(tmp_path / "in"), parts, "key long, rev long, ts timestamp")
    stream = st.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    out = sl.run_to_end([(stream, "ts")], str(tmp_path / "out"), lambda s: sl.quiet_stream(s, ["key"], "ts", "rev", 0.5, "1 minute"))
    want = rv.debounce(spark.createDataFrame(rows, "key long, rev long, ts timestamp"), ["key"], "ts", "rev", 0.5)
    assert sorted(r.rev for r in out.collect()) == sorted(r.rev for r in want.collect()) == [2, 4, 7, 8]


def test_quiet_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    parts = [[(1, i, T0 + dt.timedelta(milliseconds=ms)) for i, ms in enumerate(part)] for part in ([0, 100, 60_000], [120_000], [200, 180_000])]
    write_parts(spark, str(tmp_path / "in"), parts, "key long, rev long, ts timestamp")
    stream = st.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    out = sl.run_to_end([(stream, "ts")], str(tmp_path / "out"), lambda s: sl.quiet_stream(s, ["key"], "ts", "rev", 0.5, "1 second"))
    assert {r.ts for r in out.collect()} == {T0 + dt.timedelta(milliseconds=m) for m in (100, 60_000, 120_000, 180_000)}


def test_a_comparison_holds_for_later_revisions_only(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    asked = [(1, 7, at(10)), (1, 8, at(20)), (1, 9, at(20)), (2, 7, at(0)), (3, 5, at(50))]
    revisions = [(1, 0, at(5), "a"), (1, 1, at(10), "b"), (1, 2, at(19), "c"), (1, 3, at(20), "d"), (2, 0, at(1), "e"), (2, 1, at(90_000), "f"), (4, 0, at(9), "g"), (3, 0, at(49), "h")]
    write_parts(spark, str(tmp_path / "a"), [asked[3:], asked[:3]], "doc_id long, posting_id long, asked_at timestamp")
    write_parts(spark, str(tmp_path / "r"), [revisions[4:], revisions[:4]], "doc_id long, rev long, ts timestamp, text string")
    a, r = (st.table_stream(spark, str(tmp_path / n), "*.parquet", files_per_batch=1) for n in "ar")
    out = sl.run_to_end([(a, "asked_at"), (r, "ts")], str(tmp_path / "out"), lambda a, r: sl.comparisons(a, r, "2 days", 86400))
    assert sorted((x.doc_id, x.rev, x.posting_id, x.text) for x in out.collect()) == [(1, 1, 7, "b"), (1, 2, 7, "c"), (1, 3, 9, "d"), (2, 0, 7, "e")]


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    for offsets in ([0, 100, 60_000], [120_000], [200, 180_000]):
        events(spark, offsets).coalesce(1).write.mode("append").parquet(folder)
    stream = st.table_stream(spark, folder, "*.parquet", files_per_batch=1)
    quiet = st.debounce_stream(stream, ["key"], "ts", "rev", "500 milliseconds", "1 second")
    out = st.run_available(quiet, str(tmp_path / "out"))
    assert {r.ts for r in out.collect()} == {T0 + dt.timedelta(milliseconds=m) for m in (100, 60_000, 120_000)}


def test_intake(spark, tmp_path):
    files = {
        "a.txt": b"plain", "b.md": b"# md", "c.rtf": rb"{\rtf1 caf\'e9\par next{\*\x hidden}\tab end}", "d.doc": b"x", "e.pages": b"x",
        "f.pdf": b"x", "g": b"%PDF-1.7", "h.docx": b"x", "i.bin": b"PK\x03\x04", "j.zzz": b"x", "k.txt": b"", "l.txt": b"y" * 60,
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 59)  # content of a longer file raises
    try:
        rows = spark.createDataFrame(intake.intake_files(spark, str(tmp_path), limit=59).collect(), intake.SCHEMA)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.file_name: r.length for r in rows.collect()} == {n: len(b) for n, b in files.items()}
    got = {r.file_name: r.kind or r.reason for r in rows.collect()}
    assert got == {
        "a.txt": "text", "b.md": "text", "c.rtf": "rtf", "d.doc": "old_word", "e.pages": "apple_pages", "f.pdf": "pdf", "g": "pdf",
        "h.docx": "docx", "i.bin": "docx", "j.zzz": "unknown", "k.txt": "empty", "l.txt": "too_large",
    }
    ok, rejects = intake.split_rejects(rows)
    assert (ok.count(), rejects.count()) == (7, 5)
    assert rejects.filter(F.col("message").isNull() | F.col("content").isNotNull()).count() == 0
    texts = {r.file_name: r.text for r in intake.text_files(rows).collect()}
    assert texts["c.rtf"] == "café\n next    end"
    ids = [r.doc_id for r in intake.text_files(rows).collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 64 for i in ids)


def test_intake_of_a_folder_of_empty_files_and_with_an_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "b c#é.md").write_bytes(b"")
    got = intake.intake_files(spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.length, r.reason) for r in got) == [("a.txt", 0, "empty"), ("b c#é.md", 0, "empty")]
    known = spark.createDataFrame([("s3:/x/z.txt", 0), ("s3:/x/y.txt", 5)], "path string, length long")
    got = intake.intake_files(spark, str(tmp_path), inventory=known).collect()
    assert [(r.file_name, r.reason) for r in got] == [("z.txt", "empty")]


def test_a_repeated_batch_leaves_the_report_tables_unchanged(spark, sf, tmp_path):
    docs = text_documents(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(12))
    path, names = str(tmp_path), ("reports", "check_results", "category_scores", "actions")

    def tables():
        return {n: sorted(map(str, spark.read.parquet(f"{path}/{n}").collect())) for n in names}

    first, second = score_documents(docs.filter("doc_id % 2 = 0")), score_documents(docs.filter("doc_id % 2 = 1"))
    sinks.write_report_batch(first, path, 0)
    sinks.write_report_batch(second, path, 1)
    once = tables()
    sinks.write_report_batch(second, path, 1)
    sinks.write_report_batch(first, path, 0)
    assert tables() == once and len(once["reports"]) == docs.count() and len(once["check_results"]) > len(once["actions"]) > 0


def test_a_stream_of_reports_goes_on_after_a_restart(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(8)
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = st.table_stream(spark, str(tmp_path / "in"), "*.parquet")
        sinks.report_stream(score_documents(text_documents(stream)), str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out" / "reports"))
    want = score_documents(text_documents(docs))
    assert sorted(map(tuple, stored.select("doc_id", "score").collect())) == sorted(map(tuple, want.select("doc_id", "score").collect()))
    assert {r.batch for r in stored.select("batch").distinct().collect()} == {0, 1}


def test_a_key_with_many_quiet_periods_has_one_timer():
    from pyspark.sql.types import LongType, StructField, StructType

    from docassay.streaming.stateful import Quiet

    class Store:
        def __init__(self):
            self.held, self.calls, self.timers = [], 0, set()

        def getListState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return iter(self.held)

        def put(self, rows):
            self.calls, self.held = self.calls + 1, rows

        def clear(self):
            self.put([])

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.discard(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        def getExpiryTimeInMs(self):
            return self.at

    names = ["rev", "_at", "_from", "_due"]
    store, quiet = Store(), Quiet(StructType([StructField(n, LongType()) for n in names]), "rev", 500)
    quiet.init(store)
    rows = [Row(*names)(i, i * 1000_000, i * 1000_000, i * 1000 + 1) for i in range(400)]
    assert list(quiet.handleInputRows((1,), iter(rows[200:]), Now(0))) == [] and store.timers == {200_001}
    assert list(quiet.handleInputRows((1,), iter(rows[:200]), Now(0))) == [] and store.timers == {1}
    store.timers.clear()
    out = list(quiet.handleExpiredTimer((1,), Now(300_001), Now(1)))
    assert [r["rev"] for r in out] == list(range(301)) and store.timers == {301_001}
    store.timers.clear()
    assert [r["rev"] for r in quiet.handleExpiredTimer((1,), Now(10**9), Now(301_001))] == list(range(301, 400))
    assert not store.timers and not store.held and store.calls < 20
