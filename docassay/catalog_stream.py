"""Queries on revisions, streams and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.catalog import c, flagship, prose, register, structured
from docassay.catalog_terms import SKILLS, STOP, postings
from docassay.corpora import structured_documents
from docassay.operators import facts as fc, revisions as rv, scoring as sc, terms as tm
from docassay.operators.rules import packs_from
from docassay.plans.score import reports, score_documents, score_packs
from docassay.sources import sinks
from docassay.streaming import stateful as sl, streams as st

GAP_HOURS = 6


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts", "value")


@register
def j01_debounce(spark, sf):
    return rv.debounce(events(spark, sf), ["user_id"], "ts", "event_id", GAP_HOURS * 3600)


@register
def j01_debounce_sessions(spark, sf):
    return rv.debounce_sessions(events(spark, sf), ["user_id"], "ts", "event_id", f"{GAP_HOURS} hours")


@register
def j01_debounce_stream(spark, sf):
    stream = st.table_stream(spark, sf, "events.parquet").select("user_id", "event_id", c("ts").cast("timestamp").alias("ts"), "value")
    quiet = lambda s: sl.quiet_stream(s, ["user_id"], "ts", "event_id", GAP_HOURS * 3600, "1 hour")
    out = sl.run_to_end([(stream, "ts")], st.work_folder(spark, "debounce"), quiet)
    return out.withColumn("ts", c("ts").cast("timestamp_ntz"))


@register
def j02_score_stream(spark, sf):
    stream = st.table_stream(spark, sf, "documents.parquet").select("doc_id", "text")
    return st.run_available(st.score_stream(stream), st.work_folder(spark, "scores"))


def turns(df):
    """Conversations as histories: each turn is a revision, four make a generation."""
    return df.select(
        c("conv_id").alias("doc_id"), F.floor(c("turn") / 4).alias("generation"), c("turn").alias("rev"), "text"
    )


@register
def g09_score_delta(spark, sf):
    docs = fc.text_documents(turns(spark.read.parquet(f"{sf}/conversations.parquet")))
    scored = score_documents(docs, keep=("generation", "rev")).select("doc_id", "generation", "rev", "score")
    return rv.score_delta(scored)


@register
def j03_delta_stream(spark, sf):
    """A turn's number is its second of 2 January 1970; within a day of lateness no turn is late, whatever file it is in."""
    stream = turns(st.table_stream(spark, sf, "conversations.parquet")).withColumn("ts", F.timestamp_seconds(c("rev") + 86400))
    scored = st.score_stream(stream, keep=("generation", "rev", "ts")).select("doc_id", "generation", "rev", "score", "ts")
    changes = lambda s: sl.change_stream(s, "ts", "1 day", keep_seconds=86400)
    return sl.run_to_end([(scored, "ts")], st.work_folder(spark, "deltas"), changes)


@register
def j04_match_stream(spark, sf):
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    stream = st.table_stream(spark, sf, "conversations.parquet").select(
        c("conv_id").alias("doc_id"), c("turn").alias("rev"), (c("conv_id") % n).alias("posting_id"), "text"
    )
    mined = tm.mine_terms(postings(spark, sf), STOP, SKILLS)
    return st.run_available(st.match_stream(stream, mined), st.work_folder(spark, "matches"))


@register
def j04_compare_stream(spark, sf):
    """Every third turn, from the second on, asks for a comparison with another posting from then on."""
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    timed = st.table_stream(spark, sf, "conversations.parquet").select(
        c("conv_id").alias("doc_id"), c("turn").alias("rev"), F.timestamp_seconds(c("turn") + 86400).alias("ts"), "text"
    )
    asked = timed.filter("rev % 3 = 1").select("doc_id", ((c("doc_id") + c("rev")) % n).alias("posting_id"), c("ts").alias("asked_at"))
    mined = tm.mine_terms(postings(spark, sf), STOP, SKILLS)
    build = lambda a, r: st.match_stream(sl.comparisons(a, r, "1 day", 86400), mined)
    return sl.run_to_end([(asked, "asked_at"), (timed, "ts")], st.work_folder(spark, "compare"), build)


@register
def f02_flagship(spark, sf):
    return flagship(spark, sf)


@register
def a07_report_tables(spark, sf):
    path = st.work_folder(spark, "report")
    sinks.write_report_tables(score_documents(structured(spark, sf)), path)
    stored = spark.read.parquet(f"{path}/check_results")
    return sc.category_scores(stored)


def streamed_reports(spark, sf):
    """The folder with the report tables of the documents taken as a stream."""
    path = st.work_folder(spark, "report-stream")
    stream = st.table_stream(spark, sf, "documents.parquet").select("doc_id", "text").repartition(32)  # one small file
    sinks.report_stream(score_documents(structured_documents(stream)), path).trigger(availableNow=True).start().awaitTermination()
    return path


@register
def a07_report_stream(spark, sf):
    return sc.category_scores(spark.read.parquet(f"{streamed_reports(spark, sf)}/check_results"))


@register
def a07_report_stream_actions(spark, sf):
    return spark.read.parquet(f"{streamed_reports(spark, sf)}/actions").drop("batch")


@register
def a07_report_stream_reports(spark, sf):
    stored = spark.read.parquet(f"{streamed_reports(spark, sf)}/reports")
    return stored.select("doc_id", "score", "total_score", "total_weight", "band_id")


@register
def a08_report_markdown(spark, sf):
    text = sinks.report_markdown(reports(structured(spark, sf)))
    lines = F.split("markdown", "\n")
    keep = F.filter(lines, lambda x: x.rlike("^(# |## |[*][*]Score|Source: |### )|% [(]"))
    marks = F.transform(F.filter(lines, lambda x: x.rlike(r"^- \[")), lambda x: F.substring(x, 3, 3))
    return text.select("doc_id", F.array_join(keep, "\n").alias("outline"), F.array_join(marks, "").alias("marks"))


@register
def a09_report_file_name(spark, sf):
    docs = structured(spark, sf)
    return docs.select("doc_id", sinks.report_file_name(c("file_name"), F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("name"))


@register
def a08_markdown_with_posting(spark, sf):
    from docassay.catalog_terms import mined, pairs
    from docassay.operators import matching as mt

    docs = structured(spark, sf)
    texts = docs.select("doc_id", "text")
    best = mt.match_report(mt.match_postings(texts, mined(spark, sf), pairs(spark, sf)))
    one = best.groupBy("doc_id").agg(F.min_by(F.struct("coverage", "skill_coverage", "matched", "missing"), "posting_id").alias("m"))
    joined = reports(docs).join(one.select("doc_id", "m.*"), "doc_id", "left")
    text = sinks.report_markdown(joined)
    line = F.filter(F.split("markdown", "\n"), lambda x: x.startswith("Has ") | x.startswith("**Present") | x.startswith("**Absent"))
    return text.select("doc_id", F.array_join(line, "\n").alias("posting_part"))


@register
def l01_rule_packs(spark, sf):
    """Three packs from a table of parameters, in one pass."""
    rows = [("plain", None, None, None), ("strict", "cut", "impact.verbs.pass", 0.9), ("strict", "cut", "hygiene.length.most", 500.0), ("skills", "weight", "skills.named", 20.0), ("skills", "weight", "impact.metrics", 3.0)]
    packs = packs_from(spark.createDataFrame(rows, "pack string, kind string, name string, value double"))
    return score_packs(structured(spark, sf), packs).select("doc_id", "pack", "score", "total_score", "total_weight")
