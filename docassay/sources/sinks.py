"""Report sinks: tables and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docassay import lexicon as lx
from docassay.functions.phrasing import state_mark
from docassay.functions.text import lookup
from docassay.operators import scoring


def write_report_tables(reports: DataFrame, path: str) -> None:
    """Write ``reports`` by band, then the long tables from what was written."""
    spark = reports.sparkSession
    reports.write.mode("overwrite").partitionBy("band_id").parquet(f"{path}/reports")
    stored = spark.read.parquet(f"{path}/reports")
    scoring.check_results(stored).write.mode("overwrite").parquet(f"{path}/check_results")
    scoring.category_rows(stored).write.mode("overwrite").parquet(f"{path}/category_scores")
    scoring.action_rows(stored).write.mode("overwrite").parquet(f"{path}/actions")


def write_report_batch(reports: DataFrame, path: str, batch_id: int) -> None:
    """One batch of ``reports`` as a partition ``batch`` of every table; writing it again replaces it.

    The long tables are derived from the reports as stored, so they are of the same attempt.
    """
    spark, part = reports.sparkSession, f"batch={batch_id}"
    reports.write.mode("overwrite").partitionBy("band_id").parquet(f"{path}/reports/{part}")
    stored = spark.read.schema(reports.schema).option("basePath", f"{path}/reports/{part}").parquet(f"{path}/reports/{part}")
    for name, rows in (("check_results", scoring.check_results), ("category_scores", scoring.category_rows), ("actions", scoring.action_rows)):
        rows(stored).write.mode("overwrite").parquet(f"{path}/{name}/{part}")


def report_stream(reports: DataFrame, path: str) -> DataStreamWriter:
    """Writer of a stream of ``reports`` into the report tables, each batch exactly once.

    A batch that a restart repeats has the same id and rows and takes the place of its first attempt.
    """
    return reports.writeStream.foreachBatch(lambda df, batch_id: write_report_batch(df, path, batch_id)).option("checkpointLocation", f"{path}/checkpoint")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(col: Column) -> Column:
    return col.cast("string")


def report_markdown(reports: DataFrame, generated: Column | None = None) -> DataFrame:
    """``(doc_id, markdown)``: one text per report row, put together within the row.

    ``reports`` may carry ``coverage, skill_coverage, matched, missing`` of one posting.
    """
    cat_names = {k: v[0] for k, v in lx.CATEGORY_TEXT.items()}
    band_label = lookup(F.col("band_id"), {k: v[0] for k, v in lx.BAND_TEXT.items()})
    band_message = lookup(F.col("band_id"), {k: v[1] for k, v in lx.BAND_TEXT.items()})
    source = F.coalesce(F.col("file_name"), lookup(F.col("source_kind"), lx.SOURCE_TEXT))
    head = F.array(
        F.lit("# Document report"), F.lit(""),
        _text("**Score:** ", _s(F.col("score")), "/100 - ", band_label), F.lit(""),
        band_message, F.lit(""),
        _text("Source: ", source, " · ", _s(F.col("word_count")), " words · ", _s(F.col("bullet_count")),
              " bullets · ", _s(F.col("section_count")), " sections"),
        *([_text("Generated: ", generated)] if generated is not None else []),
        F.lit(""), F.lit("## Areas"), F.lit(""),
    )
    points = lambda k: _text("(", _s(k["score"]), "/", _s(k["weight"]), ")")
    areas = F.transform(
        "categories",
        lambda k: _text("- **", lookup(k["id"], cat_names), "** - ", _s(k["pct"]), "% ", points(k)),
    )
    action = lambda a, i: F.concat(
        _s(i + 1), F.lit(". **"), a["label"], F.lit("** - "), a["summary"],
        F.coalesce(F.concat(F.lit("\n   "), a["fix"]), F.lit("")), F.lit("\n"),
    )
    todo = F.when(F.size("actions") == 0, F.array(F.lit("Nothing is left to do."))).otherwise(
        F.transform("actions", action)
    )
    check = lambda k: F.concat(
        F.lit("- "), state_mark(k["state"]), F.lit(" **"), k["label"], F.lit("** - "), k["summary"],
        F.coalesce(F.concat(F.lit("\n      Fix: "), k["fix"]), F.lit("")),
        F.when(F.size(k["evidence"]) > 0, F.concat(F.lit("\n      Found: "), F.array_join(k["evidence"], ", "))).otherwise(F.lit("")),
    )
    groups = F.transform(
        "categories",
        lambda g: F.concat(
            F.lit("### "), lookup(g["id"], cat_names), F.lit(" "), points(g), F.lit("\n\n"),
            F.array_join(F.transform(F.filter("checks", lambda k: k["category"] == g["id"]), check), "\n"),
            F.lit("\n"),
        ),
    )
    parts = [head, areas, F.array(F.lit(""), F.lit("## First steps"), F.lit("")), todo,
             F.array(F.lit(""), F.lit("## All checks"), F.lit("")), groups]
    if "coverage" in reports.columns:
        named = lambda title, col: F.when(F.col(col) != "", F.concat(F.lit(f"**{title}:** "), F.col(col), F.lit("\n")))
        parts.append(
            F.array_compact(F.array(
                F.lit("## Posting\n"),
                _text("Has ", _s(F.col("coverage")), "% of the terms mined from the posting and ", _s(F.col("skill_coverage")), "% of its tools; this does not move the score.\n"),
                named("Present", "matched"), named("Absent", "missing"),
            ))
        )
    parts.append(F.array(F.lit("---"), F.lit(""), F.lit("A checklist of frequent mistakes, not a verdict by any employer.")))
    return reports.select("doc_id", F.array_join(F.concat(*parts), "\n").alias("markdown"))


def report_file_name(file_name: Column, at: Column, prefix: str = "report") -> Column:
    """``prefix-slug-yyyy-MM-dd.md``; the slug has up to 48 characters."""
    base = F.lower(F.regexp_replace(F.coalesce(file_name, F.lit("resume")), r"[.][^.]+\z", ""))
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), r"^-|-\z", "")
    slug = F.coalesce(F.nullif(F.left(slug, F.lit(48)), F.lit("")), F.lit("resume"))
    return F.concat(F.lit(f"{prefix}-"), slug, F.lit("-"), F.date_format(at, "yyyy-MM-dd"), F.lit(".md"))
