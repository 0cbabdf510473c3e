"""Facts of a document: lines, words, list items, sections.

One row in, one row out. Nothing is exploded, so no document ever crosses a shuffle to be
analysed, whatever the size of the corpus or of a single source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay import lexicon as lx
from docassay.functions import extract, text as tx
from docassay.functions.patterns import WS, java
from docassay.functions.rows import explode_rows, pin

META = T.StructType(
    [
        T.StructField("text_density", T.LongType()),
        T.StructField("image_only_pages", T.ArrayType(T.IntegerType())),
        T.StructField("multi_column", T.BooleanType()),
        T.StructField("right_column_ratio", T.DoubleType()),
        T.StructField("broken_glyphs", T.BooleanType()),
        T.StructField("tabular_rows", T.LongType()),
        T.StructField("text_box_chars", T.LongType()),
        T.StructField("image_count", T.LongType()),
        T.StructField("contact_in_header_only", T.BooleanType()),
    ]
)


def plain_meta(density: Column) -> Column:
    """Layout facts of a document that has no layout."""
    return F.struct(
        density.cast("long").alias("text_density"),
        F.array().cast("array<int>").alias("image_only_pages"),
        F.lit(False).alias("multi_column"),
        F.lit(0.0).alias("right_column_ratio"),
        F.lit(False).alias("broken_glyphs"),
        F.lit(0).cast("long").alias("tabular_rows"),
        F.lit(0).cast("long").alias("text_box_chars"),
        F.lit(0).cast("long").alias("image_count"),
        F.lit(False).alias("contact_in_header_only"),
    )


def estimate_pages(lines: Column) -> Column:
    """Pages a text would fill at 46 lines each, at least one."""
    filled = F.size(F.filter(lines, lambda x: ~tx.is_blank(x)))
    return F.greatest(F.lit(1), F.ceil(filled / F.lit(lx.LINES_PER_PAGE)).cast("int"))


def text_documents(df: DataFrame) -> DataFrame:
    """Turn ``(doc_id, text, ...)`` rows into the document contract.

    Adds whatever is missing of ``source_kind, file_name, page_count, meta, hyperlinks``.
    """
    df = pin(df, "text", tx.normalise_text(F.col("text")))
    have = set(df.columns)
    add = {}
    if "source_kind" not in have:
        add["source_kind"] = F.lit("text")
    if "file_name" not in have:
        add["file_name"] = F.lit(None).cast("string")
    if "page_count" not in have:
        add["page_count"] = estimate_pages(tx.split_lines(F.col("text")))
    if "meta" not in have:
        add["meta"] = plain_meta(tx.char_count(F.col("text")))
    if "hyperlinks" not in have:
        add["hyperlinks"] = extract.urls(F.col("text"))
    return df.withColumns(add) if add else df


def heading_text(trimmed: Column) -> Column:
    """The bare lower-case words of a trimmed line that may be a heading, else null."""
    plausible = (
        F.length(trimmed).between(1, 60)
        & ~trimmed.rlike(r"[.!?,;]\z")
        & ~tx.is_bullet(trimmed)
    )
    bare = F.regexp_replace(trimmed, "^[^A-Za-z0-9]+", "")
    bare = F.regexp_replace(bare, java(r"[\s:_–—=|-]+\z"), "")
    return F.when(plausible, F.lower(bare))


def section_key(bare: Column) -> Column:
    """Key of the section named by a bare heading of up to five words, or null."""
    key = F.lit(None).cast("string")
    for name, _, _, pattern in reversed(lx.SECTION_HEADINGS):
        key = F.when(bare.rlike(java(pattern)), F.lit(name)).otherwise(key)
    return F.when(F.size(F.split(bare, WS + "+")) <= 5, key)


def heading_key(line: Column) -> Column:
    """Key of the section a line opens, or null."""
    return section_key(heading_text(tx.js_trim(line)))


def heading_positions(trimmed_lines: Column) -> Column:
    """Headings as ``(key, heading, pos)``, in order; ``pos`` counts from 0."""
    bare = F.transform(
        trimmed_lines,
        lambda x, i: F.struct(heading_text(x).alias("bare"), x.alias("heading"), i.alias("pos")),
    )
    marks = F.transform(
        F.filter(bare, lambda m: m["bare"].isNotNull()),
        lambda m: F.struct(
            section_key(m["bare"]).alias("key"),
            m["heading"].alias("heading"),
            m["pos"].alias("pos"),
        ),
    )
    return F.filter(marks, lambda m: m["key"].isNotNull())


def cut_sections(trimmed_lines: Column, headings: Column) -> Column:
    """Attach to every heading the filled lines up to the next one."""

    def build(h: Column, i: Column) -> Column:
        following = F.get(headings, i + 1)["pos"]
        end = F.coalesce(following, F.size(trimmed_lines))
        body = tx.between(trimmed_lines, h["pos"] + 1, end - 1)
        return F.struct(
            h["key"].alias("key"),
            h["heading"].alias("heading"),
            h["pos"].alias("line_index"),
            F.filter(body, lambda x: x != "").alias("body"),
        )

    return F.transform(headings, build)


def build_facts(docs: DataFrame) -> DataFrame:
    """Add every fact the rules share. Staged so that no regex runs twice on a row."""
    c = F.col
    staged = docs.withColumns(
        {
            "lower": F.lower(c("text")),
            "lines": tx.split_lines(c("text")),
            "word_count": tx.word_count(c("text")),
            "char_count": tx.char_count(c("text")),
        }
    )
    staged = staged.withColumn("trimmed", F.transform("lines", tx.js_trim))
    staged = staged.withColumns(
        {
            "nonblank": F.filter("trimmed", lambda x: x != ""),
            "bullets": tx.bullet_texts(c("trimmed")),
            "header": tx.header(c("lines")),
            "headings": heading_positions(c("trimmed")),
        }
    )
    staged = staged.withColumn("sections", cut_sections(c("trimmed"), c("headings")))
    return staged.withColumn(
        "section_keys", F.array_distinct(F.transform("sections", lambda s: s["key"]))
    )


def lines_table(docs: DataFrame) -> DataFrame:
    """One row per line: ``(doc_id, pos, text, bullet, page)``."""
    numbered = F.transform(
        tx.split_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), x.alias("text"))
    )
    return explode_rows(docs, ["doc_id"], numbered).select(
        "doc_id", "pos", "text", tx.is_bullet(F.col("text")).alias("bullet"), F.lit(1).alias("page")
    )


def sections_table(facts: DataFrame) -> DataFrame:
    """One row per section: ``(doc_id, section_ord, key, heading, line_index, body)``."""
    numbered = F.transform(
        "sections",
        lambda s, i: F.struct(
            i.alias("section_ord"), s["key"].alias("key"), s["heading"].alias("heading"),
            s["line_index"].alias("line_index"), s["body"].alias("body"),
        ),
    )
    return explode_rows(facts, ["doc_id"], numbered)


def facts_summary(facts: DataFrame) -> DataFrame:
    """Counts shown at the top of a report."""
    return facts.select(
        "doc_id",
        "word_count",
        F.col("char_count").cast("int").alias("char_count"),
        F.size("bullets").alias("bullet_count"),
        "page_count",
        F.size("sections").alias("section_count"),
    )
