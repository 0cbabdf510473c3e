"""Queries on positioned text and paragraph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.catalog import PARTS, c, joined, prose, register
from docassay.functions import text as tx
from docassay.functions.rows import explode_rows, explode_values, keep_where
from docassay.operators import layout as ly
from docassay.sources.corpus import read_corpus


def fragments(spark, sf):
    """Every word of the documents as a placed text run, 300 to a page, ten to a row."""
    f = prose(spark, sf).select("doc_id", F.posexplode_outer(tx.words(c("text"))).alias("ord", "text")).filter(c("text").isNotNull())
    col, base = c("ord") % 10, F.lit(800.0) - F.floor(c("ord") % 300 / 10) * 16.0
    shift = F.when((c("doc_id") % 4 == 0) & (col >= 5), 190.0).otherwise(0.0)
    x = F.lit(60.0) + col * 50.0 + shift + F.when((c("doc_id") % 9 == 1) & (c("ord") % 20 < 10), 300.0).otherwise(0.0)
    return f.select(
        "doc_id", (F.floor(c("ord") / 300) + 1).cast("int").alias("page"), F.lit(595.0).alias("page_width"), "ord",
        x.alias("x"), (x + F.length("text") * 5.0).alias("right"), (base - (c("ord") % 4) * 0.875).alias("y"),
        (c("ord") % 3 + 10.0).alias("size"), "text",
    )


def doc_pages(spark, sf):
    """Pages of each document, with an empty one at the end of every fifth."""
    n = F.ceil(F.size(tx.words(c("text"))) / 300).cast("int") + F.when(c("doc_id") % 5 == 0, 1).otherwise(0)
    docs = read_corpus(spark, f"{sf}/documents.parquet").select("doc_id", n.alias("n"))
    docs = keep_where(docs, c("n") > 0)
    return explode_values(docs, ["doc_id"], F.sequence(F.lit(1), c("n")), "page")


def blocks(spark, sf):
    """Lines of the documents as paragraphs with list, text-box and table-row marks."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("ord"), x.alias("text")))
    b = explode_rows(prose(spark, sf), ["doc_id"], lines)
    d, o = c("doc_id"), c("ord")
    soft = F.when(o % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n"))).otherwise(c("text"))
    return b.select(
        "doc_id", "ord", soft.alias("text"), (o % 3 == 1).alias("is_list"),
        ((d + o) % 11 == 0).alias("from_textbox"), ((d % 4 == 0) & (o % 3 == 0)).alias("is_table_row"),
    )


def headers(spark, sf):
    d = c("doc_id")
    return prose(spark, sf).select(
        "doc_id", F.when(d % 3 == 0, F.lit("asha@example.com")).otherwise(F.lit("page")).alias("header_text"),
        (d % 3).cast("int").alias("media_count"), F.nullif(d % 4, F.lit(0)).cast("int").alias("page_count"),
    )


def lines(spark, sf):
    return ly.group_into_lines(fragments(spark, sf))


@register
def c01_group_into_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "page", "anchor", "y", "x", "right")


@register
def c02_split_clusters(spark, sf):
    rows = F.transform("clusters", lambda k, i: F.struct(
        i.alias("k"), k["x"].alias("x"), k["right"].alias("right"), k["words"].alias("words")))
    return explode_rows(lines(spark, sf), ["doc_id", "page", "anchor"], rows)


@register
def c03_row_text(spark, sf):
    return lines(spark, sf).select("doc_id", "page", "anchor", "text", "size")


@register
def c04_split_rows(spark, sf):
    return keep_where(ly.row_flags(lines(spark, sf)), c("split_row")).select("doc_id", "page", "anchor")


@register
def c05_tabular_rows(spark, sf):
    return keep_where(ly.row_flags(lines(spark, sf)), c("tabular_row")).select("doc_id", "page", "anchor")


@register
def c06_right_starts(spark, sf):
    return keep_where(ly.row_flags(lines(spark, sf)), c("right_start")).select("doc_id", "page", "anchor", "x")


@register
def c07_image_only_pages(spark, sf):
    p = ly.image_only_pages(lines(spark, sf), doc_pages(spark, sf))
    return p.select("doc_id", joined(c("image_only_pages").cast("array<string>"), ",").alias("pages"), "page_count")


def _meta(df):
    m = c("meta")
    return df.select(
        "doc_id", "source_kind", "page_count", F.md5("text").alias("text_md5"), m["text_density"].alias("text_density"),
        joined(m["image_only_pages"].cast("array<string>"), ",").alias("image_only_pages"),
        m["multi_column"].alias("multi_column"), m["right_column_ratio"].alias("right_column_ratio"),
        m["broken_glyphs"].alias("broken_glyphs"), m["tabular_rows"].alias("tabular_rows"),
        m["text_box_chars"].alias("text_box_chars"), m["image_count"].alias("image_count"),
        m["contact_in_header_only"].alias("contact_in_header_only"),
    )


@register
def c08_layout_meta(spark, sf):
    return _meta(ly.layout_documents(fragments(spark, sf), doc_pages(spark, sf)))


@register
def c09_broken_glyphs(spark, sf):
    odd = F.when(c("doc_id") % 2 == 0, F.regexp_replace("text", "[aeo]", "9")).otherwise(c("text"))
    return prose(spark, sf).select("doc_id", ly.broken_glyphs(odd).alias("broken"))


@register
def c10_layout_warnings(spark, sf):
    pdf = ly.layout_documents(fragments(spark, sf), doc_pages(spark, sf))
    docx = ly.block_documents(blocks(spark, sf), headers(spark, sf))
    both = pdf.unionByName(docx)
    return both.select("doc_id", "source_kind", joined(ly.layout_warnings(c("meta"), c("page_count"))).alias("warnings"))


@register
def c11_lines_from_blocks(spark, sf):
    return ly.lines_from_blocks(blocks(spark, sf)).select("doc_id", "ord", "part", "text", "bullet")


@register
def c12_block_meta(spark, sf):
    return _meta(ly.block_documents(blocks(spark, sf), headers(spark, sf)))


@register
def c13_merge_hyperlinks(spark, sf):
    pages = read_corpus(spark, f"{sf}/pages.parquet", "page_id", "html", keep=("url",), partitions=PARTS)
    hrefs = F.regexp_extract_all("text", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    links = explode_values(pages.select("doc_id", hrefs.alias("h")), ["doc_id"], "h", "url")
    mails = pages.select("doc_id", F.concat(F.lit("mailto:page"), c("doc_id").cast("string"), F.lit("@example.com")).alias("url"))
    merged = ly.merge_hyperlinks(links, pages.select("doc_id", "url"), mails)
    return merged.select("doc_id", joined("hyperlinks", " ").alias("hyperlinks"))
