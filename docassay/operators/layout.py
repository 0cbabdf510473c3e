"""Layout of positioned text runs and of paragraph tables.

Fragments become rows of text. The fragments of a page move once, as compressed blocks made on the
map side (:mod:`docassay.operators.placing`); a page meets in one row, as its text does in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions import text as tx
from docassay.functions.patterns import WS, java
from docassay.functions.rows import explode_rows, pin
from docassay.operators import placing

BASELINE_TOLERANCE = 2.6
COLUMN_GAP = 0.14
WORD_GAP = 0.8
RIGHT_START = 0.55
MIN_PAGE_CHARS = 120


def anchored_groups(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Add ``anchor``: the first value of the group each row belongs to.

    Going down from the largest value, a row joins the current group while it lies within ``tol``
    of the group's first value (not of its neighbour). Only the distinct values of a key meet; rows
    find their anchor by key and value, so the rows of one key spread. Rows without a key or value
    are dropped.
    """
    groups = F.arrow_udf(lambda lists: placing.anchors_of(lists, tol), "array<struct<value:double,anchor:double>>")
    distinct = df.select(*keys, value).distinct()
    lists = distinct.groupBy(*keys).agg(F.collect_list(F.col(value).cast("double")).alias("_values"))
    mapping = explode_rows(lists.withColumn("_groups", groups("_values")), keys, "_groups")
    return df.join(mapping.withColumnRenamed("value", value), [*keys, value])


def count_words(text: Column) -> Column:
    """Words with a letter or digit; a match takes all of a word from the first of these on."""
    return F.regexp_count(text, F.lit(java(r"[A-Za-z0-9]\S*")))


def page_blocks(fragments: DataFrame) -> DataFrame:
    """``(doc_id, page, block)``: the fragments of a page as they stand together, compressed.

    Fragments without document, page or baseline are dropped.
    """
    placed = fragments.filter("doc_id IS NOT NULL AND page IS NOT NULL AND y IS NOT NULL").select(
        "doc_id", "page", F.array(*[F.col(k).cast("double") for k in placing.NUMBERS]).alias("numbers"), F.col("ord").cast("long").alias("ord"), "text"
    )
    kind = {k: placed.schema[k].dataType.simpleString() for k in ("doc_id", "page")}
    return placed.mapInArrow(placing.pack, f"doc_id {kind['doc_id']}, page {kind['page']}, block binary")


def row_text(row: Column | dict[str, Column]) -> Column:
    """The pieces of a row, joined, with single blanks; ``chars`` is known of those that are so already."""
    return F.when(row["chars"].isNotNull(), row["text"]).otherwise(tx.js_trim(F.regexp_replace(row["text"], WS + "+", " ")))


def group_into_lines(fragments: DataFrame, tol: float = BASELINE_TOLERANCE) -> DataFrame:
    """One row per line of text: position, size, text and its clusters.

    Input ``(doc_id, page, page_width, ord, x, right, y, size, text)``; ``ord`` is a whole number.
    """
    blocks = page_blocks(fragments)
    pages = blocks.repartition("doc_id", "page").groupBy("doc_id", "page").agg(F.collect_list("block").alias("blocks"))
    kind = {k: pages.schema[k].dataType.simpleString() for k in ("doc_id", "page")}
    grouped = pages.mapInArrow(
        lambda batches: placing.rows_of_pages(batches, tol, COLUMN_GAP, WORD_GAP),
        f"doc_id {kind['doc_id']}, page {kind['page']}, rows {placing.ROWS}",
    )
    rows = explode_rows(grouped, ["doc_id", "page"], "rows")
    return rows.withColumn("text", row_text({k: F.col(k) for k in ("chars", "text")})).drop("chars")


def row_kinds(wide: Column, filled: Column, x: Column, page_width: Column) -> dict[str, Column]:
    """What a line of text looks like, by its clusters that may be columns, and those that are cells."""
    return {"split_row": wide >= 2, "tabular_row": filled >= 3, "right_start": x > page_width * RIGHT_START}


def row_flags(lines: DataFrame) -> DataFrame:
    """Add ``split_row, tabular_row, right_start``."""

    def having(n: int) -> Column:
        return F.size(F.filter("clusters", lambda k: k["words"] >= n))

    return lines.withColumns(row_kinds(having(placing.COLUMN_WORDS), having(placing.CELL_WORDS), F.col("x"), F.col("page_width")))


def page_chars(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Characters per page; pages without any text count as 0."""
    sums = lines.groupBy("doc_id", "page").agg(F.sum(tx.char_count(F.col("text"))).alias("chars"))
    return pages.join(sums, ["doc_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))


def image_only_pages(lines: DataFrame, pages: DataFrame, floor: int = MIN_PAGE_CHARS) -> DataFrame:
    """Per document: the pages with fewer than ``floor`` characters, in order."""
    thin = page_chars(lines, pages)
    return thin.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("chars") < floor, F.col("page")))).alias("image_only_pages"),
        F.count(F.lit(1)).cast("int").alias("page_count"),
    )


def broken_glyphs(text: Column) -> Column:
    """200 or more characters that hold replacement marks or mostly no letters."""
    solid = tx.char_count(text)
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return (solid >= 200) & (
        F.contains(text, F.lit("\ufffd")) | (letters / F.nullif(solid, F.lit(0)) < 0.45)
    )


def page_table(pages: Column) -> Column:
    """Per page ``(page, listed, rows)``: its counts and its text, lines in reading order."""

    def line(r: Column) -> Column:
        return F.struct(row_text(r).alias("text"), r["chars"].alias("chars"), *[v.alias(k) for k, v in row_kinds(*[r[k] for k in ("wide", "filled", "x", "page_width")]).items()])

    def table(p: Column) -> Column:
        count = lambda flag: F.size(F.filter(p["lines"], lambda r: r[flag])).alias(f"{flag}s")
        return F.struct(
            p["page"].alias("page"), p["listed"].alias("listed"),
            F.aggregate(p["lines"], F.lit(0), lambda n, r: n + F.coalesce(r["chars"], tx.char_count(r["text"]))).alias("chars"),
            F.size(p["lines"]).alias("rows"), *[count(k) for k in ("split_row", "tabular_row", "right_start")],
            F.array_join(F.transform(p["lines"], lambda r: r["text"]), "\n").alias("page_text"),
        )

    lines = lambda p: F.struct(p["page"].alias("page"), p["listed"].alias("listed"), F.transform(p["rows"], line).alias("lines"))
    return F.transform(F.transform(pages, lines), table)


def layout_documents(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """Document contract (``text, page_count, meta``) of positioned text.

    Blocks of fragments and listed pages meet by document in the only exchange; lines, pages and the
    document are built in its row. A page counts as often as it is listed.
    """
    blocks = page_blocks(fragments).withColumn("listed", F.lit(0))
    listed = pages.select("doc_id", "page", F.lit(None).cast("binary").alias("block"), F.lit(1).alias("listed"))
    both = blocks.unionByName(listed)
    parts = F.sort_array(F.collect_list(F.struct("page", "listed", "block"))).alias("parts")
    met = both.repartition("doc_id").groupBy("doc_id").agg(parts)
    kind = {k: both.schema[k].dataType.simpleString() for k in ("doc_id", "page")}
    placed = met.mapInArrow(
        lambda batches: placing.pages_of_documents(batches, BASELINE_TOLERANCE, COLUMN_GAP, WORD_GAP),
        f"doc_id {kind['doc_id']}, pages array<struct<page:{kind['page']},listed:int,rows:{placing.BRIEF_ROWS}>>",
    )
    tables = pin(placed.filter(F.size("pages") > 0), "tables", page_table(F.col("pages")))
    every = F.flatten(F.transform("tables", lambda t: F.array_repeat(t, t["listed"])))
    total = lambda name: F.aggregate("every", F.lit(0).cast("long"), lambda n, t: n + t[name]).alias(name)
    df = pin(tables.select("doc_id", "tables"), "every", every).select(
        "doc_id",
        F.array_compact(F.transform(F.filter("every", lambda t: t["chars"] < MIN_PAGE_CHARS), lambda t: t["page"])).alias("image_only_pages"),
        F.size("every").alias("page_count"),
        *[total(k) for k in ("rows", "split_rows", "tabular_rows", "right_starts")],
        F.array_join(F.transform(F.filter("every", lambda t: t["rows"] > 0), lambda t: t["page_text"]), "\n").alias("raw"),
    )
    df = pin(df, "text", tx.normalise_text(F.col("raw")))
    share = lambda name: F.coalesce(F.col(name) / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    return df.select(
        "doc_id", "text", F.lit("pdf").alias("source_kind"), "page_count",
        F.struct(
            tx.char_count(F.col("text")).cast("long").alias("text_density"),
            F.col("image_only_pages"),
            ((share("split_rows") >= 0.2) & (F.col("split_rows") >= 4)).alias("multi_column"),
            share("right_starts").alias("right_column_ratio"),
            F.coalesce(broken_glyphs(F.col("text")), F.lit(False)).alias("broken_glyphs"),
            F.col("tabular_rows"),
            F.lit(0).cast("long").alias("text_box_chars"),
            F.size("image_only_pages").cast("long").alias("image_count"),
            F.lit(False).alias("contact_in_header_only"),
        ).alias("meta"),
    )


def layout_warnings(meta: Column, page_count: Column) -> Column:
    """Notes on what the layout may cost."""
    pages = meta["image_only_pages"]
    return F.array_compact(
        F.array(
            F.when(F.size(pages) == 0, F.lit(None))
            .when(F.size(pages) == page_count, F.lit("No text can be selected; this looks like a scan."))
            .otherwise(F.concat(F.lit("Hardly any text on page "), F.array_join(pages.cast("array<string>"), ", "), F.lit("."))),
            F.when(meta["text_box_chars"] > 60, F.lit("Some text is inside boxes, which are often skipped.")),
            F.when(meta["contact_in_header_only"], F.lit("Contact details are only in the page header.")),
        )
    )


# --- paragraph tables -----------------------------------------------------

def lines_from_blocks(blocks: DataFrame) -> DataFrame:
    """Filled lines of paragraphs ``(doc_id, ord, text, is_list, ...)``; list items get a marker."""
    pieces = blocks.select("doc_id", "ord", "is_list", F.posexplode(F.split("text", "\n")).alias("part", "piece"))
    text = tx.js_trim(F.col("piece"))
    filled = pieces.filter(text != "").select("doc_id", "ord", "part", "is_list", text.alias("text"))
    marked = tx.is_bullet(F.col("text"))
    return filled.select(
        "doc_id", "ord", "part",
        F.when(F.col("is_list") & ~marked, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")).alias("text"),
        (F.col("is_list") | marked).alias("bullet"),
    )


def block_documents(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Document contract of paragraph tables; ``headers`` is ``(doc_id, header_text, media_count, page_count)``.

    A document whose page count is unknown has one page.
    """
    lines = lines_from_blocks(blocks)
    ordered = F.sort_array(F.collect_list(F.struct("ord", "part", "text")))
    texts = lines.groupBy("doc_id").agg(
        F.array_join(ordered["text"], "\n").alias("raw"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    sums = blocks.groupBy("doc_id").agg(
        F.sum(F.when(F.col("from_textbox"), tx.char_count(F.col("text"))).otherwise(0)).alias("box"),
        F.count_if("is_table_row").alias("rows"),
    )
    df = sums.join(texts, "doc_id", "left").join(headers, "doc_id", "left")
    df = pin(df, "text", tx.normalise_text(F.coalesce("raw", F.lit(""))))
    contact = java(lx.CONTACT_ANY)
    return df.select(
        "doc_id", "text", F.lit("docx").alias("source_kind"), F.coalesce(F.col("page_count"), F.lit(1)).alias("page_count"),
        F.struct(
            tx.char_count(F.col("text")).cast("long").alias("text_density"),
            F.array().cast("array<int>").alias("image_only_pages"),
            ((F.col("rows") > 0) & (F.col("rows") >= F.coalesce("n_lines", F.lit(0)) * 0.25)).alias("multi_column"),
            F.lit(0.0).alias("right_column_ratio"),
            F.lit(False).alias("broken_glyphs"),
            F.col("rows").alias("tabular_rows"),
            F.col("box").alias("text_box_chars"),
            F.coalesce(F.col("media_count"), F.lit(0)).cast("long").alias("image_count"),
            (F.coalesce(F.col("header_text"), F.lit("")).rlike(contact) & ~F.col("text").rlike(contact)).alias(
                "contact_in_header_only"
            ),
        ).alias("meta"),
    )


def merge_hyperlinks(*links: DataFrame) -> DataFrame:
    """Distinct ``http(s)`` and ``mailto`` targets per document from several ``(doc_id, url)``."""
    both = links[0]
    for more in links[1:]:
        both = both.unionByName(more)
    kept = both.filter(F.col("url").rlike("^(?i:https?://)|^mailto:")).distinct()
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("url")).alias("hyperlinks"))
