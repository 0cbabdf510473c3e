"""File intake: tell readable files from those that need another format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions.patterns import java

#: reason -> message for the person who sent the file
MESSAGES = {
    "empty": "The file has no content.",
    "too_large": "The file is larger than allowed.",
    "old_word": "Old Word files are not read; save as .docx or PDF.",
    "apple_pages": "Export the file to PDF or Word first.",
    "unknown": "Send a PDF, a Word file (.docx) or plain text.",
}


def classify(path: Column, length: Column, head: Column, limit: int) -> tuple[Column, Column]:
    """``(kind, reason)``: exactly one of them is set. Name decides first, then magic bytes."""
    name = F.lower(path)
    kind = (
        F.when(name.rlike(r"[.](txt|md)\z"), F.lit("text"))
        .when(name.endswith(".rtf"), F.lit("rtf"))
        .when(name.rlike(r"[.](doc|pages)\z"), F.lit(None).cast("string"))
        .when(name.endswith(".pdf") | (F.substring(head, 1, 4) == F.encode(F.lit("%PDF"), "UTF-8")), F.lit("pdf"))
        .when(name.endswith(".docx") | (F.substring(head, 1, 2) == F.encode(F.lit("PK"), "UTF-8")), F.lit("docx"))
    )
    reason = (
        F.when(length == 0, F.lit("empty"))
        .when(length > limit, F.lit("too_large"))
        .when(name.endswith(".doc"), F.lit("old_word"))
        .when(name.endswith(".pages"), F.lit("apple_pages"))
        .when(kind.isNull(), F.lit("unknown"))
    )
    return F.when(reason.isNull(), kind), reason


SCHEMA = "path string, file_name string, length long, kind string, reason string, message string, content binary"


def one_form(path: Column) -> Column:
    """Spark's sources write ``file:/``, Hadoop's and inventories also ``file:///``."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def listed(spark: SparkSession, path: str, tasks: int = 64) -> DataFrame:
    """``(path)`` of every file of a folder, those of length 0 among them, as rows of a scan.

    Spark's own file sources leave files of length 0 out. Hadoop's input splits do not; only their
    keys are read here, inside the JVM, no content and nothing through Python or the driver.
    """
    names = spark.sparkContext._jsc.binaryFiles(path, tasks).keys().rdd()
    jvm = spark.sparkContext._jvm
    frame = DataFrame(spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    return frame.select(one_form(F.col("value")).alias("path"))


def intake_files(spark: SparkSession, path: str, limit: int = lx.MAX_FILE_BYTES, inventory: DataFrame | None = None) -> DataFrame:
    """``(path, file_name, length, kind, reason, message, content)``; rejects carry no content.

    The length bound is pushed into the scan that reads content, so files beyond it are never opened;
    their rows come from a scan of names and lengths. Files of length 0 come from ``inventory``
    (``path, length``; object stores write such tables), by default from :func:`listed`.
    """
    source = spark.read.format("binaryFile").load(path)
    no_content = F.lit(None).cast("binary").alias("content")
    readable = source.filter(F.col("length") <= limit).select(one_form(F.col("path")).alias("path"), "length", "content")
    beyond = source.filter(F.col("length") > limit).select(one_form(F.col("path")).alias("path"), "length", no_content)
    if inventory is None:
        empty = listed(spark, path).join(source.select(one_form(F.col("path")).alias("path")), "path", "left_anti")
    else:
        empty = inventory.filter("length = 0").select(one_form(F.col("path")).alias("path"))
    files = readable.union(beyond).union(empty.select("path", F.lit(0).cast("long").alias("length"), no_content))
    kind, reason = classify(F.col("path"), F.col("length"), F.col("content"), limit)
    messages = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return files.select(
        "path", F.regexp_extract("path", r"[^/]+\z", 0).alias("file_name"), "length", kind.alias("kind"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.element_at(messages, reason)).alias("message"), F.when(reason.isNull(), F.col("content")).alias("content"),
    )


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows of a frame with a ``reason`` column."""
    return df.filter(F.col("reason").isNull()), df.filter(F.col("reason").isNotNull())


def strip_rtf(raw: Column) -> Column:
    """Plain text of an RTF body: escapes, breaks, tabs, hidden groups, control words, braces."""
    parts = F.split(raw, r"\\'(?=[0-9A-Fa-f]{2})")
    decoded = F.transform(
        parts,
        lambda p, i: F.when(
            i > 0,
            F.concat(
                F.decode(F.unhex(F.concat(F.lit("00"), F.left(p, F.lit(2)))), "UTF-16BE"),
                F.substr(p, F.lit(3)),
            ),
        ).otherwise(p),
    )
    text = F.array_join(decoded, "")
    text = F.regexp_replace(text, java(r"\\pard?\b"), "\n")
    text = F.regexp_replace(text, java(r"\\line\b"), "\n")
    text = F.regexp_replace(text, java(r"\\tab\b"), "   ")
    text = F.regexp_replace(text, r"\{\\\*[^{}]*\}", "")
    text = F.regexp_replace(text, java(r"\\[a-zA-Z]+-?[0-9]*\s?"), "")
    text = F.regexp_replace(text, "[{}]", "")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def text_files(intake: DataFrame) -> DataFrame:
    """Readable text of the accepted ``text`` and ``rtf`` files, ready for scoring; the id is the SHA-256 of the path."""
    body = F.decode("content", "UTF-8")
    return intake.filter(F.col("kind").isin("text", "rtf")).select(
        F.sha2("path", 256).alias("doc_id"), "file_name",
        F.when(F.col("kind") == "rtf", strip_rtf(body)).otherwise(body).alias("text"),
    )
