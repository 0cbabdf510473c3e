"""A corpus pipeline: each stage takes what the one before it kept, written as Parquet and read again.

Every stage returns all columns of its input, unchanged but for ``text`` and ``n_chars`` after line
dedup, whatever their names: an operator sees doc_id, text, lang and source, and the other columns
pass it by in one struct. Null, empty and blank texts, empty tables and repeated rows are stated at
each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.common import stored, table
from docassay.llm.decontam import LEAST_WORDS, contaminated
from docassay.llm.langid import UNKNOWN, identify, prototypes
from docassay.llm.linededup import dedup_lines
from docassay.llm.mixing import mix_sources
from docassay.llm.neardup import near_duplicates


def aside(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but text as a struct ``rest``, which no operator looks into."""
    return docs.select("doc_id", "text", F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("rest"))


def back(packed: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as they were before ``aside``, those in ``new`` replaced."""
    return packed.select(*[new.get(c, F.col("text") if c == "text" else F.col("rest").getField(c)).alias(c) for c in columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (text null, empty or without a letter) go; rows of one doc_id are judged one by one.

    Where no row has a lang and a text, nothing can be learned and nothing is rejected.
    """
    profiles = prototypes(docs)
    if not profiles:
        return docs
    return back(identify(aside(docs), profiles).filter(F.col("lang_pred") != UNKNOWN), docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller doc_id has go; n_chars follows the text. No row goes.

    A null text becomes an empty one. Rows of one doc_id lose the same lines, rows without doc_id none.
    """
    return back(dedup_lines(aside(docs)), docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays.

    Null, empty and blank texts are classes of their own. Of several rows of a doc_id one stays, the
    first by text with null last (of equal texts any); rows without doc_id all stay.
    """
    others = near_duplicates(docs.select("doc_id", "text")).filter("doc_id <> class_id").select(F.col("doc_id").alias("other")).distinct()
    kept = docs.join(others, docs["doc_id"] == others["other"], "left_anti")
    repeated = kept.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("again"))
    repeated = stored(repeated, "repeated-ids")
    once = kept.join(repeated, kept["doc_id"] == repeated["again"], "left_anti")
    several = kept.join(repeated, kept["doc_id"] == repeated["again"], "left_semi")
    first = F.min_by(F.struct("text", "rest"), F.struct(F.col("text").isNull(), "text"))
    several = aside(several).groupBy("doc_id").agg(first.alias("one")).select("one.*")
    return once.unionByName(back(several, docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, with all rows of their doc_id; rows without doc_id or text stay."""
    leaks = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), least=LEAST_WORDS)
    leaks = leaks.select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["leak"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is in it, with its copies and the words it gives. Texts without a word give none."""
    return mix_sources(docs.select("doc_id", "source", "text")).filter("copies > 0")


STAGES = [
    ("language id", known_language),
    ("line dedup", own_lines),
    ("near-duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: ProbMinHash and the learned language profiles have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
