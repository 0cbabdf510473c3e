"""Score a corpus: documents -> facts -> signals -> branches -> report row.

The whole plan is one narrow stage. There is no shuffle, so throughput grows with the number of
cores and a source holding a third of the corpus is just more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.functions.rows import explode_rows, pin
from docassay.operators import scoring
from docassay.operators.facts import build_facts
from docassay.operators.rulepack import RulePack
from docassay.operators.rules import default_pack
from docassay.operators.signals import add_signals

REPORT = ("word_count", "char_count", "bullet_count", "page_count", "section_count")


def decide(docs: DataFrame, pack: RulePack | None = None, lists: dict | None = None) -> DataFrame:
    """Documents with facts, signals and the branch of every rule."""
    return (pack or default_pack()).decide(add_signals(build_facts(docs), lists))


def score_documents(
    docs: DataFrame,
    pack: RulePack | None = None,
    lists: dict | None = None,
    texts: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One report row per document.

    ``texts=False`` leaves summaries, fixes and evidence out; nothing that only they need is
    computed then. ``keep`` names document columns to carry along.
    """
    pack = pack or default_pack()
    graded = decide(docs, pack, lists).select(
        "doc_id", *keep, "source_kind", "file_name",
        "word_count", "char_count", F.size("bullets").alias("bullet_count"), "page_count",
        F.size("sections").alias("section_count"),
        pack.checks(texts).alias("checks"),
        pack.totals().alias("categories"),
    )
    return scoring.with_scores(pin(graded, "categories", F.col("categories")))


def score_packs(docs: DataFrame, packs: dict[str, RulePack], lists: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, pack, categories, total_score, total_weight, score, band_id)``: every document by every pack.

    Facts and signals are computed once; only branches and totals are each pack's own.
    """
    df, entries = add_signals(build_facts(docs), lists), []
    for i, (name, pack) in enumerate(packs.items()):
        own = pack.apart(i)
        df = own.decide(df)
        entries.append(F.struct(F.lit(name).alias("pack"), own.totals().alias("categories")))
    return scoring.with_scores(explode_rows(df, ["doc_id", *keep], F.array(*entries)))


def reports(docs: DataFrame, pack: RulePack | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Full reports with texts and the five most valuable actions."""
    scored = score_documents(docs, pack, texts=True, keep=keep)
    return scored.withColumn("actions", scoring.top_actions(F.col("checks")))
