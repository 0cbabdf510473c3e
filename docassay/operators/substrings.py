"""Which phrases of a large list stand anywhere in a text, as an equi-join.

Every phrase is keyed by the rarest of its runs of ``q`` characters (a shorter phrase by itself);
texts are joined on the runs they hold, and only the candidates are looked up in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.rows import explode_values, pin
from docassay.operators.matching import stored

#: Characters of a run; candidates of a text that are looked up in one row.
GRAM, TOGETHER = 5, 2048


def gram_rows(df: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """``(key, gram)``: the distinct runs of each of ``lengths`` characters; time is linear in the text.

    The characters are pinned: within a lambda the split would be repeated for every run.
    """
    df = pin(df.select(key, F.when(F.col(text) != "", F.split(text, "")).otherwise(F.array().cast("array<string>")).alias("chars")), "chars", F.col("chars"))
    chars = F.col("chars")

    def of(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        first = F.sequence(F.lit(0), F.size(chars) - n)
        runs = F.transform(first, lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))
        return F.when(F.size(chars) >= n, runs).otherwise(F.array().cast("array<string>"))

    return explode_values(df.select(key, F.array_distinct(F.concat(*[of(n) for n in lengths])).alias("g")), [key], "g", "gram")


def phrase_scan(docs: DataFrame, phrases: DataFrame, q: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """``(doc_id, phrase)`` for every phrase contained anywhere in the lower-cased text, each once.

    ``docs`` is ``(doc_id, text)`` with distinct ids, ``phrases`` is ``(phrase)``. Phrases are taken
    as they are; one with capitals stands nowhere. An empty phrase stands in every text, a null text
    or phrase holds or is none. The runs of the texts are counted first: a phrase with a run that no
    text has goes, and the rarest run bounds the candidates. A text crosses an exchange once for
    every ``together`` candidates it has.
    """
    wanted = phrases.select("phrase").distinct().filter("phrase is not null")
    lengths = [r[0] for r in wanted.select(F.least(F.length("phrase"), F.lit(q)).alias("n")).distinct().collect()]  # q + 1 at most
    if not lengths:
        return docs.select("doc_id").limit(0).join(wanted.limit(0), how="cross")
    lower = docs.filter("text is not null").select("doc_id", F.lower("text").alias("lower"))
    held = gram_rows(lower, "doc_id", "lower", sorted(lengths))
    short = wanted.filter(F.length("phrase") < q).select("phrase", F.col("phrase").alias("gram"))
    parts = stored(short.union(gram_rows(wanted.filter(F.length("phrase") >= q), "phrase", "phrase", [q])), "phrase-grams")
    counts = held.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # Stored, so that lists of usual length are broadcast and the runs of the texts never move.
    keys = stored(parts.join(counts, "gram", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")
    ).filter("k.n > 0").select("phrase", F.col("k.gram").alias("gram")), "phrase-keys")
    found = stored(held.join(keys, "gram").select("doc_id", "phrase"), "phrase-candidates")
    # A text's candidates in lists of bounded length, so that a text of many does not gather them in one row.
    lists = found.groupBy("doc_id").agg(F.ceil(F.count("*") / together).alias("lists"))
    listed = found.join(lists, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("phrase"), F.col("lists")).alias("list")).agg(
        F.collect_list("phrase").alias("phrases")
    )
    both = listed.join(lower, "doc_id").select("doc_id", F.filter("phrases", lambda p: F.contains(F.col("lower"), p)).alias("phrases"))
    return explode_values(both, ["doc_id"], "phrases", "phrase")
