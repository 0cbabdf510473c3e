"""Mix sources to target weights by Pareto order sampling.

A document's expected copies are its source's target over its source's size. The whole part is
copied with certainty. For the rest, documents are ranked by random odds over inclusion odds, and a
source takes them in that order until its words are as near to its target as they get: the size of
the sample is fixed in words. Inclusion odds fall with a document's size, from twice those of a
document of its source's mean size towards none, so that a few huge texts do not make up a sample. No source is ever sorted in one task: a histogram of 2**16 ranges of
the rank finds the range in which a source's sample ends, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import stored, table

WEIGHTS = (5, 2, 1)
RANGES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """``sizes`` (source, source_size and any more) with weight and target: ``share`` of all words by weight, at most ``cap`` times a source.

    The sources reaching their cap are those with the smallest size for their weight, so one pass
    over the (few) sources in that order shares out all the excess. Weights go round by code point
    order of the source, null last. All sums are of integers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long"))
    unit = 1
    for w in weights:
        unit *= w
    order = Window.orderBy(F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "caps": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
            "onward": F.sum("weight").over(onward),
        }
    )
    num, den = share
    left = F.lit(num) * F.col("total") - F.lit(den) * F.col("caps")
    full = left * F.col("weight") > F.lit(den * cap) * F.col("source_size") * F.col("onward")
    s = s.withColumns({"full": full, "left": left})
    level = F.first(F.when(~F.col("full"), F.struct("left", "onward")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    s = s.withColumn("level", level)
    shared = (F.col("level.left") * F.col("weight")).cast("double") / (F.lit(den) * F.col("level.onward")).cast("double")
    return s.select(
        *sizes.columns, "weight",
        F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(shared).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2, seed: str = "mix") -> DataFrame:
    """``(doc_id, source)`` with size, source_size, target, copies and taken words.

    Null or empty texts have size 0. The draw depends on doc_id and seed, so runs agree; repeated
    rows are drawn one after the other. A null doc_id draws like an empty one; a null source is a
    source of its own.
    """
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u")), "sizes"
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum("size") / F.count("*")).alias("mean")), weights, share, cap)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("sure", F.floor(copies)).select(
        F.col("source").alias("_source"), "source_size", "mean", "target", "sure", (copies - F.col("sure")).alias("part"),
        (F.col("target") - F.col("sure") * F.col("source_size")).alias("rest"),
    )
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) * ((F.lit(1.0) - F.col("part")) / F.col("part"))
    odds = odds * ((F.col("mean") + F.col("size")) / (F.lit(2.0) * F.col("mean")))
    ranked = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("rank", F.when(F.col("part") > 0, odds / (F.lit(1.0) + odds)).otherwise(F.lit(1.0)))
    ranked = ranked.withColumn("range", F.floor(F.col("rank") * RANGES))
    # One range of one source after the other: at most RANGES rows for a source.
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranked.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .filter(F.col("ahead") < F.col("rest"))
        .groupBy("source").agg(F.max(F.struct("range", "ahead")).alias("end"))
        .select(F.col("source").alias("_source"), F.col("end.range").alias("end"), F.col("end.ahead").alias("ahead"))
    )
    placed = ranked.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    last = placed.filter(F.col("range") == F.col("end"))
    earlier = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    # The document at the edge is in if that brings the words nearer to the target.
    last = last.withColumn("drawn", 2 * F.col("before") + F.col("size") < 2 * F.col("rest")).drop("before")
    others = placed.filter(~F.coalesce(F.col("range") == F.col("end"), F.lit(False)))
    others = others.withColumn("drawn", F.coalesce(F.col("range") < F.col("end"), F.lit(False)))
    drawn = last.unionByName(others)
    n = (F.col("sure") + F.col("drawn").cast("long")).cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT / count(*) AS mean,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
      FROM sized GROUP BY source),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
             coalesce(2 * sum(source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
             sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS onward
      FROM s WINDOW q AS (ORDER BY source_size * (10 // w), source NULLS LAST)),
f AS (SELECT *, 3 * total - 2 * caps AS spare, (3 * total - 2 * caps) * w > 4 * source_size * onward AS capped FROM o),
l AS (SELECT spare AS lspare, onward AS lonward FROM f WHERE NOT capped ORDER BY caps, onward DESC LIMIT 1),
t AS (SELECT source, source_size, mean,
             CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (lspare * w)::DOUBLE / (2 * lonward)::DOUBLE END AS target
      FROM f, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies FROM t),
p AS (SELECT *, floor(copies) AS sure, copies - floor(copies) AS part, target - floor(copies) * source_size AS rest FROM c),
r AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.sure, p.rest,
             CASE WHEN part > 0 THEN (u / (1.0 - u)) * ((1.0 - part) / part) * ((mean + size) / (2.0 * mean)) END AS odds
      FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, CASE WHEN odds IS NULL THEN 1.0 ELSE odds / (1.0 + odds) END AS rnk FROM r),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       (size * (sure + CASE WHEN 2 * before + size < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM w
"""


def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
