"""How far each source's words are from its language's and from the other sources'.

A pipeline of Arrow kernels inside ``mapInArrow`` lowers, splits, dictionary-encodes and counts terms
batch by batch, so only partial counts leave a task. Counts are merged by key and dealt by term into
columnar shards; every shard compares all sources of a language over its own terms, and its partial
sums are added up. Shares are integers, so every order of adding gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import spans_of, stored, table

#: What stands between terms: every ASCII character that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a kept term; what is added to every count; the unit of shares.
DOCUMENTS, SMOOTHING, UNIT = 30, 5, 1_000_000_000
#: Rows of the term part of a report.
TOP = 50
#: Bytes of text counted at once; partial counts a task holds back; counts of a shard, on average; cells of a block.
BYTES, HELD, SHARD, CELLS = 1 << 22, 1 << 18, 1 << 18, 1 << 21

PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def partial_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of every (lang, source, term); the empty term stands for the documents themselves."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    row, term = pc.list_parent_indices(parts), pc.list_flatten(parts).dictionary_encode()
    codes, words = term.indices, term.dictionary
    real = pc.not_equal(words, "").take(codes)
    within = pa.table({"row": row, "term": codes}).filter(real).group_by(["row", "term"]).aggregate([([], "count_all")])
    owners = pa.table({"lang": lang, "source": source})
    counted = pa.table(
        {
            "lang": lang.take(within["row"]), "source": source.take(within["row"]), "term": within["term"],
            "n": within["count_all"],
        }
    ).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    marks = owners.group_by(["lang", "source"]).aggregate([([], "count_all")])
    return pa.concat_tables(
        [
            pa.table([counted["lang"], counted["source"], words.take(counted["term"]), counted["n_sum"], counted["count_all"]], schema=PARTIAL),
            pa.table([marks["lang"], marks["source"], pa.array([""] * len(marks), pa.string()), marks["count_all"], marks["count_all"]], schema=PARTIAL),
        ]
    )


def merged(tables: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([got["lang"], got["source"], got["term"], got["n_sum"], got["docs_sum"]], schema=PARTIAL)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(i).cast(pa.string()), "") for i in range(3))
        sizes = pc.binary_length(text).to_pylist()
        for low, high in spans_of(sizes, BYTES):
            held.append(partial_counts(lang[low:high], source[low:high], text[low:high]))
            if sum(map(len, held)) > HELD:
                held = [merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged(held).to_batches()


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept))``, by long division in 64 bits.

    Exact while the denominator stays below 2**63 / 1000, some nine million billion terms.
    """
    below = total + SMOOTHING * kept
    left, out = count + SMOOTHING, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):  # UNIT = 1000 ** 3
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


RESULT = "lang string, source string, part string, item string, value long"


def _compare(rows: pa.Table, top: int) -> pa.Table:
    """One shard: partial sums of every ordered pair of sources, and every source's ``top`` terms of the shard.

    Rows of kind 0 are the language's sources (n its total), of kind 1 counts (all its total in the language).
    """
    lang = rows["lang"][0].as_py()
    kind = rows["kind"].to_numpy()
    heads, counts = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
    names, kept, whole = heads["source"].to_pylist(), heads["kept"][0].as_py(), heads["whole"][0].as_py()
    totals = heads["n"].to_numpy()
    sources = pc.index_in(counts["source"].combine_chunks(), heads["source"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = counts["term"].combine_chunks().dictionary_encode()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    n, everywhere = counts["n"].to_numpy(), counts["everywhere"].to_numpy()
    own = shares(n, totals[sources], np.int64(kept))
    # The pairs, a block of terms after the other: a term that a source does not hold has the share of a count of 0.
    base = shares(np.zeros(len(totals), np.int64), totals, np.int64(kept))
    order = np.argsort(codes, kind="stable")
    width = max(1, CELLS // len(names))
    sums = np.zeros((len(names), len(names)), np.int64)
    for low in range(0, len(words), width):
        high = min(low + width, len(words))
        mine = order[np.searchsorted(codes[order], low) : np.searchsorted(codes[order], high)]
        block = np.repeat(base[:, None], high - low, axis=1)
        block[sources[mine], codes[mine] - low] = own[mine]
        for i in range(len(names) - 1):
            sums[i, i + 1 :] += np.abs(block[i + 1 :] - block[i]).sum(axis=1)
    sums += sums.T
    first, second = np.nonzero(~np.eye(len(names), dtype=bool))
    pairs = pa.table({"source": pa.array(names).take(pa.array(first)), "part": pa.array(["pair"] * len(first), pa.string()), "item": pa.array(names).take(pa.array(second)), "value": sums[first, second]})
    # The terms that a source holds more of than its language.
    above = own - shares(everywhere, np.int64(whole), np.int64(kept))
    more = np.flatnonzero(above > 0)
    terms = pa.table({"source": pa.array(names).take(pa.array(sources[more])), "part": pa.array(["term"] * len(more), pa.string()), "item": words.take(pa.array(codes[more])), "value": above[more]})
    terms = terms.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
    if len(terms):
        place = pc.index_in(terms["source"].combine_chunks(), pa.array(sorted(set(terms["source"].to_pylist()), key=lambda s: s.encode()))).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        rank = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
        terms = terms.filter(pa.array(rank < top))
    both = pa.concat_tables([pairs, terms])
    return both.add_column(0, "lang", pa.array([lang] * len(both), pa.string()))


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) that occurs in ``docs``.

    Part ``pair``: every other source of the language, the value the summed distance of shares over
    the language's kept terms. Part ``term``: the ``top`` terms whose share in the source is above the
    language's. Larger values come first, ties by the item's bytes.

    Null text, lang and source are ''. A row is a document: rows that repeat count again. A text
    without a term makes its group occur. Without kept terms every pair has value 0 and there is no
    term. An empty table gives no rows. Other columns take no part.
    """
    counts = stored(
        docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "term-counts",
    )
    terms = counts.filter("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere")).filter(F.col("docs") >= documents).drop("docs")
    held = stored(terms.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    groups = counts.filter("term = ''").select("lang", "source")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = held.groupBy("lang").agg(F.sum("n").alias("whole"), F.count("*").alias("rows")).join(
        held.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept")), "lang"
    )
    heads = stored(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        .withColumn("shards", F.floor(F.col("rows") / shard) + 1),
        "groups",
    )
    cells = ("lang", "shard", "kind", "source", "term", "n", "everywhere", "kept", "whole")
    dealt = held.join(heads.select("lang", "shards").distinct(), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), F.lit(1).alias("kind"), "source", "term", "n", "everywhere",
        F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("whole"),
    )
    each = heads.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(0).alias("kind"), "source",
        F.lit("").alias("term"), "n", F.lit(0).cast("long").alias("everywhere"), "kept", "whole",
    )

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, top)

    found = dealt.select(*cells).union(each.select(*cells)).groupBy("lang", "shard").applyInArrow(compare, RESULT)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")

    return ranked(pairs).union(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
          FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs)),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
whole AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
own_n AS (SELECT lang, source, sum(c) AS n FROM own GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (coalesce(s.n, 0)::HUGEINT + 5 * w.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (w.n::HUGEINT + 5 * w.v) AS q
           FROM groups g JOIN kept k ON g.lang = k.lang JOIN whole w ON g.lang = w.lang
           LEFT JOIN own_n s ON g.lang = s.lang AND g.source = s.source
           LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op11_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
