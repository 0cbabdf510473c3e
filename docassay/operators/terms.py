"""Mine ranked key terms from postings.

:func:`mine_terms` works within the row: tokens are sorted, so equal terms lie side by side and
a count is the distance between group starts. Nothing is shuffled and no posting is split over
rows. The relational pieces below it are for token tables that already exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions import text as tx
from docassay.functions.rows import explode_rows


def _in(var: str, values: Sequence[str]) -> str:
    if not values:
        return "false"
    return f"{var} IN (" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def useful(var: str, stop: Sequence[str], skills: Sequence[str]) -> str:
    """SQL test for a token worth counting on its own."""
    return (
        f"length({var}) >= 3 AND NOT ({_in(var, stop)}) AND NOT ({var} rlike '^[0-9]+$') "
        f"AND (NOT ({var} rlike '^[0-9]') OR {_in(var, skills)})"
    )


def collation_key(term: Column) -> Column:
    """Binary order of the key is dictionary order: blank - . / # + digits letters."""
    return F.translate(term, " -./#+", "!\"#$%&")


def term_columns(postings: DataFrame, stop: Sequence[str], skills: Sequence[str]) -> DataFrame:
    """Add ``lower, tokens, unigrams, bigrams`` (arrays in text order)."""
    df = postings.withColumns(
        {"lower": F.lower("text"), "tokens": tx.tokenise(F.col("text"))}
    )
    df = df.withColumn("solid", F.expr(f"transform(tokens, t -> length(t) >= 3 AND NOT ({_in('t', stop)}))"))
    return df.withColumns(
        {
            "unigrams": F.expr(f"filter(tokens, t -> {useful('t', stop, skills)})"),
            "bigrams": F.expr(
                "filter(transform(tokens, (t, i) -> if(get(solid, i) AND get(solid, i + 1), "
                "concat(t, ' ', get(tokens, i + 1)), null)), b -> b IS NOT NULL)"
            ),
        }
    )


def mine_terms(
    postings: DataFrame,
    stop: Sequence[str] | None = None,
    skills: Sequence[str] | None = None,
    allow: Sequence[str] | None = None,
    k: int = lx.MAX_TERMS,
) -> DataFrame:
    """``(posting_id, terms)``: up to ``k`` of ``(rank, term, cnt, is_skill)`` per posting."""
    stop = lx.stopwords() if stop is None else stop
    skills = lx.all_skills() if skills is None else skills
    allow = lx.BIGRAM_ALLOWLIST if allow is None else allow
    spaced = [s for s in skills if " " in s]
    df = term_columns(postings, stop, skills)
    df = df.withColumn("pairs", F.array_sort("bigrams"))
    df = df.withColumn("pair_starts", _starts("pairs", "t", "get(pairs, i - 1) <> t"))
    df = df.withColumn("pair_counts", _lengths("pair_starts", "pairs"))
    df = df.withColumn("phrases", F.expr(f"filter(pair_counts, p -> p.n >= 2 OR {_in('p.term', allow)})"))
    # Markers (kind 0) sort before the tokens they suppress.
    df = df.withColumn(
        "marked",
        F.expr(
            "array_sort(concat("
            f"transform(filter(flatten(transform(phrases, p -> split(p.term, ' '))), t -> NOT ({_in('t', skills)})), t -> struct(t AS term, 0 AS kind)), "
            "transform(unigrams, t -> struct(t AS term, 1 AS kind))))"
        ),
    )
    df = df.withColumn("word_starts", _starts("marked", "t.term", "get(marked, i - 1).term <> t.term", "t.kind"))
    df = df.withColumn("word_counts", _lengths("word_starts", "marked"))
    df = df.withColumn(
        "extra",
        F.filter(tx.literals(spaced), lambda s: F.contains("lower", s)) if spaced else F.array().cast("array<string>"),
    )
    df = df.withColumn(
        "candidates",
        F.expr(
            "concat(transform(filter(word_counts, w -> w.kind = 1), w -> struct(w.term AS term, w.n AS n)), "
            "transform(phrases, p -> struct(p.term AS term, p.n AS n)), "
            "transform(array_except(extra, transform(phrases, p -> p.term)), s -> struct(s AS term, 1 AS n)))"
        ),
    )
    ranked = F.expr(
        f"array_sort(transform(candidates, x -> struct(NOT ({_in('x.term', skills)}) AS plain, -x.n AS less, "
        "translate(x.term, ' -./#+', '!\"#$%&') AS key, x.term AS term)))"
    )
    top = F.transform(
        F.slice(ranked, 1, k),
        lambda x, i: F.struct(
            (i + 1).alias("rank"), x["term"].alias("term"), (-x["less"]).alias("cnt"), (~x["plain"]).alias("is_skill")
        ),
    )
    return df.select("posting_id", top.alias("terms"))


def _starts(array: str, term: str, changed: str, kind: str = "1") -> Column:
    return F.expr(
        f"filter(transform({array}, (t, i) -> if(i = 0 OR {changed}, struct({term} AS term, {kind} AS kind, i AS at), null)), s -> s IS NOT NULL)"
    )


def _lengths(starts: str, array: str) -> Column:
    return F.expr(
        f"transform({starts}, (s, j) -> struct(s.term AS term, s.kind AS kind, "
        f"coalesce(get({starts}, j + 1).at, size({array})) - s.at AS n))"
    )


def posting_terms(mined: DataFrame) -> DataFrame:
    """Long form: one row per posting and ranked term."""
    return explode_rows(mined, ["posting_id"], "terms")


# --- relational pieces ----------------------------------------------------

def token_table(postings: DataFrame) -> DataFrame:
    """One row per token: ``(posting_id, pos, token)``."""
    tokens = F.transform(
        tx.tokenise(F.col("text")), lambda t, i: F.struct(i.alias("pos"), t.alias("token"))
    )
    return explode_rows(postings, ["posting_id"], tokens)


def stopword_filter(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Left anti join against a stop-word table ``(token)``; Spark broadcasts it while small."""
    return tokens.join(stop, "token", "left_anti")


def term_counts(tokens: DataFrame) -> DataFrame:
    """Frequency per posting and token, combined map-side; a hot posting spreads over its tokens."""
    return tokens.groupBy("posting_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("cnt"))


def bigrams(postings: DataFrame, stop: Sequence[str], skills: Sequence[str] = ()) -> DataFrame:
    """One row per pair of neighbouring solid tokens: ``(posting_id, pos, term)``."""
    rows = F.transform("bigrams", lambda b, i: F.struct(i.alias("pos"), b.alias("term")))
    return explode_rows(term_columns(postings, stop, skills), ["posting_id"], rows)


def bigram_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("posting_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def keep_bigrams(counts: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Pairs on the allow-list or seen at least twice."""
    return counts.filter(F.expr(f"cnt >= 2 OR {_in('term', allow)}"))


def drop_phrase_parts(words: DataFrame, phrases: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Words without the parts of kept phrases; named skills always stay."""
    parts = phrases.select("posting_id", F.explode(F.split("term", " ")).alias("term"))
    parts = parts.filter(F.expr(f"NOT ({_in('term', skills)})")).distinct()
    return words.join(parts, ["posting_id", "term"], "left_anti")


def top_terms(counts: DataFrame, skills: Sequence[str], k: int = lx.MAX_TERMS) -> DataFrame:
    """Skills first, then frequency, then dictionary order; ranks are cut before the shuffle."""
    df = counts.withColumn("is_skill", F.expr(_in("term", skills)))
    order = Window.partitionBy("posting_id").orderBy(
        F.desc("is_skill"), F.desc("cnt"), collation_key(F.col("term"))
    )
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
