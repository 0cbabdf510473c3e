"""Queries on postings: mining and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.catalog import PARTS, c, joined, prose, register, structured
from docassay.functions import text as tx
from docassay.functions.rows import explode_rows, explode_values
from docassay.operators import matching as mt, terms as tm
from docassay.operators.facts import build_facts
from docassay.operators.rulepack import RulePack
from docassay.plans.score import decide
from docassay.sources.corpus import min_length_gate, read_corpus

STOP = ["that", "with", "this", "from", "and", "the", "want", "plus", "required", "strong"]
SKILLS = lx.all_skills() + ["tion", "rewh", "orre", "thatin", "ononst", "inoran"]
TAILS = [
    "Required: Python, React and Docker. Machine learning and machine learning. Google Cloud, node.js. and CI/CD; data science 50+",
    "We want strong SQL, PostgreSQL and Git; C++ or C# plus .NET and asp.net, rest api, unit testing.",
    "",
    "react native spring boot a b, a-b, a.b, a/b, a#b, a+b; aaa/bbb aaa-bbb aaa.bbb aaa#bbb aaa+bbb aaabbb --- /// users/day",
]


def postings(spark, sf):
    """The benchmark table as postings, each with a closing line."""
    raw = read_corpus(spark, f"{sf}/benchmark.parquet", "item_id", "text", partitions=PARTS)
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (c("doc_id") % 4 + 1).cast("int"))
    return min_length_gate(
        raw.select(c("doc_id").alias("posting_id"), F.concat("text", F.lit("\n"), tail).alias("text"))
    )


def all_prose(spark, sf):
    """Every document, whatever its length, taken as a posting."""
    return prose(spark, sf).select(c("doc_id").alias("posting_id"), "text")


def prose_postings(spark, sf):
    """Every document long enough, taken as a posting."""
    return min_length_gate(all_prose(spark, sf))


def mined(spark, sf):
    return tm.posting_terms(tm.mine_terms(postings(spark, sf), STOP, SKILLS))


#: The request of the matching queries: each document with so many postings. It is their input, not a cut of a result.
ASKED_POSTINGS = 5


def pairs(spark, sf):
    """The request needs ids alone: it is made of the documents as stored, so no text is derived for it."""
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    return mt.pair_up(prose(spark, sf).select("doc_id"), n, per_doc=ASKED_POSTINGS)


def matches(spark, sf):
    docs = structured(spark, sf).select("doc_id", "text")
    return mt.match_postings(docs, mined(spark, sf), pairs(spark, sf))


@register
def e01_dict_match(spark, sf):
    docs = structured(spark, sf)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']{4,}"), F.lit(0)))
    rows = explode_values(docs.select("doc_id", tokens.alias("t")), ["doc_id"], "t", "token")
    usual = spark.createDataFrame(list(lx.TYPOS.items()), "token string, usual string")
    return mt.dict_match(rows, usual).select("doc_id", "token", "usual")


@register
def e02_dict_scan(spark, sf):
    docs = structured(spark, sf).select("doc_id", "text")
    vocab = mt.vocabulary(spark.createDataFrame([(t,) for t in lx.all_skills()], "term string"))
    return mt.doc_terms(docs, vocab)


@register
def e02_phrase_scan(spark, sf):
    """Substrings: the skills, and three words of every posting from each of its first six places."""
    from docassay.operators.substrings import phrase_scan

    words = F.split(F.lower("text"), " ")
    runs = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.array_join(F.slice(words, i, 3), " "))
    items = read_corpus(spark, f"{sf}/benchmark.parquet", "item_id", "text", partitions=PARTS)
    phrases = items.select(F.explode(runs).alias("phrase")).union(spark.createDataFrame([(t,) for t in lx.all_skills()], "phrase string"))
    return phrase_scan(prose(spark, sf), phrases.filter("phrase <> ''"))


@register
def e03_stopword_filter(spark, sf):
    stop = spark.createDataFrame([(t,) for t in STOP], "token string")
    return tm.stopword_filter(tm.token_table(postings(spark, sf)), stop).select("posting_id", "pos", "token")


def _words_and_phrases(spark, sf):
    posts = postings(spark, sf)
    use = tm.useful("token", STOP, SKILLS)
    words = tm.term_counts(tm.token_table(posts).filter(F.expr(use)))
    phrases = tm.keep_bigrams(tm.bigram_counts(tm.bigrams(posts, STOP)), lx.BIGRAM_ALLOWLIST)
    return words, phrases


@register
def e04_drop_phrase_parts(spark, sf):
    words, phrases = _words_and_phrases(spark, sf)
    return tm.drop_phrase_parts(words, phrases, SKILLS).select("posting_id", "term", "cnt")


@register
def e05_match_postings(spark, sf):
    return matches(spark, sf).filter("term is not null").select("doc_id", "posting_id", "rank", "term", "cnt", "is_skill", "matched")


@register
def e05_match_naive(spark, sf):
    docs = structured(spark, sf).select("doc_id", "text")
    return mt.match_postings_naive(docs, mined(spark, sf), pairs(spark, sf)).filter("term is not null").select(
        "doc_id", "posting_id", "rank", "term", "cnt", "is_skill", "matched"
    )


@register
def e06_skills_demonstrated(spark, sf):
    from docassay.operators.rules import default_pack

    pack = RulePack([r for r in default_pack().rules if r.id == "skills.evidence"])
    return mt.demonstrated(decide(structured(spark, sf), pack))


@register
def f07_term_counts(spark, sf):
    return tm.term_counts(tm.token_table(all_prose(spark, sf)))


@register
def f08_bigram_counts(spark, sf):
    return tm.bigram_counts(tm.bigrams(all_prose(spark, sf), STOP))


@register
def f09_coverage(spark, sf):
    return mt.match_report(matches(spark, sf)).select("doc_id", "posting_id", "coverage", "skill_coverage")


@register
def f10_match_status(spark, sf):
    r = mt.match_report(matches(spark, sf))
    counted = F.concat(c("n_matched").cast("string"), F.lit(" of "), c("n_terms").cast("string"))
    return r.select("doc_id", "posting_id", F.when(c("compared"), counted).otherwise("not compared").alias("status"))


@register
def a10_missing_terms_text(spark, sf):
    return mt.match_report(matches(spark, sf)).select("doc_id", "posting_id", "missing")


@register
def g02_top_terms(spark, sf):
    words, phrases = _words_and_phrases(spark, sf)
    return tm.top_terms(words.unionByName(phrases), SKILLS).select("posting_id", "rank", "term", "cnt", "is_skill")


@register
def g03_bigrams(spark, sf):
    return tm.bigrams(postings(spark, sf), STOP).select("posting_id", "pos", "term")


@register
def i01_useful_tokens(spark, sf):
    use = tm.useful("token", STOP, SKILLS)
    return tm.token_table(postings(spark, sf)).filter(F.expr(use)).select("posting_id", "pos", "token")


@register
def i02_keep_bigrams(spark, sf):
    return _words_and_phrases(spark, sf)[1]


@register
def i03_multiword_skills(spark, sf):
    spaced = [s for s in SKILLS if " " in s]
    found = tx.find_phrases(F.lower("text"), spaced)
    return explode_values(postings(spark, sf).select("posting_id", found.alias("f")), ["posting_id"], "f", "term")


@register
def i04_posting_terms(spark, sf):
    return mined(spark, sf)


@register
def i04_posting_terms_prose(spark, sf):
    return tm.posting_terms(tm.mine_terms(prose_postings(spark, sf), STOP, SKILLS))


@register
def i05_term_matches(spark, sf):
    return matches(spark, sf).filter("matched").select("doc_id", "posting_id", "term")


@register
def i06_match_report(spark, sf):
    return mt.match_report(matches(spark, sf))
