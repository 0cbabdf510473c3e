import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions import extract as ex, patterns as pt, phrasing as ph, text as tx
from docassay.operators.facts import heading_key


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_white_space_class_covers_exactly_the_listed_characters(spark):
    points = spark.range(1, 0xD800).union(spark.range(0xE000, 0x10000)).selectExpr(
        "id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS ch"
    )
    hits = {r.id for r in points.filter(F.col("ch").rlike(pt.WS)).collect()}
    assert hits == set(map(ord, pt.WS_CHARS))
    assert points.filter(F.col("ch").rlike(pt.java(r"\S"))).count() == points.count() - len(hits)


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a\r\nb\rc", "a\nb\nc"), ("a b c", "a b c"), ("‘x’ “y”", "'x' \"y\""),
        ("a‐b…", "a-b..."), ("ﬁﬂ", "fifl"), ("a\tb", "a b"), ("a   b", "a b"),
        ("a\n\n\n\nb", "a\n\nb"), ("a  \nb　", "a\nb"), ("a\n \n \n b", "a\n\n\n b"),
    ],
)
def test_normalise(spark, raw, clean):
    assert one(spark, tx.normalise_text(F.lit(raw))) == clean


@pytest.mark.parametrize(
    ("line", "key"),
    [
        ("SKILLS", "skills"), ("Academic Projects", "education"), ("Skills: Python, SQL", "skills"), ("Training", "experience"),
        ("Trainings", "certifications"), ("** Work Experience **", "experience"), ("Experience.", None),
        ("- Skills", None), ("Skills and a lot of other words", None), ("Skilled", None), ("Projects —", "projects"),
        ("Profile", "summary"), ("Declaration", "declaration"), ("s" * 61, None),
    ],
)
def test_headings(spark, line, key):
    assert one(spark, heading_key(F.lit(line))) == key


@pytest.mark.parametrize(
    ("line", "is_item"), [("- a", True), ("o a", True), ("12) a", True), ("123. a", False), ("-a", False), ("➤ a", True), ("a", False)]
)
def test_bullets(spark, line, is_item):
    assert one(spark, tx.is_bullet(F.lit(line))) is is_item


def test_ascii_word_boundaries(spark):
    assert one(spark, F.size(ex.pronouns(F.lit("éi x, I'm mine, my-self limit")))) == 4
    assert one(spark, ex.years(F.lit("in 2020, x2021, 1999-2001"))) == ["2020", "1999", "2001"]


def test_extractors(spark):
    assert one(spark, ex.phones(F.lit("+91 98765 43210, 2019-2020, 123456789"))) == ["+91 98765 43210"]
    assert one(spark, ex.emails(F.lit("a.b@x.io c@d.e a.b@x.io"))) == ["a.b@x.io"]
    assert one(spark, ex.link_kinds(F.lit("see www.gmail.com"))) == []
    assert one(spark, ex.link_kinds(F.lit("https://linkedin.com/in/a"))) == ["linkedin", "portfolio"]
    assert one(spark, ex.typos(F.lit("my experiance, experiance; recieve"))) == ["experiance", "recieve"]
    assert one(spark, ex.brand_slips(F.lit("Java  Script"))) == ["Java  Script → JavaScript"]
    assert one(spark, ex.date_ranges(F.lit("Jan 2020 - Present, 2019 to 2020"))) == ["Jan 2020 - Present", "2019 to 2020"]


def test_phrasing(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, ph.list_phrase(arr("a", "b", "c"))) == "a, b and c"
    assert one(spark, ph.list_phrase(arr("a", "b", "c", "d", "e"))) == "a, b, c and 2 more"
    assert one(spark, ph.list_phrase(arr("a"))) == "a"
    assert one(spark, ph.pluralise(F.lit(1), "row")) == "1 row" and one(spark, ph.pluralise(F.lit(2), "row")) == "2 rows"
    assert one(spark, ph.excerpt(F.lit("word " * 30))) == "word " * 17 + "word…"
    assert one(spark, ph.excerpt(F.lit("x" * 100))) == "x" * 90 + "…"
    assert one(spark, ph.percent(F.lit(61), F.lit(125))) == 49 and one(spark, ph.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, ph.thousands(F.lit(2312))) == "2,312"


_PIECES = st.sampled_from(
    ["python", "node.js", ".net", "asp.net", "c++", "c#", "r", "go", "ci/cd", "google cloud", "spring boot", "x", ".", "..", " ", "-", "/", "\n", ",", "é", "+", "#", "1"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(_PIECES, min_size=0, max_size=14).map("".join), min_size=25, max_size=25))
def test_term_lookup_equals_the_regex(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.f for r in df.select("i", tx.find_terms(F.lower("t"), lx.all_skills()).alias("f")).collect()}
    for i, t in enumerate(texts):
        want = [s for s in lx.all_skills() if re.search(pt.term_regex(s), t.lower())]
        assert got[i] == want, t


def test_rows_of_dots_stay_small(spark):
    assert one(spark, F.size(tx.heads(F.lit("." * 100_000)))) == 1


@pytest.mark.parametrize("pattern", ["[^a-z0-9+#./-]", "[!-/à-ÿ-]", r"[\d&-(x]", "[a-c[0-3]x]", r"\[a-c]", "[0-9 –-—]"])
def test_spelled_classes_match_the_same(spark, pattern):
    points = spark.range(1, 0x2100).selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS ch")
    for flags in ("", "(?i)"):
        both = points.select(F.col("ch").rlike(flags + pattern).alias("a"), F.col("ch").rlike(flags + pt.spelled(pattern)).alias("b"))
        assert both.filter("a <> b").count() == 0


def test_heads_are_cut_in_one_pass_over_the_text(spark):
    assert one(spark, tx.heads(F.lit("a.b.c ..net... node.js,c++. x"))) == ["a", "..net", "node", "c++", "x"]
    df = spark.createDataFrame([("x",)], "t string").select(tx.heads(F.col("t")).alias("h"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_without_a_head_are_searched_for(spark):
    assert one(spark, tx.find_terms(F.lit("so é.x, -/- and rest api, arrest api"), ["é.x", "-/-", "rest api", "st api"])) == ["é.x", "-/-", "rest api"]


def test_texts_normalised_already_are_only_trimmed(spark):
    """The short way and the long way agree on blanks, line ends and replaced characters in every place."""
    from itertools import product

    from docassay.functions.patterns import WS, WS_BUT_LF

    parts = ["a", "b c", " ", "\n", "\t", "\r\n", "\x0b", " ", "“", "…", "•", "é", "　", "﻿", "‐"]
    texts = ["".join(p) for p in product(parts, repeat=3)] + ["a\n\n\n\nb", "a \n\nb", " \n \n", ""]
    long = F.col("t")
    for found, instead in [("\r\n", "\n"), ("\r", "\n")] + [(chr(p), i) for ps, i in tx._REPLACEMENTS for p in ps]:
        long = F.replace(long, F.lit(found), F.lit(instead))
    long = F.regexp_replace(F.regexp_replace(long, " {2,}", " "), "\n{3,}", "\n\n")
    long = tx.js_trim(F.regexp_replace(long, WS_BUT_LF + r"+(?=\n|\z)", ""))
    split = F.filter(F.split("t", WS + "+"), lambda w: w != "")
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", tx.normalise_text(F.col("t")).alias("a"), long.alias("b"), tx.words(F.col("t")).alias("c"), split.alias("d")).collect()
    assert [(r.t, r.a, r.c) for r in got] == [(r.t, r.b, r.d) for r in got]


def test_phrases_are_searched_as_bytes_from_their_rarest_character(spark):
    phrases = ["hardworking", "sincere and hardworking", "d.o.b", "i am a", "i am an", "ab", "z", "naïve é", "x ", "quiz"]
    assert all(p.endswith(tx.rare_part(p)) and len(tx.rare_part(p)) >= min(3, len(p)) for p in phrases)
    assert [tx.rare_part(p) for p in ("hardworking", "excellent", "quiz")] == ["king", "xcellent", "quiz"]
    texts = ["", "i am an x z", "sincere and hardworking", "hard working", "d.o.b naïve é quiz", "naive e", "ab" * 50, "xquix quiz "] + phrases
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = df.select("t", tx.find_phrases(F.col("t"), phrases).alias("f"))
    assert {r.t: r.f for r in found.collect()} == {t: [p for p in phrases if p in t] for t in texts} | {None: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "as binary" in plan and "Contains" not in plan
