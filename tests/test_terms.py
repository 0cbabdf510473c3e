import random

from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.operators import matching as mt, terms as tm
from docassay.operators.substrings import phrase_scan
from tests.samples import POSTING, STRONG, WEAK


def test_default_stop_words(spark):
    stop = set(lx.stopwords())
    assert {"the", "own", "whom", "cannot"} <= stop
    assert not {"python", "requirements", "working"} & stop


def _posts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "posting_id long, text string")


def _mine(spark, text):
    return [(r.term, r.cnt, r.is_skill) for r in tm.posting_terms(tm.mine_terms(_posts(spark, text))).orderBy("rank").collect()]


def test_phrases_skills_and_order(spark):
    got = _mine(spark, "Machine learning. Google Cloud; C# and S3, .NET, node.js. 50+ foo bar foo bar baz")
    assert got[:3] == [("google cloud", 1, True), ("node.js", 1, True), ("foo bar", 2, False)]
    terms = {t for t, _, _ in got}
    assert "machine learning" in terms and "machine" not in terms
    assert {"foo bar", "google", "cloud"} <= terms and "foo" not in terms
    assert not {"c#", "s3", ".net", "50+"} & terms


def test_ties_follow_dictionary_order(spark):
    # Stop words between the tokens keep pairs from forming.
    got = _mine(spark, "aaa/b the aaa-b the aaa.b the aaa#b the aaa+b the aaab the aaa1")
    assert [t for t, _, _ in got] == ["aaa-b", "aaa.b", "aaa/b", "aaa#b", "aaa+b", "aaa1", "aaab"]


def test_no_more_than_28_terms(spark):
    got = _mine(spark, " the ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)))
    assert len(got) == lx.MAX_TERMS


def test_relational_and_row_forms_agree(spark, sf):
    posts = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS posting_id", "text")
    stop, skills = ["that", "with"], ["tion"]
    words = tm.term_counts(tm.token_table(posts).filter(F.expr(tm.useful("token", stop, skills))))
    phrases = tm.keep_bigrams(tm.bigram_counts(tm.bigrams(posts, stop)), [])
    both = tm.drop_phrase_parts(words, phrases, skills).unionByName(phrases)
    cols = ["posting_id", "rank", "term", "cnt", "is_skill"]
    want = {tuple(r) for r in tm.top_terms(both, skills).select(cols).collect()}
    got = {tuple(r) for r in tm.posting_terms(tm.mine_terms(posts, stop, skills, [])).select(cols).collect()}
    assert got == want


def test_strong_document_matches_better(spark):
    docs = spark.createDataFrame([(1, WEAK), (2, STRONG)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, posting_id long")
    terms = tm.posting_terms(tm.mine_terms(_posts(spark, POSTING)))
    report = {r.doc_id: r for r in mt.match_report(mt.match_postings(docs, terms, pairs)).collect()}
    assert report[1].n_terms >= 10
    assert report[2].coverage > report[1].coverage
    assert "python" in report[2].matched.split(", ") and "python" in report[1].missing.split(", ")


def test_key_join_equals_regex_join(spark):
    texts = ["use node.js. and .net", "asp.net ci/cd", "/foo bar", "foo.bar baz-qux", "--- ///", "a.b.c", "machine learning-x", "machine  learning", "x" * 60, "so... on", "a -... b"]
    asked = ["node.js", ".net", "ci/cd", "/foo", "foo", "foo.bar", "baz-qux", "///", "a", "a.b", "b", "machine learning", "bar foo", "x" * 60, "..", "...", "-.."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(0, i, t, 1, False) for i, t in enumerate(asked)], "posting_id long, rank int, term string, cnt int, is_skill boolean")
    pairs = docs.select("doc_id", F.lit(0).cast("long").alias("posting_id"))
    cols = ["doc_id", "term", "matched"]
    got = {tuple(r) for r in mt.match_postings(docs, terms, pairs).select(cols).collect()}
    want = {tuple(r) for r in mt.match_postings_naive(docs, terms, pairs).select(cols).collect()}
    assert got == want and any(m for _, _, m in got)


def test_pairs_without_terms_stay(spark):
    docs = spark.createDataFrame([(1, "python")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, 1, "python", 1, True)], "posting_id long, rank int, term string, cnt int, is_skill boolean")
    pairs = spark.createDataFrame([(1, 0), (1, 9)], "doc_id long, posting_id long")
    got = {r.posting_id: (r.compared, r.n_terms, r.coverage, r.matched, r.missing) for r in mt.match_report(mt.match_postings(docs, terms, pairs)).collect()}
    assert got == {0: (True, 1, 100, "python", ""), 9: (False, 0, 0, "", "")}


def test_terms_of_any_form_equal_the_regex_join(spark):
    rng = random.Random(4)
    bits = ["a", "b", "net", "c++", "x#", "1", ".", "..", "-", "/", " ", "  ", "é", "\n", ",", "İ", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "." * 5000, "a" * 5000, "a.b-" * 2000]
    asked = {"".join(rng.choice(bits[:12]) for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"a b a", ".net", "net.", "a/b/net", "é", "- é"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(0, i, t, 1, False) for i, t in enumerate(sorted(asked))], "posting_id long, rank int, term string, cnt int, is_skill boolean")
    pairs = docs.select("doc_id", F.lit(0).cast("long").alias("posting_id"))
    cols = ["doc_id", "term", "matched"]
    got = {tuple(r) for r in mt.match_postings(docs, terms, pairs).select(cols).collect()}
    want = {tuple(r) for r in mt.match_postings_naive(docs, terms, pairs).select(cols).collect()}
    assert got == want and sum(m for _, _, m in got) > 500


def test_matching_moves_no_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    vocab = mt.vocabulary(spark.createDataFrame([("machine learning",), (".net",), ("a b c",), ("//",)], "term string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        keys = mt.doc_keys(docs, vocab).withColumn("placed", F.col("place") >= 0).join(vocab.keys, ["key", "placed"])
        plan = keys._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert moved and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "text" not in "".join(line for line in plan.split("\n") if "Exchange" in line or "Project" in line and "cut" not in line)


def test_phrase_scan_equals_contains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, (r.text or "").lower()) for r in docs.collect()]
    rng, phrases = random.Random(6), {"", "é", "the", "zzzzzz", "ABC", "é de", "\n"}
    for _ in range(11_000):
        t = rng.choice(texts)[1]
        at, n = rng.randrange(max(1, len(t))), rng.randint(1, 24)
        phrases.add("".join(rng.sample(t[at : at + n], len(t[at : at + n]))) if rng.random() < 0.3 else t[at : at + n])
    table = spark.createDataFrame([(p,) for p in phrases] + [(None,)], "phrase string")
    got = phrase_scan(docs, table, together=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in got.collect()} == {(i, p) for i, t in texts for p in phrases if p in t}
    assert phrase_scan(docs, table.limit(0)).count() == 0 == phrase_scan(docs.limit(0), table).count()


def test_the_runs_of_texts_do_not_move_to_a_short_list(spark):
    from docassay.operators import matching as mt, substrings as ss

    docs = spark.createDataFrame([(i, f"Text number {i} with some words") for i in range(20)], "doc_id long, text string")
    plans, write = [], mt.stored
    try:
        ss.stored = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name)
        found = ss.phrase_scan(docs, spark.createDataFrame([("number 1",), ("words",), ("nowhere",)], "phrase string"))
    finally:
        ss.stored = write
    assert found.count() == 31
    counted, candidates = plans[-2:]
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in counted.split("\n"))
    assert "BroadcastHashJoin" in candidates and "SortMergeJoin" not in candidates


def test_naive_match_searches_before_it_compiles(spark):
    from docassay.operators import matching as mt

    docs = spark.createDataFrame([(1, "Uses C++ and node.js."), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "c++"), (0, "node.js"), (0, "js"), (0, "java")], "posting_id long, term string")
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, posting_id long")
    got = mt.match_postings_naive(docs, terms, pairs)
    assert {r["term"] for r in got.filter("matched").collect()} == {"c++", "node.js"} and got.count() == 8
    assert "contains(lower" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_only_keys_of_the_vocabulary_leave_a_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    terms = ["the", "machine learning", ".net", "a b c", "//", "...", "nowhere at all"]
    vocab = mt.vocabulary(spark.createDataFrame([(t,) for t in terms], "term string"))
    wanted = {(r["key"], r["placed"]) for r in vocab.keys.collect()}
    met = mt.doc_keys(docs, vocab).select("key", (F.col("place") >= 0).alias("placed"))
    n, known = met.count(), sum((r["key"], r["placed"]) in wanted for r in met.collect())
    assert 0 < known >= 0.9 * n  # a few may share a bit


def test_bits_are_right_when_forgotten(spark, monkeypatch):
    monkeypatch.setattr(mt, "REMEMBERED", 3)
    keys = [f"key {i} é" for i in range(500)]
    known = mt.Known(mt.bit_table(spark.createDataFrame([(k,) for k in keys], "key string")))
    assert all(known[k] for k in keys * 2) and len(known) <= 3
    assert sum(known[f"other {i}"] for i in range(2000)) < 10
    none = mt.Known(mt.bit_table(spark.createDataFrame([], "key string")))
    assert not any(none[k] for k in keys)


def test_the_request_reads_no_text(spark, sf):
    from docassay import catalog_terms as ct

    asked = ct.pairs(spark, sf)
    assert "text" not in asked._jdf.queryExecution().executedPlan().toString()
    assert asked.count() == 5 * spark.read.parquet(f"{sf}/documents.parquet").count()
