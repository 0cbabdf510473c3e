import pytest
from pyspark.sql import functions as F

from docassay.operators import scoring
from docassay.operators.facts import text_documents
from docassay.operators.rulepack import Branch, Rule, RulePack
from docassay.operators.rules import default_pack
from docassay.plans.score import reports, score_documents
from docassay.sources import sinks
from tests.samples import DEGENERATE, STRONG, WEAK, WEAK_ACTIONS, WEAK_CHECKS


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, WEAK), (2, STRONG)] + [(10 + i, t) for i, t in enumerate(DEGENERATE)]
    df = reports(text_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    return {r.doc_id: r for r in df.collect()}


def test_pack_has_36_rules_in_six_categories(spark):
    pack = default_pack()
    assert len(pack.rules) == 36
    assert pack.categories() == ["parse", "contact", "structure", "impact", "skills", "hygiene"]
    counts = {k: sum(r.category == k for r in pack.rules) for k in pack.categories()}
    assert counts == {"parse": 8, "contact": 6, "structure": 5, "impact": 7, "skills": 4, "hygiene": 6}


def test_weak_document(golden):
    r = golden[1]
    assert {k.id: (k.state, k.score, k.weight) for k in r.checks} == WEAK_CHECKS
    assert (r.total_score, r.total_weight, r.score, r.band_id) == (61, 125, 49, "rework")
    assert [a.id for a in r.actions] == WEAK_ACTIONS
    assert r.bullet_count == 4 and r.section_count == 7  # "Languages known: ..." and "Interests: ..." open one too


def test_strong_document(golden):
    r = golden[2]
    assert [k.id for k in r.checks if k.state in ("warn", "fail")] == []
    assert (r.score, r.band_id) == (100, "ready")
    assert r.actions == []


def test_every_open_check_has_a_fix_and_info_weighs_nothing(golden):
    for r in golden.values():
        for k in r.checks:
            assert k.state not in ("warn", "fail") or k.fix
            assert k.state != "info" or (k.weight, k.score) == (0, 0)
    assert sum(k.state == "info" for k in golden[2].checks) >= 3


def test_degenerate_documents_get_a_score(golden):
    for doc_id, r in golden.items():
        assert 0 <= r.score <= 100, doc_id
    assert all(golden[10 + i].score is not None for i in range(len(DEGENERATE)))


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        ("hygiene.length", [(199, 0), (200, 3), (299, 3), (300, 5), (700, 5), (701, 3), (900, 3), (901, 0)]),
        ("parse.text", [(399, 0), (400, 5), (1199, 5), (1200, 10)]),
    ],
)
def test_cut_offs(spark, rule, cases):
    rows = [(n, "a " * n if rule == "hygiene.length" else "a" * n) for n, _ in cases]
    docs = text_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    checks = scoring.check_results(score_documents(docs)).filter(F.col("id") == rule)
    assert dict(checks.select("doc_id", "score").collect()) == dict(cases)


def test_line_and_bullet_cut_offs(spark):
    rows = [
        (7, "\n".join(["word"] * 7)), (8, "\n".join(["word"] * 8)),
        (34, "\n".join(["- " + "word " * 34] * 3)), (35, "\n".join(["- " + "word " * 35] * 3)),
    ]
    docs = text_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.id): r.score for r in scoring.check_results(score_documents(docs)).collect()}
    assert (7, "parse.shape") in got and (8, "parse.shape") not in got
    assert got[34, "impact.bullet-length"] == 3 and got[35, "impact.bullet-length"] == 1


def test_own_rule_in_a_pack(spark):
    pack = RulePack().add(
        Rule("style.shout", "No shouting", 4, (
            Branch("fail", 0, "loud", "calm down", when=F.contains("text", F.lit("!"))),
            Branch("pass", 4, "calm"),
        ))
    )
    with pytest.raises(ValueError):
        pack.add(pack.rules[0])
    docs = text_documents(spark.createDataFrame([(1, "hey!"), (2, "hey")], "doc_id long, text string"))
    assert dict(score_documents(docs, pack).select("doc_id", "score").collect()) == {1: 0, 2: 100}


def test_long_and_row_totals_agree(spark, golden):
    docs = text_documents(spark.createDataFrame([(1, WEAK), (2, STRONG)], "doc_id long, text string"))
    scored = score_documents(docs)
    cols = ["doc_id", "id", "score", "weight", "pct"]
    within = {tuple(r) for r in scoring.category_rows(scored).select(cols).collect()}
    joined = {tuple(r) for r in scoring.category_scores(scoring.check_results(scored)).select(cols).collect()}
    assert within == joined and len(within) == 12


def test_scoring_does_not_shuffle(spark):
    docs = text_documents(spark.range(3).selectExpr("id AS doc_id", "'some text' AS text"))
    plan = score_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filter_on_score_does_not_repeat_the_rules(spark):
    docs = text_documents(spark.range(3).selectExpr("id AS doc_id", "'some text' AS text"))
    plan = score_documents(docs).filter("score > 50")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2
    tail = plan.split("Filter")[-1].split("\n", 1)[0]
    assert "regexp" not in tail.lower() and "rlike" not in tail.lower()


def test_report_tables_and_markdown(spark, tmp_path, golden):
    docs = text_documents(spark.createDataFrame([(1, WEAK), (2, STRONG)], "doc_id long, text string"))
    full = reports(docs)
    sinks.write_report_tables(full, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/reports")
    assert dict(stored.select("doc_id", "band_id").collect()) == {1: "rework", 2: "ready"}
    assert spark.read.parquet(f"{tmp_path}/actions").count() == 5
    text = dict(sinks.report_markdown(full).collect())
    assert "**Score:** 49/100" in text[1] and text[1].count("- [ ]") == 9 and "Nothing is left" in text[2]


def test_moved_cuts_and_weights(spark):
    from docassay.operators.rules import CUTS, default_pack, packs_from
    from docassay.plans.score import score_packs

    docs = text_documents(spark.createDataFrame([(1, WEAK), (2, STRONG)], "doc_id long, text string"))
    rows = [("plain", None, None, None), ("long", "cut", "hygiene.length.good", 5.0), ("long", "cut", "hygiene.length.least", 1.0), ("heavy", "weight", "hygiene.length", 50.0)]
    packs = packs_from(spark.createDataFrame(rows, "pack string, kind string, name string, value double"))
    got = {(r.doc_id, r.pack): r for r in score_packs(docs, packs).collect()}
    plain = {r.doc_id: r.score for r in score_documents(docs).collect()}
    assert {i: got[i, "plain"].score for i in (1, 2)} == plain and len(got) == 6
    assert got[1, "long"].total_score == got[1, "plain"].total_score + 5 and got[1, "heavy"].total_weight == got[1, "plain"].total_weight + 45
    assert got[1, "heavy"].total_score == got[1, "plain"].total_score
    for bad in ({"cuts": {"no.such": 1}}, {"weights": {"no.such": 1}}):
        with pytest.raises(ValueError):
            default_pack(**bad)
    assert set(CUTS) >= {"parse.text.pass", "hygiene.length.long"}
