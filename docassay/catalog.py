"""Registered queries: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.corpora import structured_documents
from docassay.functions import extract as ex, phrasing as ph, text as tx
from docassay.functions.rows import explode_rows, keep_where
from docassay.operators import facts as fc, scoring as sc
from docassay.operators.rulepack import RulePack
from docassay.operators.rules import default_pack
from docassay.plans.score import decide, score_documents
from docassay.sources.corpus import low_text, min_length_gate, read_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col


#: The tables at hand are single small files; a caller with a large corpus leaves it as it is stored.
PARTS = 32


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array, sep: str = " | "):
    return F.array_join(array, sep)


def prose(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet", keep=keep, partitions=PARTS)


def structured(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return structured_documents(prose(spark, sf, keep), keep)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_documents(fc.text_documents(prose(spark, sf)))
    return scored.select("doc_id", "score", "band_id", "total_score", "total_weight")


# --- A: sources -----------------------------------------------------------

@register
def a01_read_corpus(spark, sf):
    docs = fc.text_documents(prose(spark, sf))
    return docs.select(
        "doc_id", F.md5("text").alias("text_md5"), "source_kind", "file_name", "page_count",
        c("meta.text_density").alias("text_density"), F.size("hyperlinks").alias("n_links"),
    )


@register
def a02_classify_files(spark, sf):
    """Pages as files of many kinds, some empty and some over a limit of 4,000."""
    from docassay.sources.intake import classify

    ends = ["txt", "md", "rtf", "doc", "pages", "pdf", "docx", "bin", "PDF", "html"]
    pages = read_corpus(spark, f"{sf}/pages.parquet", "page_id", "html", partitions=PARTS)
    d = c("doc_id")
    path = F.concat(F.lit("box/"), d.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ends)), (d % 10 + 1).cast("int")))
    head = F.concat(F.when(d % 7 == 1, "%PDF").when(d % 7 == 2, "PK").otherwise(""), F.left("text", F.lit(8)))
    files = pages.select("doc_id", path.alias("path"), F.when(d % 13 == 0, 0).otherwise(F.length("text")).alias("n"), F.encode(head, "UTF-8").alias("head"))
    kind, reason = classify(c("path"), c("n"), c("head"), 4000)
    return files.select("doc_id", kind.alias("kind"), reason.alias("reason"))


@register
def a03_split_rejects(spark, sf):
    from docassay.sources.intake import split_rejects

    docs = prose(spark, sf).withColumn(
        "reason", F.when(F.length(tx.js_trim(c("text"))) < 120, F.lit("too short"))
    )
    ok, rejects = split_rejects(docs)
    return ok.select("doc_id", F.lit("ok").alias("outcome")).unionByName(
        rejects.select("doc_id", c("reason").alias("outcome"))
    )


@register
def a04_strip_rtf(spark, sf):
    """The documents as RTF bodies with escapes, breaks, a tab and a hidden group, read back as text."""
    from docassay.sources.intake import strip_rtf

    coded = F.replace(F.replace("text", F.lit("e"), F.lit("\\'e9")), F.lit("\n"), F.lit("\\par\n"))
    body = F.concat(F.lit("{\\rtf1\\ansi{\\*\\generator own;}\\pard "), coded, F.lit("\\tab end\\line }"))
    plain = prose(spark, sf).select("doc_id", strip_rtf(body).alias("plain"))
    return plain.select("doc_id", F.md5("plain").alias("text_md5"), F.length("plain").alias("n"))


@register
def a05_min_length_gate(spark, sf):
    return min_length_gate(prose(spark, sf)).select("doc_id", F.length("text").alias("n"))


@register
def a06_low_text_flag(spark, sf):
    docs = fc.text_documents(prose(spark, sf))
    return docs.select(
        "doc_id",
        F.when(low_text(c("meta.text_density")), F.lit("almost no text")).otherwise(F.lit("ok")).alias("status"),
    )


# --- B: text --------------------------------------------------------------

@register
def b01_normalise_text(spark, sf):
    t = tx.normalise_text(c("text"))
    return prose(spark, sf).select("doc_id", t.alias("text"))


@register
def b01_normalise_pages(spark, sf):
    pages = read_corpus(spark, f"{sf}/pages.parquet", "page_id", "html", partitions=PARTS)
    return pages.select("doc_id", F.md5(tx.normalise_text(c("text"))).alias("text_md5"))


@register
def b02_split_lines(spark, sf):
    return fc.lines_table(structured(spark, sf)).select("doc_id", "pos", "text", "bullet", "page")


@register
def b03_is_bullet(spark, sf):
    lines = fc.lines_table(structured(spark, sf))
    return lines.groupBy("doc_id").agg(F.count_if("bullet").alias("n_bullets"), F.count(F.lit(1)).alias("n_lines"))


@register
def b04_strip_bullet(spark, sf):
    lines = fc.lines_table(structured(spark, sf))
    return lines.select("doc_id", "pos", tx.strip_bullet(c("text")).alias("bare"))


@register
def b05_words(spark, sf):
    return prose(spark, sf).select(
        "doc_id", tx.word_count(tx.normalise_text(c("text"))).alias("word_count"),
        F.md5(joined(tx.words(c("text")), " ")).alias("words_md5"),
    )


@register
def b06_char_count(spark, sf):
    return prose(spark, sf).select("doc_id", tx.char_count(c("text")).alias("char_count"))


@register
def b07_bullets(spark, sf):
    facts = fc.build_facts(structured(spark, sf))
    items = F.transform("bullets", lambda b, i: F.struct(i.alias("pos"), b.alias("bullet")))
    return explode_rows(facts, ["doc_id"], items)


@register
def b08_header(spark, sf):
    return fc.build_facts(structured(spark, sf)).select("doc_id", "header")


@register
def b09_heading_key(spark, sf):
    lines = fc.lines_table(structured(spark, sf))
    return lines.select("doc_id", "pos", F.coalesce(fc.heading_key(c("text")), F.lit("-")).alias("key"))


@register
def b10_detect_sections(spark, sf):
    sections = fc.sections_table(fc.build_facts(structured(spark, sf)))
    return sections.select(
        "doc_id", "section_ord", "key", "heading", "line_index", F.size("body").alias("n_body"),
        F.md5(joined("body", "\n")).alias("body_md5"),
    )


@register
def b11_section_keys(spark, sf):
    facts = fc.build_facts(structured(spark, sf))
    return facts.select(
        "doc_id", joined(F.array_sort("section_keys")).alias("section_keys"),
        F.array_contains("section_keys", "skills").alias("has_skills"),
    )


@register
def b12_estimate_pages(spark, sf):
    docs = structured(spark, sf)
    return docs.select("doc_id", fc.estimate_pages(tx.split_lines(c("text"))).alias("pages"))


@register
def b13_extract_urls(spark, sf):
    pages = read_corpus(spark, f"{sf}/pages.parquet", "page_id", "html", keep=("url",), partitions=PARTS)
    return pages.select("doc_id", joined(ex.urls(F.concat_ws(" ", "url", "text")), " ").alias("urls"))


@register
def b14_tokenise(spark, sf):
    t = tx.tokenise(c("text"))
    return prose(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.md5(joined(t, " ")).alias("tokens_md5"))


@register
def b15_build_facts(spark, sf):
    f = fc.build_facts(structured(spark, sf))
    return f.select(
        "doc_id", "word_count", "char_count", F.size("lines").alias("n_lines"), F.size("nonblank").alias("n_nonblank"),
        F.size("bullets").alias("n_bullets"), F.size("sections").alias("n_sections"),
        F.md5("lower").alias("lower_md5"), F.length("header").alias("header_len"),
    )


PSEUDO_TERMS = ["tion", "rewh", "orre", "thatin", "ononst", "inoran"]


@register
def b16_find_phrases(spark, sf):
    return prose(spark, sf).select("doc_id", joined(tx.find_phrases(F.lower("text"), PSEUDO_TERMS)).alias("found"))


@register
def b17_find_terms(spark, sf):
    from docassay import lexicon as lx

    docs = structured(spark, sf)
    return docs.select("doc_id", joined(tx.find_terms(F.lower("text"), lx.all_skills())).alias("found"))


# --- D: rules -------------------------------------------------------------

def _rule_query(position: int, rule_id: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rule = next(r for r in default_pack().rules if r.id == rule_id)
        pack = RulePack([rule])
        checks = decide(structured(spark, sf), pack).select("doc_id", pack.checks().alias("checks"))
        return explode_rows(checks, ["doc_id"], "checks").select(
            "doc_id", "state", "score", "weight", joined("evidence").alias("evidence")
        )

    run.__name__ = f"d{position:02d}_{rule_id.replace('.', '_').replace('-', '_')}"
    register(run)


RULE_IDS = [
    "parse.text", "parse.order", "parse.fonts", "parse.containers", "parse.images", "parse.header",
    "parse.format", "parse.shape", "contact.reachable", "contact.position", "contact.email-tone",
    "contact.links", "contact.url-form", "contact.location", "structure.sections",
    "structure.depth", "structure.dates", "structure.order", "structure.name", "impact.verbs",
    "impact.metrics", "impact.pronouns", "impact.filler", "impact.objective",
    "impact.bullet-length", "impact.variety", "skills.named", "skills.breadth", "skills.fluff",
    "skills.evidence", "hygiene.personal", "hygiene.length", "hygiene.pages", "hygiene.filename",
    "hygiene.spelling", "hygiene.caps",
]
for _i, _id in enumerate(RULE_IDS, start=1):
    _rule_query(_i, _id)


# --- F, G: roll-ups and ranks --------------------------------------------

def scored(spark, sf, keep=()) -> DataFrame:
    return score_documents(structured(spark, sf, keep), keep=keep)


@register
def f01_category_scores(spark, sf):
    return sc.category_rows(scored(spark, sf)).select("doc_id", "ord", "id", "score", "weight", "pct")


@register
def f01_category_scores_long(spark, sf):
    return sc.category_scores(sc.check_results(scored(spark, sf)))


@register
def f02_document_score(spark, sf):
    return scored(spark, sf).select("doc_id", "total_score", "total_weight", "score")


@register
def f03_doc_facts_summary(spark, sf):
    return fc.facts_summary(fc.build_facts(structured(spark, sf)))


@register
def f04_state_counts(spark, sf):
    n = sc.count_states(c("checks"))
    return scored(spark, sf).select("doc_id", *[n[k].alias(k) for k in ("n_all", "n_todo", "n_pass")])


@register
def f05_passed_of_scored(spark, sf):
    n = sc.count_states(c("checks"))
    return scored(spark, sf).select("doc_id", n["n_scored_pass"].alias("n_pass"), n["n_scored"].alias("n_scored"))


@register
def f06_todo_per_category(spark, sf):
    return sc.todo_per_category(scored(spark, sf))


@register
def f11_bullet_stats(spark, sf):
    from docassay.functions.patterns import WS

    facts = fc.build_facts(structured(spark, sf))
    facts = facts.select("doc_id", F.transform("bullets", lambda b: F.size(F.split(b, WS + "+"))).alias("n"))
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    return facts.select(
        "doc_id",
        F.coalesce(F.floor(total / F.nullif(F.size("n"), F.lit(0)) + 0.5), F.lit(0)).cast("int").alias("avg_words"),
        F.size(F.filter("n", lambda x: x > 34)).alias("n_long"),
        F.size(F.filter("n", lambda x: x < 6)).alias("n_short"),
    )


@register
def f12_distinct_matches(spark, sf):
    t = c("text")
    return structured(spark, sf).select(
        "doc_id", joined(ex.emails(t)).alias("emails"), joined(ex.metrics(t)).alias("metrics"),
        joined(ex.date_ranges(t)).alias("ranges"), joined(ex.phones(t)).alias("phones"),
    )


def _rollup(spark, sf, how):
    results = sc.check_results(scored(spark, sf, keep=("lang",)), keep=("lang",))
    out = sc.corpus_rollup(results, ["lang", "id"], how)
    return out.select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("id", F.lit("*")).alias("id"),
        c("level").cast("int").alias("level"), "n_checks", "n_pass", "n_warn", "n_fail", "points_lost",
    )


@register
def f13_corpus_rollup(spark, sf):
    return _rollup(spark, sf, "rollup")


@register
def f13_corpus_cube(spark, sf):
    return _rollup(spark, sf, "cube")


@register
def e07_band_lookup(spark, sf):
    return scored(spark, sf).select("doc_id", "score", "band_id")


@register
def e07_band_range_join(spark, sf):
    return sc.band_lookup(scored(spark, sf), sc.bands_table(spark)).select("doc_id", "score", "band_id")


@register
def g01_top_actions(spark, sf):
    return sc.action_rows(scored(spark, sf))


@register
def g06_repeated_openers(spark, sf):
    graded = decide(structured(spark, sf), RulePack([r for r in default_pack().rules if r.id == "impact.variety"]))
    rows = F.transform("s_openers", lambda o, i: F.struct(
        (i + 1).alias("rank"), o["word"].alias("word"), o["n"].alias("n")))
    return explode_rows(graded.select("doc_id", rows.alias("r")), ["doc_id"], "r")


@register
def g07_first_n_evidence(spark, sf):
    return structured(spark, sf).select("doc_id", joined(F.slice(ex.metrics(c("text")), 1, 4)).alias("first4"))


@register
def g08_first_section(spark, sf):
    facts = fc.build_facts(structured(spark, sf))
    first = F.get(F.filter("sections", lambda s: s["key"] == "skills"), F.lit(0))
    return facts.select(
        "doc_id", first["line_index"].alias("line_index"), F.size(first["body"]).alias("n_body"),
    )


@register
def g10_filter_checks(spark, sf):
    def shown(view):
        n = sc.per_category(sc.view_checks(c("checks"), view), lambda of: [F.size(of).cast("long").alias("n_visible")])
        return F.transform(n, lambda r: F.struct(F.lit(view).alias("view"), r["category"].alias("category"), r["n_visible"].alias("n_visible")))

    return explode_rows(scored(spark, sf), ["doc_id"], F.concat(*[shown(v) for v in ("all", "todo", "pass")]))


@register
def k07_tone(spark, sf):
    rows = sc.category_rows(scored(spark, sf))
    return rows.select("doc_id", "id", ph.tone(c("pct")).alias("tone"))


@register
def k02_excerpt(spark, sf):
    return prose(spark, sf).select("doc_id", ph.excerpt(c("text")).alias("short"), ph.excerpt(c("text"), 44).alias("shorter"))


@register
def k03_list_phrase(spark, sf):
    found = tx.find_phrases(F.lower("text"), PSEUDO_TERMS)
    return prose(spark, sf).select("doc_id", found.alias("f")).select(
        "doc_id", ph.list_phrase(c("f")).alias("phrase"), ph.pluralise(F.size("f"), "term").alias("counted")
    )


@register
def k05_thousands(spark, sf):
    return prose(spark, sf).select("doc_id", ph.thousands(F.length("text")).alias("n"))


@register
def k08_state_marks(spark, sf):
    results = sc.check_results(scored(spark, sf))
    return results.select("doc_id", "id", ph.state_mark(c("state")).alias("mark"), ph.state_words(c("state")).alias("words"))


def all_queries() -> dict[str, Query]:
    import importlib

    for extra in ("catalog_terms", "catalog_layout", "catalog_stream"):
        importlib.import_module(f"docassay.{extra}")
    return dict(sorted(QUERIES.items()))
