"""DuckDB SQL for the 36 rules: (condition, state, score, evidence) per branch."""

from __future__ import annotations

from docassay import lexicon as lx
from oracles.facts_sql import DOCS, SIGNALS, excerpt, lit, lits, rx

TEXT = "source_kind = 'text'"
_BASE = r"regexp_replace(file_name, '[.][^.]+$', '')"


def _ex(col: str, k: int) -> str:
    return f"list_transform({col}[1:{k}], lambda b: {excerpt('b', 70)})"


def _name() -> str:
    from oracles.facts_sql import WS

    return (
        "length(first_line) BETWEEN 1 AND 48 AND NOT regexp_matches(first_line, '@|[0-9]{4}') "
        f"AND len(regexp_split_to_array(first_line, {lit(WS + '+')})) <= 5 AND regexp_matches(first_line, {rx(lx.PERSON_NAME)})"
    )


_NICK = (
    f"(len(list_filter({lits(lx.EMAIL_NICKNAMES)}, lambda w: contains(email_local, w))) > 0 "
    "OR length(regexp_extract(email_local, '[0-9]{4,}', 0)) >= 5)"
)
_LINKED = "list_contains(links, 'linkedin')"
_CODED = "(list_contains(links, 'code') OR list_contains(links, 'portfolio'))"
_NAMES = (
    "list_transform(links, lambda k: CASE k WHEN 'linkedin' THEN 'LinkedIn' WHEN 'code' THEN 'a code host' "
    "WHEN 'portfolio' THEN 'an own site' ELSE 'published work' END)"
)
_EDU, _SKL = "list_contains(keys, 'education')", "list_contains(keys, 'skills')"
_EVI = "(list_contains(keys, 'projects') OR list_contains(keys, 'experience'))"
_MISSING = f"((NOT {_EDU})::INT + (NOT {_SKL})::INT + (NOT {_EVI})::INT)"
_POINTS = f"({_EDU}::INT * 3 + {_SKL}::INT * 3 + {_EVI}::INT * 4)"
_SHARE = "len(strong)::DOUBLE / nullif(len(bullets), 0)"
_SOFT = "CASE WHEN len(found) > 0 THEN len(soft)::DOUBLE / len(found) ELSE len(soft)::DOUBLE END"
_SHOWN = "len(list_filter(listed, lambda t: list_contains(in_evidence, t)))"
_COVER = f"CASE WHEN len(listed) > 0 THEN {_SHOWN}::DOUBLE / len(listed) ELSE 1 END"
_UNBACKED = "list_filter(listed, lambda t: NOT list_contains(in_evidence, t))[1:6]"
_NOTES = (
    "list_concat(list_transform(typos, lambda w: w || ' → ' || CASE w "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lx.TYPOS.items())
    + " END), slips)"
)
_OPEN = (
    "list_transform(list_sort(list_transform(repeated, lambda w: "
    "{'a': -len(list_filter(openers, lambda o: o = w)), 'b': list_position(openers, w), 'c': w})), "
    "lambda s: s.c || ' ×' || (-s.a)::VARCHAR)"
)
T = "true"

#: id -> (weight, emitted, branches)
RULES = {
    "parse.text": (10, T, [("text_density >= 1200", "pass", 10), ("text_density >= 400", "warn", 5), (T, "fail", 0)]),
    "parse.order": (6, T, [(TEXT, "info", 0), ("multi_column", "fail", 0), ("right_column_ratio > 0.35", "warn", 3), (T, "pass", 6)]),
    "parse.fonts": (3, T, [(TEXT, "info", 0), ("broken_glyphs", "fail", 0), (T, "pass", 3)]),
    "parse.containers": (4, T, [(TEXT, "info", 0), ("text_box_chars > 60 OR multi_column", "fail", 0), ("tabular_rows >= 6", "warn", 2), (T, "pass", 4)]),
    "parse.images": (2, f"NOT {TEXT} AND (image_count > 0 OR source_kind = 'docx')", [("image_count > 0", "warn", 1), (T, "pass", 2)]),
    "parse.header": (4, "contact_in_header_only", [(T, "fail", 0)]),
    "parse.format": (3, T, [(TEXT, "info", 0), (T, "pass", 3)]),
    "parse.shape": (3, "word_count > 0 AND len(nonblank) < 8", [(T, "fail", 0)]),
    "contact.reachable": (8, T, [("len(emails) > 0 AND len(phones) > 0", "pass", 8, "[emails[1], trim(phones[1])]"),
                                 ("len(emails) + len(phones) > 0", "warn", 4), (T, "fail", 0)]),
    "contact.position": (3, "len(emails) + len(phones) > 0", [("header_contact", "pass", 3), (T, "warn", 1)]),
    "contact.email-tone": (3, "len(emails) > 0", [(_NICK, "warn", 1), (T, "pass", 3, "[emails[1]]")]),
    "contact.links": (7, T, [(f"{_LINKED} AND {_CODED}", "pass", 7, _NAMES), ("len(links) > 0", "warn", 4), (T, "fail", 0)]),
    "contact.url-form": (2, "len(links) > 0", [("full_url OR len(hyperlinks) > 0", "pass", 2), (T, "warn", 1)]),
    "contact.location": (2, T, [("location", "pass", 2), (T, "warn", 0)]),
    "structure.sections": (10, T, [
        (f"{_MISSING} = 0", "pass", _POINTS, "list_transform(list_filter(sections, lambda s: s.key IN ('education', 'skills', 'projects', 'experience')), lambda s: s.heading)"),
        (f"{_MISSING} = 1", "warn", _POINTS), (T, "fail", _POINTS)]),
    "structure.depth": (5, _EVI, [("detail >= 6", "pass", 5), ("detail >= 2", "warn", 3), (T, "fail", 0)]),
    "structure.dates": (4, T, [("len(ranges) >= 2", "pass", 4, "ranges[1:3]"), ("len(ranges) = 1 OR years >= 2", "warn", 2), (T, "fail", 0)]),
    "structure.order": (3, "len(sections) >= 3", [("coalesce(first_private < first_evidence, false)", "fail", 0), (T, "pass", 3)]),
    "structure.name": (3, T, [(_name(), "pass", 3, "[first_line]"), (T, "warn", 1)]),
    "impact.verbs": (9, T, [("len(bullets) = 0", "fail", 0), (f"{_SHARE} >= 0.7", "pass", 9, _ex("strong", 2)),
                            (f"{_SHARE} >= 0.35", "warn", 5, _ex("duties", 2)), (T, "fail", 0, _ex("duties", 3))]),
    "impact.metrics": (8, T, [("len(metrics) >= 4", "pass", 8, "list_transform(metrics[1:4], lambda m: trim(m))"),
                              ("len(metrics) >= 1", "warn", 4, "list_transform(metrics[1:3], lambda m: trim(m))"), (T, "fail", 0)]),
    "impact.pronouns": (3, T, [("pronouns = 0", "pass", 3), ("pronouns <= 2", "warn", 2), (T, "fail", 0)]),
    "impact.filler": (5, T, [("len(filler) = 0", "pass", 5), ("len(filler) <= 2", "warn", 3, "filler"), (T, "fail", 0, "filler[1:6]")]),
    "impact.objective": (4, "list_contains(keys, 'summary') OR len(weak_openers) > 0",
                         [("len(weak_openers) = 0", "pass", 4), (T, "fail", 0, "weak_openers")]),
    "impact.bullet-length": (3, "len(bullets) >= 3", [
        ("len(list_filter(bullet_words, lambda n: n > 34)) = 0 AND len(list_filter(bullet_words, lambda n: n < 6)) <= 1", "pass", 3), (T, "warn", 1)]),
    "impact.variety": (2, "len(bullets) >= 4", [("len(repeated) = 0", "pass", 2), (T, "warn", 1, _OPEN)]),
    "skills.named": (8, T, [("len(found) >= 8", "pass", 8, "found[1:8]"), ("len(found) >= 4", "warn", 5, "found"), (T, "fail", 0)]),
    "skills.breadth": (3, "len(found) >= 3", [("len(skill_groups) >= 3", "pass", 3), (T, "warn", 1)]),
    "skills.fluff": (3, "len(soft) + len(found) > 0", [("len(soft) = 0", "pass", 3), (f"{_SOFT} <= 0.35", "warn", 2, "soft"), (T, "fail", 0, "soft[1:6]")]),
    "skills.evidence": (4, "len(found) >= 3 AND skills_section IS NOT NULL AND length(evidence_text) > 80",
                        [(f"{_COVER} >= 0.4", "pass", 4), (f"{_COVER} >= 0.2", "warn", 2, _UNBACKED), (T, "fail", 0, _UNBACKED)]),
    "hygiene.personal": (6, T, [("len(personal) = 0", "pass", 6), ("len(personal) <= 2", "warn", 3, "personal"), (T, "fail", 0, "personal[1:8]")]),
    "hygiene.length": (5, T, [("word_count BETWEEN 300 AND 700", "pass", 5), ("word_count BETWEEN 200 AND 900", "warn", 3), (T, "fail", 0)]),
    "hygiene.pages": (4, f"NOT {TEXT}", [("page_count = 1", "pass", 4), ("page_count = 2", "warn", 2), (T, "fail", 0)]),
    "hygiene.filename": (2, "coalesce(file_name, '') <> ''", [
        (f"NOT regexp_matches({_BASE}, {rx(lx.SLOPPY_FILE, True)}) AND regexp_matches({_BASE}, {rx(lx.NAMED_FILE, True)}) AND length({_BASE}) >= 6", "pass", 2),
        (T, "warn", 0)]),
    "hygiene.spelling": (4, T, [("mistakes = 0", "pass", 4), ("mistakes <= 2", "warn", 2, _NOTES), (T, "fail", 0, _NOTES + "[1:8]")]),
    "hygiene.caps": (2, "shouting > 0", [("shouting = 1", "warn", 1), (T, "fail", 0)]),
}


def _pick(branches, at: int, default: str = "NULL", quoted: bool = False) -> str:
    parts = []
    for b in branches:
        value = b[at] if len(b) > at else default
        parts.append(f"WHEN {b[0]} THEN {lit(value) if quoted else value}")
    return "CASE " + " ".join(parts) + " END"


def _weight(weight: int, branches) -> str:
    infos = [b[0] for b in branches if b[1] == "info"]
    return f"CASE WHEN {infos[0]} THEN 0 ELSE {weight} END" if infos else str(weight)


def rule_sql(rule_id: str) -> str:
    weight, emitted, branches = RULES[rule_id]
    return (
        f"{SIGNALS} SELECT doc_id, {_pick(branches, 1, quoted=True)} AS state, ({_pick(branches, 2)})::INT AS score, "
        f"({_weight(weight, branches)})::INT AS weight, "
        f"coalesce(array_to_string({_pick(branches, 3)}, ' | '), '') AS evidence FROM signals WHERE {emitted}"
    )


def checks_cte(signals: str = SIGNALS) -> str:
    """Signals plus ``checks``: one row per document and emitted rule."""
    entries = []
    for i, (rule_id, (weight, emitted, branches)) in enumerate(RULES.items()):
        entries.append(
            f"CASE WHEN {emitted} THEN {{'check_ord': {i}, 'id': {lit(rule_id)}, 'category': {lit(rule_id.split('.')[0])}, "
            f"'state': {_pick(branches, 1, quoted=True)}, 'score': ({_pick(branches, 2)})::INT, 'weight': ({_weight(weight, branches)})::INT}} END"
        )
    return (
        f"{signals}, per_doc AS (SELECT doc_id, source_kind, unnest([{', '.join(entries)}]) AS k FROM signals), "
        "checks AS (SELECT doc_id, source_kind, k.check_ord, k.id, k.category, k.state, k.score, k.weight FROM per_doc WHERE k IS NOT NULL), "
        "totals AS (SELECT doc_id, sum(score)::INT AS total_score, sum(weight)::INT AS total_weight FROM checks GROUP BY doc_id), "
        "scored AS (SELECT *, coalesce(floor(total_score::DOUBLE / nullif(total_weight::DOUBLE, 0) * 100 + 0.5), 0)::INT AS score FROM totals)"
    )


BAND = "CASE WHEN score >= 85 THEN 'ready' WHEN score >= 70 THEN 'close' WHEN score >= 50 THEN 'weak' ELSE 'rework' END"
CHECKS = checks_cte()


def checks_for(docs: str) -> str:
    """The same for other document CTEs."""
    return checks_cte(docs + SIGNALS[len(DOCS):])
