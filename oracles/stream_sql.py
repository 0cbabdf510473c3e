"""SQL for revisions, streams and sinks."""

from __future__ import annotations

from docassay import lexicon as lx
from oracles import core_sql
from oracles.facts_sql import DOCS, lit, plain_docs
from oracles.rules_sql import BAND, CHECKS, checks_for
from oracles.terms_sql import MATCH, POSTS, TERMS

O: dict[str, str] = {}

QUIET = (
    "WITH n AS (SELECT user_id, event_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) "
    "SELECT user_id, event_id, ts, value FROM n WHERE (nxt IS NULL OR nxt - ts > INTERVAL 6 HOUR)"
)
O["j01_debounce"] = O["j01_debounce_sessions"] = O["j01_debounce_stream"] = QUIET
RAW = checks_for(plain_docs("SELECT doc_id, text FROM documents"))
O["f02_flagship"] = O["j02_score_stream"] = (
    f"{RAW} SELECT doc_id, score, {BAND} AS band_id, total_score, total_weight FROM scored"
)
TURNS = checks_for(plain_docs("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"))
O["g09_score_delta"] = O["j03_delta_stream"] = (
    f"{TURNS}, s AS (SELECT doc_id // 1000 AS doc_id, (doc_id % 1000) // 4 AS generation, doc_id % 1000 AS rev, score FROM scored), "
    "b AS (SELECT *, lag(score) OVER (PARTITION BY doc_id, generation ORDER BY rev) AS before FROM s) "
    "SELECT doc_id, generation, rev, score, nullif(score - before, 0)::INT AS delta FROM b"
)
O["j04_match_stream"] = (
    f"WITH {POSTS}, {TERMS}, d AS (SELECT conv_id AS doc_id, turn AS rev, conv_id % (SELECT count(*) FROM benchmark) AS posting_id, lower(text) AS lower FROM conversations), "
    "m AS (SELECT d.doc_id, d.rev, d.posting_id, regexp_matches(d.lower, '(^|[^a-z0-9+#.])' || regexp_escape(t.term) || '($|[^a-z0-9+#])') AS hit FROM d LEFT JOIN terms t USING (posting_id)) "
    "SELECT doc_id, rev, posting_id, count(hit)::INT AS n_terms, (count(*) FILTER (hit))::INT AS n_matched, "
    "coalesce(floor((count(*) FILTER (hit))::DOUBLE / nullif(count(hit), 0)::DOUBLE * 100 + 0.5), 0)::INT AS coverage FROM m GROUP BY doc_id, rev, posting_id"
)
_ASKED = "(SELECT max(q.turn) FROM conversations q WHERE q.conv_id = c.conv_id AND q.turn <= c.turn AND q.turn % 3 = 1)"
O["j04_compare_stream"] = (
    f"WITH {POSTS}, {TERMS}, r AS (SELECT conv_id AS doc_id, turn AS rev, {_ASKED} AS asked, text FROM conversations c), "
    "d AS (SELECT doc_id, rev, (doc_id + asked) % (SELECT count(*) FROM benchmark) AS posting_id, lower(text) AS lower FROM r WHERE asked IS NOT NULL), "
    "m AS (SELECT d.doc_id, d.rev, d.posting_id, regexp_matches(d.lower, '(^|[^a-z0-9+#.])' || regexp_escape(t.term) || '($|[^a-z0-9+#])') AS hit FROM d LEFT JOIN terms t USING (posting_id)) "
    "SELECT doc_id, rev, posting_id, count(hit)::INT AS n_terms, (count(*) FILTER (hit))::INT AS n_matched, "
    "coalesce(floor((count(*) FILTER (hit))::DOUBLE / nullif(count(hit), 0)::DOUBLE * 100 + 0.5), 0)::INT AS coverage FROM m GROUP BY doc_id, rev, posting_id"
)
O["a07_report_tables"] = core_sql.ORACLES["f01_category_scores_long"]
O["a07_report_stream"] = core_sql.ORACLES["f01_category_scores_long"]
O["a07_report_stream_actions"] = core_sql.ORACLES["g01_top_actions"]
O["a07_report_stream_reports"] = f"{CHECKS} SELECT doc_id, score, total_score, total_weight, {BAND} AS band_id FROM scored"
_STRICT = CHECKS
for _old, _new in ((">= 0.7", ">= 0.9"), ("BETWEEN 300 AND 700", "BETWEEN 300 AND 500")):
    assert _old in _STRICT
    _STRICT = _STRICT.replace(_old, _new)
_NEW = "CASE id WHEN 'skills.named' THEN 20 WHEN 'impact.metrics' THEN 3 END"
_OLD = "CASE id WHEN 'skills.named' THEN 8 WHEN 'impact.metrics' THEN 8 END"
_HEAVY = f"h AS (SELECT doc_id, coalesce(floor(score * {_NEW} / ({_OLD})::DOUBLE + 0.5), score)::INT AS score, coalesce({_NEW}, weight)::INT AS weight FROM checks)"
O["l01_rule_packs"] = (
    f"SELECT * FROM ({CHECKS} SELECT doc_id, 'plain' AS pack, score, total_score, total_weight FROM scored) "
    f"UNION ALL SELECT * FROM ({_STRICT} SELECT doc_id, 'strict' AS pack, score, total_score, total_weight FROM scored) "
    f"UNION ALL SELECT * FROM ({CHECKS}, {_HEAVY} SELECT doc_id, 'skills' AS pack, coalesce(floor(sum(score)::DOUBLE / nullif(sum(weight)::DOUBLE, 0) * 100 + 0.5), 0)::INT AS score, "
    "sum(score)::INT AS total_score, sum(weight)::INT AS total_weight FROM h GROUP BY doc_id)"
)
_slug = "regexp_replace(regexp_replace(lower(regexp_replace(coalesce(file_name, 'resume'), '[.][^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
O["a09_report_file_name"] = f"{DOCS} SELECT doc_id, 'report-' || coalesce(nullif(left({_slug}, 48), ''), 'resume') || '-2024-05-06.md' AS name FROM docs"


def _names(col: str, table: dict, at: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v[at])}" for k, v in table.items()) + " END"


_ORD = "CASE category " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(lx.CATEGORY_IDS)) + " END"
_CAT = (
    f"cats AS (SELECT doc_id, category, {_ORD} AS ord, {_names('category', lx.CATEGORY_TEXT, 0)} AS name, sum(score)::INT AS s, sum(weight)::INT AS w, "
    "coalesce(floor(sum(score)::DOUBLE / nullif(sum(weight)::DOUBLE, 0) * 100 + 0.5), 0)::INT AS pct FROM checks GROUP BY doc_id, category)"
)
O["a08_report_markdown"] = (
    f"{CHECKS}, {_CAT}, banded AS (SELECT doc_id, score, {BAND} AS band_id FROM scored), "
    "lists AS (SELECT doc_id, string_agg('- **' || name || '** - ' || pct || '% (' || s || '/' || w || ')', chr(10) ORDER BY ord) AS areas, "
    "string_agg('### ' || name || ' (' || s || '/' || w || ')', chr(10) ORDER BY ord) AS heads FROM cats GROUP BY doc_id), "
    f"marks AS (SELECT doc_id, string_agg(CASE state WHEN 'pass' THEN '[x]' WHEN 'warn' THEN '[!]' WHEN 'fail' THEN '[ ]' ELSE '[-]' END, '' ORDER BY {_ORD}, check_ord) AS marks FROM checks GROUP BY doc_id) "
    f"SELECT b.doc_id, '# Document report' || chr(10) || '**Score:** ' || b.score || '/100 - ' || {_names('b.band_id', lx.BAND_TEXT, 0)} || chr(10) || "
    f"'Source: ' || coalesce(f.file_name, CASE f.source_kind WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'Word file' ELSE 'plain text' END) || ' · ' || f.word_count || ' words · ' || "
    "len(f.bullets) || ' bullets · ' || len(f.sections) || ' sections' || chr(10) || '## Areas' || chr(10) || areas || chr(10) || '## First steps' || chr(10) || '## All checks' || chr(10) || heads AS outline, marks "
    "FROM banded b JOIN lists USING (doc_id) JOIN marks USING (doc_id) JOIN facts f ON f.doc_id = b.doc_id"
)
O["a08_markdown_with_posting"] = (
    f"{MATCH}, one AS (SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY posting_id) = 1) "
    "SELECT d.doc_id, CASE WHEN coverage IS NULL THEN '' ELSE 'Has ' || coverage || '% of the terms mined from the posting and ' || skill_coverage || '% of its tools; this does not move the score.' || "
    "CASE WHEN matched <> '' THEN chr(10) || '**Present:** ' || matched ELSE '' END || CASE WHEN missing <> '' THEN chr(10) || '**Absent:** ' || missing ELSE '' END END AS posting_part "
    "FROM docs d LEFT JOIN one ON one.doc_id = d.doc_id"
)
ORACLES = O
