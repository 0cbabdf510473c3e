"""SQL for sources, text, rules, roll-ups and ranks."""

from __future__ import annotations

from docassay import lexicon as lx
from oracles import facts_sql as fs
from oracles.facts_sql import DOCS, FACTS, SIGNALS, lit
from oracles.rules_sql import BAND, CHECKS, RULES, rule_sql

PSEUDO = ["tion", "rewh", "orre", "thatin", "ononst", "inoran"]
O: dict[str, str] = {}

CLEAN = f"WITH d AS (SELECT doc_id, {fs.normalise('text')} AS text FROM documents)"
_FILES = (
    "WITH f AS (SELECT page_id AS doc_id, ['txt', 'md', 'rtf', 'doc', 'pages', 'pdf', 'docx', 'bin', 'pdf', 'html'][page_id % 10 + 1] AS ext, "
    "CASE WHEN page_id % 13 = 0 THEN 0 ELSE length(html) END AS n, "
    "CASE page_id % 7 WHEN 1 THEN '%PDF' WHEN 2 THEN 'PK' ELSE '' END || left(html, 8) AS head FROM pages), "
    "k AS (SELECT doc_id, ext, n, CASE WHEN ext IN ('txt', 'md') THEN 'text' WHEN ext = 'rtf' THEN 'rtf' WHEN ext IN ('doc', 'pages') THEN NULL "
    "WHEN ext = 'pdf' OR starts_with(head, '%PDF') THEN 'pdf' WHEN ext = 'docx' OR starts_with(head, 'PK') THEN 'docx' END AS kind FROM f), "
    "r AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n > 4000 THEN 'too_large' WHEN ext = 'doc' THEN 'old_word' WHEN ext = 'pages' THEN 'apple_pages' "
    "WHEN kind IS NULL THEN 'unknown' END AS reason FROM k) "
)
O["a02_classify_files"] = f"{_FILES} SELECT doc_id, CASE WHEN reason IS NULL THEN kind END AS kind, reason FROM r"
_RTF = r"""'{\rtf1\ansi{\*\generator own;}\pard ' || replace(replace(text, 'e', '\''e9'), chr(10), '\par' || chr(10)) || '\tab end\line }'"""
_BYTES = r"""array_to_string(list_transform(string_split(raw, '\'''), lambda p, i: CASE WHEN i > 1 THEN chr(('0x' || p[1:2])::INT) || p[3:] ELSE p END), '')"""
_BREAKS = r"""regexp_replace(regexp_replace(regexp_replace(t, '\\pard?\b', chr(10), 'g'), '\\line\b', chr(10), 'g'), '\\tab\b', '   ', 'g')"""
_BARE = r"""regexp_replace(regexp_replace(t, '\{\\\*[^{}]*\}', '', 'g'), '\\[a-zA-Z]+-?[0-9]*\s?', '', 'g')"""
O["a04_strip_rtf"] = (
    f"WITH b AS (SELECT doc_id, {_RTF} AS raw FROM documents), d AS (SELECT doc_id, {_BYTES} AS t FROM b), e AS (SELECT doc_id, {_BREAKS} AS t FROM d), "
    f"g AS (SELECT doc_id, {_BARE} AS t FROM e), p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[{{}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM g) "
    "SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS n FROM p"
)
O["a01_read_corpus"] = (
    f"{CLEAN} SELECT doc_id, md5(text) AS text_md5, 'text' AS source_kind, NULL::VARCHAR AS file_name, "
    f"greatest(1, ceil(len(list_filter(string_split(text, chr(10)), lambda l: {fs.trim('l')} <> '')) / 46.0))::INT AS page_count, "
    f"{fs.char_count('text')}::BIGINT AS text_density, len({fs.urls('text')})::INT AS n_links FROM d"
)
O["a03_split_rejects"] = (
    f"SELECT doc_id, CASE WHEN length({fs.trim('text')}) < 120 THEN 'too short' ELSE 'ok' END AS outcome FROM documents"
)
O["a05_min_length_gate"] = f"SELECT doc_id, length(text)::INT AS n FROM documents WHERE length({fs.trim('text')}) >= 120"
O["a06_low_text_flag"] = (
    f"{CLEAN} SELECT doc_id, CASE WHEN {fs.char_count('text')} < 200 THEN 'almost no text' ELSE 'ok' END AS status FROM d"
)
O["b01_normalise_text"] = f"{CLEAN} SELECT doc_id, text FROM d"
O["b01_normalise_pages"] = f"SELECT page_id AS doc_id, md5({fs.normalise('html')}) AS text_md5 FROM pages"
LINES = (
    f"{DOCS}, ls AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {{'pos': i - 1, 'text': l}})) AS r FROM docs), "
    "lines AS (SELECT doc_id, r.pos::INT AS pos, r.text AS text FROM ls)"
)
O["b02_split_lines"] = f"{LINES} SELECT doc_id, pos, text, {fs.is_bullet('text')} AS bullet, 1 AS page FROM lines"
O["b03_is_bullet"] = f"{LINES} SELECT doc_id, count(*) FILTER ({fs.is_bullet('text')}) AS n_bullets, count(*) AS n_lines FROM lines GROUP BY doc_id"
O["b04_strip_bullet"] = f"{LINES} SELECT doc_id, pos, {fs.strip_bullet('text')} AS bare FROM lines"
O["b05_words"] = (
    f"SELECT doc_id, len({fs.words('text')})::INT AS word_count, md5(array_to_string({fs.words('text')}, ' ')) AS words_md5 FROM documents"
)
O["b06_char_count"] = f"SELECT doc_id, {fs.char_count('text')}::INT AS char_count FROM documents"
O["b07_bullets"] = (
    f"{FACTS}, r AS (SELECT doc_id, unnest(list_transform(bullets, lambda b, i: {{'pos': i - 1, 'bullet': b}})) AS k FROM facts) "
    "SELECT doc_id, k.pos::INT AS pos, k.bullet AS bullet FROM r"
)
O["b08_header"] = f"{FACTS} SELECT doc_id, header FROM facts"
O["b09_heading_key"] = f"{LINES} SELECT doc_id, pos, coalesce({fs.heading_key(fs.trim('text'))}, '-') AS key FROM lines"
O["b10_detect_sections"] = (
    f"{FACTS}, r AS (SELECT doc_id, unnest(list_transform(sections, lambda s, i: {{'o': i - 1, 's': s}})) AS k FROM facts) "
    "SELECT doc_id, k.o::INT AS section_ord, k.s.key AS key, k.s.heading AS heading, k.s.line_index::INT AS line_index, "
    "len(k.s.body)::INT AS n_body, md5(array_to_string(k.s.body, chr(10))) AS body_md5 FROM r"
)
O["b11_section_keys"] = (
    f"{FACTS} SELECT doc_id, array_to_string(list_sort(list_distinct(keys)), ' | ') AS section_keys, list_contains(keys, 'skills') AS has_skills FROM facts"
)
O["b12_estimate_pages"] = f"{FACTS} SELECT doc_id, greatest(1, ceil(len(nonblank) / 46.0))::INT AS pages FROM facts"
_u = "url || ' ' || html"
O["b13_extract_urls"] = f"SELECT page_id AS doc_id, array_to_string({fs.urls(_u)}, ' ') AS urls FROM pages"
O["b14_tokenise"] = (
    f"WITH t AS (SELECT doc_id, {fs.tokens('text')} AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"
)
O["b15_build_facts"] = (
    f"{FACTS} SELECT doc_id, word_count::INT AS word_count, char_count::INT AS char_count, len(lines)::INT AS n_lines, len(nonblank)::INT AS n_nonblank, "
    "len(bullets)::INT AS n_bullets, len(sections)::INT AS n_sections, md5(lower) AS lower_md5, length(header)::INT AS header_len FROM facts"
)
O["b16_find_phrases"] = f"SELECT doc_id, array_to_string({fs.phrases('lower(text)', PSEUDO)}, ' | ') AS found FROM documents"
O["b17_find_terms"] = f"{DOCS}, l AS (SELECT doc_id, lower(text) AS lower FROM docs) SELECT doc_id, array_to_string({fs.terms('lower', lx.all_skills())}, ' | ') AS found FROM l"
for _i, _rule in enumerate(RULES, start=1):
    O[f"d{_i:02d}_{_rule.replace('.', '_').replace('-', '_')}"] = rule_sql(_rule)

_ORD = "CASE category " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(lx.CATEGORY_IDS)) + " END"
_PCT = "coalesce(floor(sum(score)::DOUBLE / nullif(sum(weight)::DOUBLE, 0) * 100 + 0.5), 0)::INT"
O["f01_category_scores"] = (
    f"{CHECKS} SELECT doc_id, {_ORD} AS ord, category AS id, sum(score)::INT AS score, sum(weight)::INT AS weight, {_PCT} AS pct FROM checks GROUP BY doc_id, category"
)
O["f01_category_scores_long"] = (
    f"{CHECKS} SELECT doc_id, {_ORD} AS ord, category AS id, sum(score)::BIGINT AS score, sum(weight)::BIGINT AS weight, {_PCT} AS pct FROM checks GROUP BY doc_id, category"
)
O["f02_document_score"] = f"{CHECKS} SELECT doc_id, total_score, total_weight, score FROM scored"
O["f03_doc_facts_summary"] = (
    f"{FACTS} SELECT doc_id, word_count::INT AS word_count, char_count::INT AS char_count, len(bullets)::INT AS bullet_count, page_count, len(sections)::INT AS section_count FROM facts"
)
_TODO = "state IN ('fail', 'warn')"
O["f04_state_counts"] = (
    f"{CHECKS} SELECT doc_id, count(*)::INT AS n_all, (count(*) FILTER ({_TODO}))::INT AS n_todo, (count(*) FILTER (state = 'pass'))::INT AS n_pass FROM checks GROUP BY doc_id"
)
O["f05_passed_of_scored"] = (
    f"{CHECKS} SELECT doc_id, (count(*) FILTER (weight > 0 AND state = 'pass'))::INT AS n_pass, (count(*) FILTER (weight > 0))::INT AS n_scored FROM checks GROUP BY doc_id"
)
O["f06_todo_per_category"] = (
    f"{CHECKS} SELECT doc_id, category, count(*) FILTER ({_TODO}) AS n_todo, bool_or({_TODO}) AS is_open FROM checks GROUP BY doc_id, category"
)
O["f11_bullet_stats"] = (
    f"{FACTS}, n AS (SELECT doc_id, list_transform(bullets, lambda b: len(regexp_split_to_array(b, {lit(fs.WS + '+')}))) AS n FROM facts) "
    "SELECT doc_id, coalesce(floor(list_sum(n) / nullif(len(n), 0) + 0.5), 0)::INT AS avg_words, len(list_filter(n, lambda x: x > 34))::INT AS n_long, "
    "len(list_filter(n, lambda x: x < 6))::INT AS n_short FROM n"
)
O["f12_distinct_matches"] = (
    f"{DOCS} SELECT doc_id, array_to_string({fs.emails('text')}, ' | ') AS emails, array_to_string({fs.distinct(fs.all_of('text', lx.METRIC, True))}, ' | ') AS metrics, "
    f"array_to_string({fs.all_of('text', lx.DATE_RANGE, True)}, ' | ') AS ranges, array_to_string({fs.phones('text')}, ' | ') AS phones FROM docs"
)
for _how, _name in (("ROLLUP", "f13_corpus_rollup"), ("CUBE", "f13_corpus_cube")):
    O[_name] = (
        f"{CHECKS} SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(c.id) = 1 THEN '*' ELSE c.id END AS id, "
        "(grouping(lang) * 2 + grouping(c.id))::INT AS level, count(*) AS n_checks, count(*) FILTER (state = 'pass') AS n_pass, "
        "count(*) FILTER (state = 'warn') AS n_warn, count(*) FILTER (state = 'fail') AS n_fail, sum(weight - score)::BIGINT AS points_lost "
        f"FROM checks c JOIN documents USING (doc_id) GROUP BY {_how}(lang, c.id)"
    )
O["e07_band_lookup"] = O["e07_band_range_join"] = f"{CHECKS} SELECT doc_id, score, {BAND} AS band_id FROM scored"
_GAIN = "(weight - score) * CASE WHEN state = 'fail' THEN 135 ELSE 100 END"
O["g01_top_actions"] = (
    f"{CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_GAIN} DESC, check_ord) AS rank FROM checks WHERE {_TODO}) "
    "SELECT doc_id, rank::INT AS rank, id, state, score, weight FROM r WHERE rank <= 5"
)
O["g06_repeated_openers"] = (
    f"{SIGNALS}, w AS (SELECT doc_id, unnest(list_transform(openers, lambda o, i: {{'w': o, 'p': i}})) AS o FROM signals), "
    "n AS (SELECT doc_id, o.w AS word, count(*) AS n, min(o.p) AS p FROM w GROUP BY ALL HAVING count(*) >= 3) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p))::INT AS rank, word, n::INT AS n FROM n"
)
O["g07_first_n_evidence"] = f"{DOCS} SELECT doc_id, array_to_string({fs.distinct(fs.all_of('text', lx.METRIC, True))}[1:4], ' | ') AS first4 FROM docs"
O["g08_first_section"] = (
    f"{FACTS}, s AS (SELECT doc_id, list_filter(sections, lambda s: s.key = 'skills')[1] AS s FROM facts) "
    "SELECT doc_id, s.line_index::INT AS line_index, len(s.body)::INT AS n_body FROM s"
)
O["g10_filter_checks"] = f"{CHECKS} " + " UNION ALL ".join(
    f"SELECT doc_id, '{view}' AS view, category, count(*) AS n_visible FROM checks WHERE {test} GROUP BY doc_id, category"
    for view, test in (("all", "true"), ("todo", _TODO), ("pass", "state = 'pass'"))
)
O["k07_tone"] = (
    f"{CHECKS} SELECT doc_id, category AS id, CASE WHEN {_PCT} >= 80 THEN 'good' WHEN {_PCT} >= 50 THEN 'warn' ELSE 'bad' END AS tone FROM checks GROUP BY doc_id, category"
)
O["k02_excerpt"] = f"SELECT doc_id, {fs.excerpt('text', 90)} AS short, {fs.excerpt('text', 44)} AS shorter FROM documents"
_f = "array_to_string(f[1:len(f) - 1], ', ') || ' and ' || f[len(f)]"
O["k03_list_phrase"] = (
    f"WITH p AS (SELECT doc_id, {fs.phrases('lower(text)', PSEUDO)} AS f FROM documents) SELECT doc_id, CASE WHEN len(f) = 0 THEN '' "
    f"WHEN len(f) > 3 THEN array_to_string(f[1:3], ', ') || ' and ' || (len(f) - 3)::VARCHAR || ' more' WHEN len(f) = 1 THEN f[1] ELSE {_f} END AS phrase, "
    "len(f)::VARCHAR || CASE WHEN len(f) = 1 THEN ' term' ELSE ' terms' END AS counted FROM p"
)
O["k05_thousands"] = "SELECT doc_id, format('{:,}', length(text)) AS n FROM documents"
O["k08_state_marks"] = (
    f"{CHECKS} SELECT doc_id, id, CASE state WHEN 'pass' THEN '[x]' WHEN 'warn' THEN '[!]' WHEN 'fail' THEN '[ ]' ELSE '[-]' END AS mark, "
    "CASE state WHEN 'pass' THEN 'fine' WHEN 'warn' THEN 'could be better' WHEN 'fail' THEN 'to fix' ELSE 'not judged' END AS words FROM checks"
)
ORACLES = O
