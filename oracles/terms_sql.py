"""SQL for mining and matching."""

from __future__ import annotations

from docassay import lexicon as lx
from docassay.catalog_terms import SKILLS, STOP, TAILS
from oracles import facts_sql as fs
from oracles.facts_sql import DOCS, SIGNALS, case, lit

O: dict[str, str] = {}


def among(x: str, values) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


POSTS = (
    f"posts AS (SELECT item_id AS posting_id, text || chr(10) || {case('item_id % 4', TAILS)} AS text FROM benchmark "
    f"WHERE length({fs.trim('text || chr(10) || ' + case('item_id % 4', TAILS))}) >= 120)"
)
LONG = f"posts AS (SELECT doc_id AS posting_id, text FROM documents WHERE length({fs.trim('text')}) >= 120)"
_USE = (
    f"length(token) >= 3 AND NOT {among('token', STOP)} AND NOT regexp_matches(token, '^[0-9]+$') "
    f"AND (NOT regexp_matches(token, '^[0-9]') OR {among('token', SKILLS)})"
)
MINE = f"""
tl AS (SELECT posting_id, {fs.tokens('text')} AS t FROM posts),
tr AS (SELECT posting_id, unnest(list_transform(t, lambda x, i: {{'pos': i - 1, 'token': x}})) AS r FROM tl),
toks AS (SELECT posting_id, r.pos::INT AS pos, r.token AS token FROM tr),
good AS (SELECT * FROM toks WHERE {_USE}),
words AS (SELECT posting_id, token AS term, count(*) AS cnt FROM good GROUP BY ALL),
nxt AS (SELECT posting_id, pos, token AS a, lead(token) OVER (PARTITION BY posting_id ORDER BY pos) AS b FROM toks),
grams AS (SELECT posting_id, (row_number() OVER (PARTITION BY posting_id ORDER BY pos) - 1)::INT AS pos, a || ' ' || b AS term FROM nxt
  WHERE b IS NOT NULL AND length(a) >= 3 AND length(b) >= 3 AND NOT {among('a', STOP)} AND NOT {among('b', STOP)}),
gram_counts AS (SELECT posting_id, term, count(*) AS cnt FROM grams GROUP BY ALL),
phrases AS (SELECT * FROM gram_counts WHERE cnt >= 2 OR {among('term', lx.BIGRAM_ALLOWLIST)}),
parts AS (SELECT DISTINCT posting_id, unnest(string_split(term, ' ')) AS term FROM phrases),
left_words AS (SELECT w.* FROM words w WHERE {among('w.term', SKILLS)} OR NOT EXISTS (SELECT 1 FROM parts p WHERE p.posting_id = w.posting_id AND p.term = w.term)),
spaced AS (SELECT posting_id, unnest({fs.phrases('lower(text)', [s for s in SKILLS if ' ' in s])}) AS term FROM posts),
cands AS (SELECT * FROM left_words UNION ALL SELECT * FROM phrases UNION ALL
  SELECT posting_id, term, 1 AS cnt FROM spaced s WHERE NOT EXISTS (SELECT 1 FROM phrases p WHERE p.posting_id = s.posting_id AND p.term = s.term))"""


def ranked(source: str) -> str:
    return (
        f"SELECT posting_id, term, cnt, {among('term', SKILLS)} AS is_skill, row_number() OVER (PARTITION BY posting_id "
        f"ORDER BY {among('term', SKILLS)} DESC, cnt DESC, translate(term, ' -./#+', '!\"#$%&')) AS rank FROM {source}"
    )


TERMS = f"{MINE}, terms AS (SELECT posting_id, rank::INT AS rank, term, cnt, is_skill FROM ({ranked('cands')}) WHERE rank <= 28)"
ON_POSTS, ON_ALL = f"WITH {POSTS}, {MINE}", f"WITH posts AS (SELECT doc_id AS posting_id, text FROM documents), {MINE}"

O["e03_stopword_filter"] = f"{ON_POSTS} SELECT posting_id, pos, token FROM toks WHERE NOT {among('token', STOP)}"
O["e04_drop_phrase_parts"] = f"{ON_POSTS} SELECT posting_id, term, cnt FROM left_words"
O["f07_term_counts"] = f"{ON_ALL} SELECT posting_id, token AS term, count(*) AS cnt FROM toks GROUP BY ALL"
O["f08_bigram_counts"] = f"{ON_ALL} SELECT posting_id, term, cnt FROM gram_counts"
O["g02_top_terms"] = (
    f"{ON_POSTS}, u AS (SELECT * FROM words UNION ALL SELECT * FROM phrases) "
    f"SELECT posting_id, rank::INT AS rank, term, cnt, is_skill FROM ({ranked('u')}) WHERE rank <= 28"
)
O["g03_bigrams"] = f"{ON_POSTS} SELECT posting_id, pos, term FROM grams"
O["i01_useful_tokens"] = f"{ON_POSTS} SELECT posting_id, pos, token FROM good"
O["i02_keep_bigrams"] = f"{ON_POSTS} SELECT posting_id, term, cnt FROM phrases"
O["i03_multiword_skills"] = f"{ON_POSTS} SELECT posting_id, term FROM spaced"
_TERM_ROW = "SELECT posting_id, rank, term, cnt::INT AS cnt, is_skill FROM terms"
O["i04_posting_terms"] = f"WITH {POSTS}, {TERMS} {_TERM_ROW}"
O["i04_posting_terms_prose"] = f"WITH {LONG}, {TERMS} {_TERM_ROW}"

_STEP = "greatest(1, (SELECT count(*) FROM benchmark) // 5)"
MATCH = f"""{DOCS}, {POSTS}, {TERMS},
pairs AS (SELECT doc_id, (doc_id * 7 + i * {_STEP}) % (SELECT count(*) FROM benchmark) AS posting_id FROM docs, range(0, 5) r(i)),
lows AS (SELECT doc_id, lower(text) AS lower FROM docs),
matches AS (SELECT p.doc_id, p.posting_id, t.rank, t.term, t.cnt::INT AS cnt, t.is_skill,
  regexp_matches(l.lower, '(^|[^a-z0-9+#.])' || regexp_escape(t.term) || '($|[^a-z0-9+#])') AS matched
  FROM pairs p JOIN terms t USING (posting_id) JOIN lows l ON l.doc_id = p.doc_id),
found AS (SELECT doc_id, posting_id, count(*)::INT AS n_terms, (count(*) FILTER (matched))::INT AS n_matched,
  coalesce(floor((count(*) FILTER (matched))::DOUBLE / nullif(count(*)::DOUBLE, 0) * 100 + 0.5), 0)::INT AS coverage,
  coalesce(floor((count(*) FILTER (matched AND is_skill))::DOUBLE / nullif((count(*) FILTER (is_skill))::DOUBLE, 0) * 100 + 0.5), 0)::INT AS skill_coverage,
  coalesce(string_agg(term, ', ' ORDER BY rank) FILTER (matched), '') AS matched,
  coalesce(string_agg(term, ', ' ORDER BY rank) FILTER (NOT matched), '') AS missing FROM matches GROUP BY doc_id, posting_id),
report AS (SELECT doc_id, posting_id, coalesce(n_terms, 0) AS n_terms, n_terms IS NOT NULL AS compared, coalesce(n_matched, 0) AS n_matched,
  coalesce(coverage, 0) AS coverage, coalesce(skill_coverage, 0) AS skill_coverage, coalesce(matched, '') AS matched, coalesce(missing, '') AS missing
  FROM pairs LEFT JOIN found USING (doc_id, posting_id))"""
O["e05_match_postings"] = O["e05_match_naive"] = (
    f"{MATCH} SELECT doc_id, posting_id, rank, term, cnt, is_skill, matched FROM matches"
)
O["i05_term_matches"] = f"{MATCH} SELECT doc_id, posting_id, term FROM matches WHERE matched"
O["i06_match_report"] = f"{MATCH} SELECT * FROM report"
O["f09_coverage"] = f"{MATCH} SELECT doc_id, posting_id, coverage, skill_coverage FROM report"
O["f10_match_status"] = f"{MATCH} SELECT doc_id, posting_id, CASE WHEN compared THEN n_matched::VARCHAR || ' of ' || n_terms::VARCHAR ELSE 'not compared' END AS status FROM report"
O["a10_missing_terms_text"] = f"{MATCH} SELECT doc_id, posting_id, missing FROM report"
O["e01_dict_match"] = (
    f"{DOCS}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']{{4,}}')) AS token FROM docs), "
    f"d(token, usual) AS (VALUES {', '.join(f'({lit(k)}, {lit(v)})' for k, v in lx.TYPOS.items())}) "
    "SELECT doc_id, token, usual FROM w JOIN d USING (token)"
)
O["e02_dict_scan"] = (
    f"{DOCS}, l AS (SELECT doc_id, lower(text) AS lower FROM docs) SELECT doc_id, unnest({fs.terms('lower', lx.all_skills())}) AS term FROM l"
)
O["e02_phrase_scan"] = (
    "WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark), "
    "p AS (SELECT array_to_string(w[i : i + 2], ' ') AS phrase FROM w, range(1, 7) r(i) "
    f"UNION SELECT unnest([{', '.join(lit(t) for t in lx.all_skills())}])) "
    "SELECT d.doc_id, p.phrase FROM documents d JOIN p ON p.phrase <> '' AND contains(lower(d.text), p.phrase)"
)
O["e06_skills_demonstrated"] = (
    f"{SIGNALS}, u AS (SELECT doc_id, in_evidence, unnest(listed) AS term FROM signals) "
    "SELECT doc_id, term, list_contains(in_evidence, term) AS shown FROM u"
)
ORACLES = O
