"""DuckDB SQL for documents, facts and signals. Written on its own, list by list."""

from __future__ import annotations

from docassay import corpora, lexicon as lx
from docassay.functions.patterns import RE2_WS, WS_CHARS, quote, re2

WS = RE2_WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rx(pattern: str, ci: bool = False) -> str:
    return lit(re2(pattern, ci))


def trim(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def distinct(x: str) -> str:
    """Distinct values in order of appearance."""
    return f"list_filter({x}, lambda v, vi: list_position({x}, v) = vi)"


def case(col: str, values: list) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else lit(v)}" for i, v in enumerate(values)
    )
    return f"CASE {col} {whens} END"


def normalise(x: str) -> str:
    for a, b in [("chr(13) || chr(10)", "chr(10)"), ("chr(13)", "chr(10)")]:
        x = f"replace({x}, {a}, {b})"
    for points, instead in [
        ((160, 8199, 8239), " "), ((8216, 8217, 8219, 8242), "'"), ((8220, 8221, 8223, 8243), '"'),
        ((8208, 8209), "-"), ((8230,), "..."), ((64257,), "fi"), ((64258,), "fl"), ((9,), "    "),
    ]:
        for p in points:
            x = f"replace({x}, chr({p}), {lit(instead)})"
    x = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    no_lf = WS.replace("\t-\r", "\t\x0b-\r")
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda ln: regexp_replace(ln, {lit(no_lf + '+$')}, '')), chr(10))"
    return trim(x)


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda w: w <> '')"


def is_bullet(x: str) -> str:
    return f"regexp_matches({x}, {rx(BULLET)})"


BULLET = rf"^\s*(?:[{lx.BULLET_MARKERS}]|\d{{1,2}}[.)])\s+"


def strip_bullet(x: str) -> str:
    return trim(f"regexp_replace({x}, {rx(BULLET)}, '')")


def char_count(x: str) -> str:
    return f"length(regexp_replace({x}, {lit(WS + '+')}, '', 'g'))"


def excerpt(x: str, n: int) -> str:
    clean = trim(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")
    cut = f"left({clean}, {n})"
    blank = f"length({cut}) - position(' ' in reverse({cut}))"
    return (
        f"CASE WHEN length({clean}) <= {n} THEN {clean} ELSE left({cut}, "
        f"CASE WHEN position(' ' in {cut}) > 0 AND {blank} > 40 THEN {blank} ELSE {n} END) || '…' END"
    )


def tokens(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({x}), "
        f"{lit('[^a-z0-9+#./' + WS[1:-1] + '-]')}, ' ', 'g'), {lit(WS + '+')}), lambda t: trim(t, '-.')), lambda t: t <> '')"
    )


def phrases(x: str, values) -> str:
    return f"list_filter({lits(values)}, lambda p: contains({x}, p))"


def term_hit(x: str, term: str) -> str:
    return f"regexp_matches({x}, {lit('(^|[^a-z0-9+#.])' + quote(term) + '($|[^a-z0-9+#])')})"


def terms(x: str, values) -> str:
    cases = ", ".join(f"CASE WHEN {term_hit(x, t)} THEN {lit(t)} END" for t in values)
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def all_of(x: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_extract_all({x}, {rx(pattern, ci)})"


def urls(x: str) -> str:
    return distinct(all_of(x, r"https?://[^\s)<>" + "\"']+", True))


def emails(x: str) -> str:
    return distinct(all_of(x, lx.EMAIL))


def phones(x: str) -> str:
    return (
        f"list_filter({all_of(x, lx.PHONE)}, "
        "lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 14)"
    )


def heading_key(line: str) -> str:
    bare = (
        f"lower(regexp_replace(regexp_replace({line}, '^[^A-Za-z0-9]+', ''), "
        f"{rx('[' + chr(92) + 's:_–—=|-]+$')}, ''))"
    )
    keys = " ".join(
        f"WHEN regexp_matches({bare}, {rx(p)}) THEN {lit(k)}" for k, _, _, p in lx.SECTION_HEADINGS
    )
    return (
        f"CASE WHEN length({line}) NOT BETWEEN 1 AND 60 OR regexp_matches({line}, '[.!?,;]$') "
        f"OR {is_bullet(line)} OR len(regexp_split_to_array({bare}, {lit(WS + '+')})) > 5 THEN NULL {keys} END"
    )


def first_word(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, {lit('^[^' + WS[1:-1] + ']*')}, 0)), '[^a-z]', '', 'g')"


# ---------------------------------------------------------------------------
# Common table expressions
# ---------------------------------------------------------------------------

def _structured() -> str:
    nine = "array_to_string(words[9 * i + 1 : 9 * i + 9], ' ')"
    nl = "chr(10)"
    item = (
        f"'- ' || {case('(i + doc_id) % 6', corpora.VERBS)} || ' ' || {nine} || "
        "CASE (i + doc_id) % 4 WHEN 0 THEN ' by ' || (i + 5)::VARCHAR || '%' "
        "WHEN 1 THEN ' for ' || (3 * i)::VARCHAR || ' users' ELSE '' END"
    )
    text = f"CASE doc_id % 3 WHEN 0 THEN {item} WHEN 1 THEN '• Responsible for ' || {nine} ELSE {nine} END"
    tools = (
        "'Python, React, Docker' || CASE WHEN doc_id % 7 < 3 THEN ', Node.js, PostgreSQL, Git, C++, CI/CD, Google Cloud, team player' "
        "WHEN doc_id % 7 = 4 THEN ', MS Office, punctuality' ELSE '' END || "
        "CASE WHEN doc_id % 2 = 0 THEN ' (Jan 2020 - Mar 2022)' ELSE ' 2021' END"
    )
    line = (
        f"CASE WHEN i % 6 = 0 THEN {nl} || {case('(i // 6 + doc_id) % 8', corpora.HEADINGS)} || {nl} || {text} "
        f"WHEN i % 6 = 1 AND doc_id % 7 < 5 THEN {tools} || {nl} || {text} ELSE {text} END"
    )
    contact = (
        "CASE doc_id % 5 WHEN 0 THEN 'asha.rao' || doc_id::VARCHAR || '@example.com | +91 98765 43210' "
        "WHEN 1 THEN 'rockstar' || doc_id::VARCHAR || '@example.com' WHEN 2 THEN '+91 98765 43210 | Pune, India' "
        "WHEN 3 THEN 'https://linkedin.com/in/asha | github.com/asha' ELSE '' END"
    )
    return f"""
prose AS (SELECT doc_id, {words('text')} AS words FROM documents),
raw AS (SELECT doc_id, {case('doc_id % 4', corpora.FIRST_LINES)} || {nl} || {contact} || {nl} ||
  {case('doc_id % 11', corpora.EXTRA_LINES)} || {nl} ||
  array_to_string(list_transform(range(0, (len(words) + 8) // 9), lambda i: {line}), {nl}) AS raw FROM prose),
cleaned AS (SELECT doc_id, {normalise('raw')} AS text FROM raw),
docs AS (SELECT doc_id, text,
  {case('doc_id % 3', corpora.KINDS)} AS source_kind, {case('doc_id % 4', corpora.FILES)} AS file_name,
  (doc_id % 3 + 1)::INT AS page_count, {urls('text')} AS hyperlinks, {char_count('text')} AS text_density,
  CASE WHEN doc_id % 20 = 0 THEN 1 ELSE 0 END AS blank_pages, doc_id % 10 = 0 AS multi_column,
  (doc_id % 9) / 10.0 AS right_column_ratio, doc_id % 13 = 0 AS broken_glyphs, doc_id % 8 AS tabular_rows,
  (doc_id % 6) * 20 AS text_box_chars, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS image_count,
  doc_id % 12 = 0 AS contact_in_header_only FROM cleaned)"""


def _facts() -> str:
    return f"""
f0 AS (SELECT *, lower(text) AS lower, string_split(text, chr(10)) AS lines,
  len({words('text')}) AS word_count, {char_count('text')} AS char_count FROM docs),
f1 AS (SELECT *, list_transform(lines, lambda ln: {trim('ln')}) AS trimmed FROM f0),
f2 AS (SELECT *, list_filter(trimmed, lambda ln: ln <> '') AS nonblank,
  list_filter(list_transform(list_filter(trimmed, lambda ln: {is_bullet('ln')}), lambda ln: {strip_bullet('ln')}), lambda ln: length(ln) > 10) AS bullets,
  array_to_string(list_filter(lines, lambda ln: {trim('ln')} <> '')[1:6], chr(10)) AS header,
  list_filter(list_transform(trimmed, lambda ln, li: {{'key': {heading_key('ln')}, 'heading': ln, 'pos': li - 1}}), lambda h: h.key IS NOT NULL) AS headings FROM f1),
facts AS (SELECT *, list_transform(headings, lambda h, hi: {{'key': h.key, 'heading': h.heading, 'line_index': h.pos,
  'body': list_filter(trimmed[h.pos + 2 : coalesce(headings[hi + 1].pos, len(trimmed))], lambda ln: ln <> '')}}) AS sections,
  list_transform(headings, lambda h: h.key) AS keys FROM f2)"""


def _signals() -> str:
    skills = lx.all_skills()
    verbs = ", ".join(lit(v) for v in lx.ACTION_VERBS)
    city = r"\b(?:" + "|".join(lx.CITIES) + r")\b"
    return f"""
s0 AS (SELECT *, {emails('text')} AS emails, {phones('text')} AS phones,
  text || chr(10) || array_to_string(hyperlinks, chr(10)) AS searchable,
  list_filter(list_transform(sections, lambda s: CASE WHEN s.key IN ('projects', 'experience') THEN s.body END), lambda b: b IS NOT NULL) AS evidence_bodies,
  list_filter(sections, lambda s: s.key = 'skills')[1] AS skills_section,
  coalesce(nonblank[1], '') AS first_line, {all_of('text', lx.DATE_RANGE, True)} AS ranges,
  {distinct(all_of('text', lx.METRIC, True))} AS metrics,
  {phrases('lower', lx.FILLER_PHRASES)} AS filler, {phrases('lower', lx.WEAK_OPENERS)} AS weak_openers,
  {phrases('lower', lx.SOFT_SKILLS)} AS soft, {phrases('lower', lx.PERSONAL_DETAILS)} AS personal,
  {distinct("list_filter(regexp_extract_all(lower, '[a-z'']{4,}'), lambda w: list_contains(" + lits(lx.TYPOS) + ", w))")} AS typos,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(text, {rx(chr(92) + 'b' + p + chr(92) + 'b', True)}) THEN regexp_extract(text, {rx(chr(92) + 'b' + p + chr(92) + 'b', True)}, 0) || {lit(' → ' + r)} END" for p, r in lx.BRAND_SLIPS)}], lambda n: n IS NOT NULL) AS slips,
  len(list_filter(trimmed, lambda ln: length(ln) >= 25 AND NOT regexp_matches(ln, '[a-z]') AND length(regexp_replace(ln, '[^A-Za-z]', '', 'g')) >= 15)) AS shouting,
  len({all_of('text', lx.PRONOUN, True)}) AS pronouns, len({all_of('text', lx.YEAR)}) AS years,
  list_filter(bullets, lambda b: {first_word('b')} IN ({verbs})) AS strong,
  list_filter(bullets, lambda b: regexp_matches(b, {rx(lx.DUTY_OPENER, True)})) AS duties,
  list_transform(bullets, lambda b: len(regexp_split_to_array(b, {lit(WS + '+')}))) AS bullet_words,
  list_filter(list_transform(bullets, lambda b: {first_word('b')}), lambda w: w <> '') AS openers,
  (regexp_matches(header, {rx(lx.EMAIL)}) OR regexp_matches(header, {rx(lx.PHONE)})) AS header_contact,
  (regexp_matches(header, {rx(city, True)}) OR regexp_matches(header, {rx(lx.PLACE_PAIR)})) AS location,
  regexp_matches(text, '(?i)https?://') AS full_url,
  {terms('lower', skills)} AS found FROM facts),
s1 AS (SELECT *, lower(string_split(emails[1], '@')[1]) AS email_local,
  list_filter([{', '.join(self_link(k) for k in lx.LINK_PATTERNS)}], lambda k: k IS NOT NULL) AS links,
  lower(array_to_string(flatten(evidence_bodies), chr(10))) AS evidence_text,
  len(list_filter(flatten(evidence_bodies), lambda ln: regexp_matches(ln, {rx(lx.DETAIL_BULLET)}))) AS detail,
  lower(array_to_string(skills_section.body, chr(10))) AS listed_text,
  list_filter([{', '.join(f"CASE WHEN list_has_any(found, {lits(g)}) THEN {lit(n)} END" for n, g in lx.SKILL_GROUPS.items())}], lambda g: g IS NOT NULL) AS skill_groups,
  list_min(list_filter([list_position(keys, 'projects'), list_position(keys, 'experience')], lambda p: p > 0)) AS first_evidence,
  list_min(list_filter([list_position(keys, 'personal'), list_position(keys, 'declaration')], lambda p: p > 0)) AS first_private,
  list_filter(list_distinct(openers), lambda w: len(list_filter(openers, lambda o: o = w)) >= 3) AS repeated,
  len(typos) + len(slips) AS mistakes FROM s0),
signals AS (SELECT *,
  list_filter(found, lambda t: list_contains({terms("coalesce(listed_text, '')", skills)}, t)) AS listed,
  {terms('evidence_text', skills)} AS in_evidence FROM s1)"""


def self_link(kind: str) -> str:
    p = rx(lx.LINK_PATTERNS[kind], True)
    if kind == "portfolio":
        first = f"regexp_extract(searchable, {p}, 0)"
        return f"CASE WHEN {first} <> '' AND NOT regexp_matches({first}, {rx(lx.MAIL_HOSTS, True)}) THEN 'portfolio' END"
    return f"CASE WHEN regexp_matches(searchable, {p}) THEN {lit(kind)} END"


DOCS = "WITH " + _structured()
FACTS = DOCS + "," + _facts()
SIGNALS = FACTS + "," + _signals()


def plain_docs(source: str) -> str:
    """Document CTEs for ``(doc_id, text)`` rows without any layout."""
    return f"""WITH cleaned AS (SELECT doc_id, {normalise('text')} AS text FROM ({source})),
docs AS (SELECT doc_id, text, 'text' AS source_kind, NULL::VARCHAR AS file_name,
  greatest(1, ceil(len(list_filter(string_split(text, chr(10)), lambda ln: {trim('ln')} <> '')) / 46.0))::INT AS page_count,
  {urls('text')} AS hyperlinks, {char_count('text')} AS text_density, 0 AS blank_pages, false AS multi_column,
  0.0 AS right_column_ratio, false AS broken_glyphs, 0 AS tabular_rows, 0 AS text_box_chars, 0 AS image_count,
  false AS contact_in_header_only FROM cleaned)"""
