"""SQL for positioned text and paragraph tables."""

from __future__ import annotations

from docassay import lexicon as lx
from oracles import facts_sql as fs
from oracles.facts_sql import lit, rx

O: dict[str, str] = {}

_X = (
    "60.0::DOUBLE + (ord % 10) * 50.0::DOUBLE + CASE WHEN doc_id % 4 = 0 AND ord % 10 >= 5 THEN 190.0 ELSE 0.0 END::DOUBLE "
    "+ CASE WHEN doc_id % 9 = 1 AND ord % 20 < 10 THEN 300.0 ELSE 0.0 END::DOUBLE"
)
LINES = f"""
wl AS (SELECT doc_id, {fs.words('text')} AS w FROM documents),
wr AS (SELECT doc_id, unnest(list_transform(w, lambda t, i: {{'ord': i - 1, 'text': t}})) AS r FROM wl),
w AS (SELECT doc_id, r.ord AS ord, r.text AS text FROM wr),
frags AS (SELECT doc_id, (ord // 300 + 1)::INT AS page, ord, {_X} AS x, ({_X}) + length(text) * 5.0::DOUBLE AS "right",
  800.0::DOUBLE - ((ord % 300) // 10) * 16.0::DOUBLE - (ord % 4) * 0.875::DOUBLE AS y, (ord % 3 + 10)::DOUBLE AS size, text FROM w),
ys AS (SELECT doc_id, page, list_sort(list_distinct(list(y)), 'DESC') AS ys FROM frags GROUP BY ALL),
anchors AS (SELECT doc_id, page, list_reduce(list_transform(ys, lambda y: [y]),
  lambda acc, v: CASE WHEN acc[len(acc)] - v[1] > 2.6 THEN list_append(acc, v[1]) ELSE acc END) AS anchors FROM ys),
placed AS (SELECT f.*, list_min(list_filter(a.anchors, lambda q: q >= f.y)) AS anchor FROM frags f JOIN anchors a USING (doc_id, page)),
gaps AS (SELECT *, x - lag("right") OVER win AS gap FROM placed WINDOW win AS (PARTITION BY doc_id, page, anchor ORDER BY x, -y, ord)),
cut AS (SELECT *, sum(CASE WHEN gap > 595.0 * 0.14 THEN 1 ELSE 0 END) OVER win AS k FROM gaps WINDOW win AS (PARTITION BY doc_id, page, anchor ORDER BY x, -y, ord)),
clusters AS (SELECT doc_id, page, anchor, k, min(x) AS x, max("right") AS "right", list(size) AS sizes,
  string_agg(CASE WHEN gap > 0.8 AND gap <= 595.0 * 0.14 THEN ' ' ELSE '' END || text, '' ORDER BY x, -y, ord) AS text,
  arg_min(y, (x, -y, ord)) AS y FROM cut GROUP BY ALL),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(text, {lit(fs.WS + '+')}), lambda t: regexp_matches(t, '[A-Za-z0-9]'))) AS words FROM clusters),
rows AS (SELECT doc_id, page, anchor, arg_min(y, k) AS y, min(x) AS x, max("right") AS "right", list_sort(flatten(list(sizes))) AS sizes,
  {fs.trim(f"regexp_replace(string_agg(text, '   ' ORDER BY k), {lit(fs.WS + '+')}, ' ', 'g')")} AS text,
  count(*) FILTER (words >= 3) AS wide, count(*) FILTER (words >= 1) AS filled FROM counted GROUP BY ALL),
doc_pages AS (SELECT doc_id, unnest(range(1, ((len(w) + 299) // 300 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT + 1))::INT AS page FROM wl),
chars AS (SELECT doc_id, page, sum({fs.char_count('text')}) AS chars FROM rows GROUP BY ALL),
thin AS (SELECT doc_id, list_sort(coalesce(list(page) FILTER (coalesce(chars, 0) < 120), [])) AS pages, count(*)::INT AS page_count
  FROM doc_pages LEFT JOIN chars USING (doc_id, page) GROUP BY doc_id)"""
W = "WITH " + LINES
O["c01_group_into_lines"] = f'{W} SELECT doc_id, page, anchor, y, x, "right" FROM rows'
O["c02_split_clusters"] = f'{W} SELECT doc_id, page, anchor, k::INT AS k, x, "right", words::INT AS words FROM counted'
O["c03_row_text"] = f"{W} SELECT doc_id, page, anchor, text, sizes[len(sizes) // 2 + 1] AS size FROM rows"
O["c04_split_rows"] = f"{W} SELECT doc_id, page, anchor FROM rows WHERE wide >= 2"
O["c05_tabular_rows"] = f"{W} SELECT doc_id, page, anchor FROM rows WHERE filled >= 3"
O["c06_right_starts"] = f"{W} SELECT doc_id, page, anchor, x FROM rows WHERE x > 595.0::DOUBLE * 0.55::DOUBLE"
O["c07_image_only_pages"] = f"{W} SELECT doc_id, array_to_string(pages, ',') AS pages, page_count FROM thin"

_BROKEN = (
    "({n} >= 200 AND (contains({t}, chr(65533)) OR length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))::DOUBLE / nullif({n}, 0) < 0.45))"
)


def broken(t: str) -> str:
    return _BROKEN.format(n=fs.char_count(t), t=t)


META = f"""{LINES},
agg AS (SELECT doc_id, count(*) AS n, count(*) FILTER (wide >= 2) AS split_rows, count(*) FILTER (filled >= 3) AS tabular,
  count(*) FILTER (x > 595.0::DOUBLE * 0.55::DOUBLE) AS rights, string_agg(text, chr(10) ORDER BY page, anchor DESC) AS raw FROM rows GROUP BY doc_id),
pt AS (SELECT t.doc_id, t.pages, t.page_count, coalesce(n, 0) AS n, coalesce(split_rows, 0) AS split_rows, coalesce(tabular, 0) AS tabular,
  coalesce(rights, 0) AS rights, coalesce({fs.normalise('raw')}, '') AS text FROM thin t LEFT JOIN agg USING (doc_id)),
pdf AS (SELECT doc_id, 'pdf' AS source_kind, page_count, text, {fs.char_count('text')} AS text_density, pages,
  coalesce(split_rows::DOUBLE / nullif(n, 0), 0) >= 0.2 AND split_rows >= 4 AS multi_column, coalesce(rights::DOUBLE / nullif(n, 0), 0)::DOUBLE AS ratio,
  coalesce({broken('text')}, false) AS broken, tabular, 0 AS boxes, len(pages) AS images, false AS header_only FROM pt)"""
_D, _O = "doc_id", "ord"
BLOCKS = f"""
bl AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'ord': i - 1, 'text': t}})) AS r FROM documents),
blocks AS (SELECT doc_id, r.ord AS ord, CASE WHEN r.ord % 2 = 0 THEN replace(r.text, '. ', '.' || chr(10)) ELSE r.text END AS text, r.ord % 3 = 1 AS is_list,
  (doc_id + r.ord) % 11 = 0 AS from_textbox, doc_id % 4 = 0 AND r.ord % 3 = 0 AS is_table_row FROM bl),
pieces AS (SELECT doc_id, ord, is_list, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'part': i - 1, 'text': {fs.trim('t')}}})) AS p FROM blocks),
blines AS (SELECT doc_id, ord, p.part AS part, is_list OR {fs.is_bullet('p.text')} AS bullet,
  CASE WHEN is_list AND NOT {fs.is_bullet('p.text')} THEN '• ' || p.text ELSE p.text END AS text FROM pieces WHERE p.text <> ''),
btext AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord, part) AS raw, count(*) AS n FROM blines GROUP BY doc_id),
bsum AS (SELECT doc_id, sum(CASE WHEN from_textbox THEN {fs.char_count('text')} ELSE 0 END) AS boxes, count(*) FILTER (is_table_row) AS trows FROM blocks GROUP BY doc_id),
bd AS (SELECT doc_id, boxes, trows, coalesce(n, 0) AS n, coalesce({fs.normalise('raw')}, '') AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'asha@example.com' ELSE 'page' END AS header_text FROM bsum LEFT JOIN btext USING (doc_id)),
docx AS (SELECT doc_id, 'docx' AS source_kind, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 4 END::INT AS page_count, text, {fs.char_count('text')} AS text_density, []::INT[] AS pages, trows > 0 AND trows >= n * 0.25 AS multi_column,
  0.0::DOUBLE AS ratio, false AS broken, trows AS tabular, boxes, doc_id % 3 AS images,
  regexp_matches(header_text, {rx(lx.CONTACT_ANY)}) AND NOT regexp_matches(text, {rx(lx.CONTACT_ANY)}) AS header_only FROM bd)"""
_OUT = (
    "SELECT doc_id, source_kind, page_count, md5(text) AS text_md5, text_density::BIGINT AS text_density, array_to_string(pages, ',') AS image_only_pages, "
    "multi_column, ratio AS right_column_ratio, broken AS broken_glyphs, tabular::BIGINT AS tabular_rows, boxes::BIGINT AS text_box_chars, "
    "images::BIGINT AS image_count, header_only AS contact_in_header_only FROM "
)
O["c08_layout_meta"] = f"WITH {META} {_OUT} pdf"
O["c12_block_meta"] = f"WITH {BLOCKS} {_OUT} docx"
O["c11_lines_from_blocks"] = f"WITH {BLOCKS} SELECT doc_id, ord::INT AS ord, part::INT AS part, text, bullet FROM blines"
_t = "CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[aeo]', '9', 'g') ELSE text END"
O["c09_broken_glyphs"] = f"WITH d AS (SELECT doc_id, {_t} AS t FROM documents) SELECT doc_id, {broken('t')} AS broken FROM d"
_WARN = (
    "array_to_string(list_filter([CASE WHEN len(pages) = 0 THEN NULL WHEN len(pages) = page_count THEN 'No text can be selected; this looks like a scan.' "
    "ELSE 'Hardly any text on page ' || array_to_string(pages, ', ') || '.' END, CASE WHEN boxes > 60 THEN 'Some text is inside boxes, which are often skipped.' END, "
    "CASE WHEN header_only THEN 'Contact details are only in the page header.' END], lambda m: m IS NOT NULL), ' | ') AS warnings"
)
O["c10_layout_warnings"] = (
    f"WITH {META}, {BLOCKS} SELECT doc_id, source_kind, {_WARN} FROM pdf UNION ALL SELECT doc_id, source_kind, {_WARN} FROM docx"
)
O["c13_merge_hyperlinks"] = (
    "WITH l AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS url FROM pages UNION ALL SELECT page_id, url FROM pages "
    "UNION ALL SELECT page_id, 'mailto:page' || page_id::VARCHAR || '@example.com' FROM pages), "
    "d AS (SELECT DISTINCT doc_id, url FROM l WHERE regexp_matches(url, '^(?i:https?://)|^mailto:')) "
    "SELECT doc_id, string_agg(url, ' ' ORDER BY url) AS hyperlinks FROM d GROUP BY doc_id"
)
ORACLES = O
