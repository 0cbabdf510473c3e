import random
import re

from pyspark.sql import functions as F

from docassay.functions.patterns import WS_CHARS
from docassay.operators import layout as ly
from docassay.operators.facts import text_documents
from docassay.plans.score import score_documents

SCHEMA = "doc_id string, page int, page_width double, ord int, x double, right double, y double, size double, text string"


def place(doc, lines, x=60.0, top=790.0, leading=16.0, start=0, page=1):
    return [
        (doc, page, 595.0, start + i, x, x + 5.0 * len(t), top - i * leading, 11.0, t) for i, t in enumerate(lines)
    ]


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, page int")


def test_rows_are_anchored_not_chained(spark):
    rows = [("a", 1, 595.0, i, 60.0 + i * 40, 80.0 + i * 40, y, 11.0, f"w{i}") for i, y in enumerate([10.0, 8.0, 6.0])]
    rows += [("b", 1, 595.0, i, 60.0 + i * 40, 80.0 + i * 40, y, 11.0, f"w{i}") for i, y in enumerate([100.0, 97.5, 97.25])]
    got = {(r.doc_id, r.text) for r in ly.group_into_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "w0 w1"), ("a", "w2"), ("b", "w0 w1"), ("b", "w2")}


def greedy(values, tol):
    starts = []
    for v in sorted(set(values), reverse=True):
        if not starts or starts[-1] - v > tol:
            starts.append(v)
    return {v: min(a for a in starts if a >= v) for v in values}


def test_groups_of_random_and_long_chains(spark):
    rng = random.Random(5)
    pages = {n: [rng.randrange(n * 3) / rng.choice([1, 2, 7]) for _ in range(n)] for n in (1, 2, 3, 7, 40, 257)}
    pages[5000] = [i * 0.7 for i in range(5000)]
    pages[5001] = [100.0] * 50
    rows = [(k, v) for k, vs in pages.items() for v in vs] + [(1, None), (None, 1.0), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = [(r.k, r.v, r.anchor) for r in ly.anchored_groups(df, ["k"], "v", 2.6).collect()]
    want = [(k, v, greedy(vs, 2.6)[v]) for k, vs in pages.items() if k < 300 for v in vs]
    assert sorted(g for g in got if g[0] < 300) == sorted(want)
    chain = greedy(pages[5000], 2.6)
    assert {(v, a) for k, v, a in got if k == 5000} == set(chain.items())
    assert [a for k, _, a in got if k == 5001] == [100.0] * 50 and len(got) == len(rows) - 3


def test_gap_threshold_and_words(spark):
    def row(doc, gap):
        return [(doc, 1, 595.0, 0, 60.0, 100.0, 10.0, 11.0, "one two three"), (doc, 1, 595.0, 1, 100.0 + gap, 200.0 + gap, 10.0, 11.0, "four five six")]

    lines = ly.row_flags(ly.group_into_lines(spark.createDataFrame(row("under", 83.0) + row("over", 84.0), SCHEMA)))
    got = {r.doc_id: (len(r.clusters), r.split_row) for r in lines.collect()}
    assert got == {"under": (1, False), "over": (2, True)}


def test_one_column_two_columns_and_no_text(spark):
    items = [f"- Built item number {i} for the reporting team, saving {i + 5} hours a week" for i in range(9)]
    single = place("single", ["Priya Rao", "priya.rao@example.com | +91 98765 43210 | Pune, India",
                              "https://linkedin.com/in/priya | https://github.com/priya", "SKILLS", "Python, Django, PostgreSQL, Git, Docker, AWS, Redis, SQL",
                              "PROJECTS", *items, "EXPERIENCE", "Intern, Acme (Jun 2025 - Aug 2025)", *items[:4],
                              "EDUCATION", "B.Tech, Lakeside College (2022 - 2026)"])
    left = place("double", [f"left side words {i}" for i in range(12)], leading=22.0)
    right = place("double", [f"right side words with more text {i}" for i in range(12)], x=300.0, leading=22.0, start=100)
    bare = place("none", ["CV"])
    frags = spark.createDataFrame(single + left + right + bare, SCHEMA)
    docs = ly.layout_documents(frags, pages_of(spark, ("single", 1), ("double", 1), ("none", 1), ("none", 2)))
    meta = {r.doc_id: r for r in docs.collect()}
    assert not meta["single"].meta.multi_column and meta["double"].meta.multi_column
    assert meta["none"].meta.image_only_pages == [1, 2] and meta["none"].page_count == 2
    scored = {r.doc_id: r for r in score_documents(text_documents(docs)).collect()}
    state = {d: {k.id: k.state for k in r.checks} for d, r in scored.items()}
    assert scored["single"].score >= 70 and scored["single"].bullet_count >= 6
    assert state["single"]["parse.order"] == "pass" and state["single"]["structure.name"] == "pass"
    assert state["double"]["parse.order"] == "fail" and state["none"]["parse.text"] == "fail"


def test_blocks(spark):
    blocks = spark.createDataFrame(
        [("d", 0, "Title\nsecond", False, False, False), ("d", 1, "an item", True, False, False), ("d", 2, "- marked", True, False, False),
         ("d", 3, "x" * 61, False, True, False), ("d", 4, "cell   cell", False, False, True), ("d", 5, "  ", False, False, False)],
        "doc_id string, ord int, text string, is_list boolean, from_textbox boolean, is_table_row boolean",
    )
    lines = [r.text for r in ly.lines_from_blocks(blocks).orderBy("ord", "part").collect()]
    assert lines == ["Title", "second", "• an item", "- marked", "x" * 61, "cell   cell"]
    headers = spark.createDataFrame([("d", "me@example.com", 2, 3)], "doc_id string, header_text string, media_count int, page_count int")
    row = ly.block_documents(blocks, headers).first()
    meta = row.meta
    assert row.page_count == 3
    assert (meta.text_box_chars, meta.tabular_rows, meta.image_count) == (61, 1, 2)
    assert meta.contact_in_header_only and not meta.multi_column


def test_links(spark):
    a = spark.createDataFrame([("d", "https://x.y"), ("d", "/local"), ("d", "HTTP://z")], "doc_id string, url string")
    b = spark.createDataFrame([("d", "mailto:a@b.c"), ("d", "https://x.y")], "doc_id string, url string")
    assert ly.merge_hyperlinks(a, b).first().hyperlinks == ["HTTP://z", "https://x.y", "mailto:a@b.c"]


def test_broken_glyphs(spark):
    rows = [("a" * 199 + "1",), ("1" * 120 + "a" * 80,), ("a" * 200 + "�",), ("1" * 199,)]
    got = [r.b for r in spark.createDataFrame(rows, "t string").select(ly.broken_glyphs(F.col("t")).alias("b")).collect()]
    assert got == [False, True, True, False]


def test_a_text_may_hold_any_character(spark):
    rows = [(1, 0, 600.0, 0, 10.0, 60.0, 700.0, 10.0, "a\x00b"), (1, 0, 600.0, 1, 300.0, 360.0, 700.0, 10.0, "c d"), (1, 0, 600.0, 2, 362.0, 380.0, 700.0, 10.0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, page int, page_width double, ord int, x double, right double, y double, size double, text string")
    line = ly.group_into_lines(df).first()
    assert [(k["x"], k["right"], k["words"]) for k in line["clusters"]] == [(10.0, 60.0, 1), (300.0, 380.0, 3)]
    assert line["text"] == "a\x00b c d e"


def test_row_filters_do_not_repeat_the_clusters(spark, sf):
    from docassay import catalog_layout as cl

    for run in (cl.c04_split_rows, cl.c05_tabular_rows, cl.c06_right_starts):
        plan = run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if " Filter " in line and "transform(" in line]


def test_words_are_counted_in_one_pass(spark):
    texts = ["", " ", "a", "-- a1 -", "é", "x y﻿z", "ab-cd (e) ... 1,000", " , b ,", "　é9é é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ly.count_words(F.col("t")).alias("n"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    spaces = "[" + re.escape(WS_CHARS) + "]+"
    assert {r.t: r.n for r in df.collect()} == {t: sum(bool(re.search("[A-Za-z0-9]", w)) for w in re.split(spaces, t)) for t in texts}


def test_rows_of_fragments_sort_by_their_type(spark):
    """Sizes that are null stand last; a row's fragments are sorted without a comparing lambda."""
    rows = [("d", 1, 595.0, i, 60.0 + 50 * i, 100.0 + 50 * i, 10.0, size, f"w{i}") for i, size in enumerate([None, 12.0, 11.0])]
    lines = ly.group_into_lines(spark.createDataFrame(rows, SCHEMA))
    assert [(r.text, r.size, r.right) for r in lines.collect()] == [("w0 w1 w2", 12.0, 200.0)]
    assert "lambda left" not in lines._jdf.queryExecution().optimizedPlan().toString()


def odd_fragments(n, seed=11):
    """Fragments out of order, with nulls, NaN, equal places and both zeros."""
    rng = random.Random(seed)
    nan, out = float("nan"), []
    for i in range(n):
        x = rng.choice([None, nan, 0.0, -0.0, *[float(v) for v in range(0, 500, 60)]])
        right = None if x is None or rng.random() < 0.1 else x + rng.choice([5.0, 30.0, 59.5, nan])
        y = rng.choice([None, nan, 0.0, -0.0, 2.5, 2.75, 5.25, 8.0, 100.0])
        text = rng.choice([None, "", "a1", "é", " b  c ", "-", "word　two", "x\x00y"])
        out.append((rng.choice(["a", "b", "ü", None]), rng.choice([1, 2, 3, None]), 595.0, rng.randrange(5), x, right, y, rng.choice([None, 9.0, 10.0, nan]), text))
    return out


def rows_by_hand(fragments, tol=2.6):
    """The contract of ``group_into_lines``, fragment by fragment."""
    def place(v):
        return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v + 0.0)

    def above(a, b):
        return a is not None and b is not None and place(a) > place(b)

    pages = {}
    for f in fragments:
        if f[0] is not None and f[1] is not None and f[6] is not None:
            pages.setdefault((f[0], f[1]), []).append(f)
    out = []
    for (doc, page), own in pages.items():
        rows, anchor = {}, None
        for y in sorted({place(f[6]) for f in own}, reverse=True):
            value = float("nan") if y[0] == 2 else y[1]
            if anchor is None or y != anchor[0] and not anchor[1] - value <= tol:
                anchor = (y, value)
            rows.setdefault(anchor[0], []).extend(f for f in own if place(f[6]) == y)
        for key, parts in rows.items():
            parts = sorted(parts, key=lambda f: (place(f[4]), place(-f[6]), f[3], place(f[5]), place(f[7]), f[8] is not None, (f[8] or "").encode()))
            pieces, clusters = [], []
            for i, f in enumerate(parts):
                before = parts[i - 1][5] if i else None
                gap = f[4] - before if i and f[4] is not None and before is not None else None
                wide = above(gap, 595.0 * 0.14)
                piece = "" if f[8] is None else (" " if wide or above(gap, 0.8) else "") + f[8]
                if not i or wide:
                    clusters.append([f[4], [], ""])
                clusters[-1][1].append(f[5])
                clusters[-1][2] += piece
                pieces.append(piece)
            most = lambda vs: max([v for v in vs if v is not None], key=place, default=None)
            spaces = "[" + re.escape(WS_CHARS) + "]+"
            sizes = sorted((f[7] for f in parts if f[7] is not None), key=place)
            words = lambda t: sum(bool(re.search("[A-Za-z0-9]", w)) for w in re.split(spaces, t))
            out.append((
                doc, page, key, place(parts[0][4]), place(most([f[5] for f in parts])),
                place(sizes[len(parts) // 2] if len(parts) // 2 < len(sizes) else None),
                re.sub(spaces, " ", "".join(pieces)).strip(WS_CHARS), [(place(k[0]), place(most(k[1])), words(k[2])) for k in clusters],
            ))
    return out, place


def test_odd_fragments_as_by_hand(spark):
    fragments = odd_fragments(4000)
    want, place = rows_by_hand(fragments)
    got = ly.group_into_lines(spark.createDataFrame(fragments, SCHEMA).repartition(3)).collect()
    lines = [
        (r.doc_id, r.page, place(r.anchor), place(r.x), place(r.right), place(r["size"]), r.text, [(place(k.x), place(k.right), k.words) for k in r.clusters])
        for r in got
    ]
    assert sorted(lines) == sorted(want)


def test_fragments_move_once_as_blocks(spark):
    """The only exchange moves blocks of pages; pages listed twice, or never, count as often."""
    frags = spark.createDataFrame(place("a", ["one two", "three"]) + place("a", ["x" * 130], page=2) + place("b", ["not listed"]), SCHEMA)
    docs = ly.layout_documents(frags, pages_of(spark, ("a", 1), ("a", 2), ("a", 2), ("c", 7)))
    plan = docs._jdf.queryExecution().sparkPlan().toString() + docs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("AdaptiveSparkPlan")[-1].count("Exchange hashpartitioning") == 1
    got = {r.doc_id: (r.page_count, r.text, r.meta.image_only_pages) for r in docs.collect()}
    assert got == {"a": (3, "one two\nthree\n" + "\n".join(["x" * 130] * 2), [1]), "c": (1, "", [7])}
    moved = ly.group_into_lines(frags)._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange hashpartitioning") == 1 and "block" in [x for x in moved.split("\n") if "MapInArrow pack" in x][0]


def test_a_page_in_many_blocks(monkeypatch):
    import pyarrow as pa
    from docassay.operators import placing

    fragments = [f for f in odd_fragments(900, 5) if None not in (f[0], f[1], f[6])]
    names = ["doc_id", "page", "page_width", "ord", "x", "right", "y", "size", "text"]
    table = pa.table({k: pa.array([f[names.index(k)] for f in fragments]) for k in ("doc_id", "page", "ord", "text")})
    numbers = [[f[names.index(k)] for k in placing.NUMBERS] for f in fragments]
    table = table.append_column("numbers", pa.array(numbers, pa.list_(pa.float64())))

    def rows(at_once):
        monkeypatch.setattr(placing, "AT_ONCE", at_once)
        packed = pa.Table.from_batches(placing.pack(iter(table.to_batches(max_chunksize=70)))).to_pandas()
        met = packed.groupby(["doc_id", "page"])["block"].agg(list).reset_index()
        batch = pa.RecordBatch.from_arrays([pa.array(met.doc_id), pa.array(met.page), pa.array(met.block.tolist(), pa.list_(pa.binary()))], ["doc_id", "page", "blocks"])
        return len(packed), repr([r for b in placing.rows_of_pages(iter([batch]), 2.6, 0.14, 0.8) for r in b.to_pylist()])

    (few, whole), (many, parts) = rows(10**6), rows(100)
    assert many > few and whole == parts


def test_rows_of_a_table_take_one_exchange(spark, sf):
    from docassay import catalog_layout as cl

    for run in (cl.c05_tabular_rows, cl.c08_layout_meta):
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_table_in_many_splits_is_not_moved(spark, tmp_path):
    from docassay.sources.corpus import read_corpus

    spark.range(60).selectExpr("id AS doc_id", "'a' AS text").repartition(6).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        for wanted, moved in ((6, False), (7, True)):
            plan = read_corpus(spark, f"{tmp_path}/t", partitions=wanted)._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange" in plan) == moved
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
