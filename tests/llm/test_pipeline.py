"""The corpus pipeline against a brute-force version, and its stages on awkward tables."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from docassay.llm import langid
from docassay.llm.common import first_by_hash
from docassay.llm.decontam import contaminated

WEIGHTS = (5, 2, 1)


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n)]


def text(seed, n=60):
    w = words(seed, n)
    return "\n".join(" ".join(w[i : i + 12]) for i in range(0, n, 12))


def benchmark():
    return [(1, " ".join(words(900, 40))), (2, "the"), (3, None), (4, "yes it is")]


def corpus():
    rows = []
    for i in range(40):
        rows.append([i, text(i), "en" if i % 2 else "de", "abc"[i % 3]])
    shared = "this very line is shared by several documents of the corpus"
    for i in (3, 9, 17, 31):
        rows[i][1] += "\n" + shared
    base = words(500, 120)
    for k, i in enumerate((40, 41, 42)):  # near copies of one text: one word each differs
        changed = list(base)
        changed[50 + k] = "zz"
        rows.append([i, " ".join(changed), "en", "a"])
    rows.append([43, "before it " + benchmark()[0][1] + " behind it", "en", "b"])
    rows.append([44, "a text in which the item the is quoted " + text(44), None, "b"])
    rows.append([45, text(45) + "\nYes, it is!", "en", "c"])
    rows += [[46, None, "en", "a"], [47, "", "de", "a"], [48, "123 --- 456", "en", None], [49, text(49), "en", None]]
    return [tuple(r) for r in rows]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def leaks(t, items):
    for item in items:
        one = re.findall(r"[a-z0-9]+", (item or "").lower())
        if not one:
            continue
        if len(one) < 5:
            if any(re.findall(r"[a-z0-9]+", line.lower()) == one for line in t.split("\n")):
                return True
            continue
        two, n = re.findall(r"[a-z0-9]+", t.lower()), min(13, len(one))
        for i in range(len(one) - n + 1):
            for j in range(len(two) - n + 1):
                if sum(a == b for a, b in zip(one[i : i + n], two[j : j + n])) >= n - n // 6:
                    return True
    return False


def brute(rows, items):
    rows = [list(r) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    seen = {}
    for doc, t, *_ in rows:
        for line in set(x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")):
            seen.setdefault(line, []).append(doc)
    for r in rows:
        lines = r[1].split("\n")
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        r[1] = "\n".join(x for x in lines if len(key(x)) < 10 or min(seen[key(x)]) == r[0])
    part = {r[0]: r[0] for r in rows}
    sets = {r[0]: shingles(r[1]) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    rows = [r for r in rows if part[r[0]] == r[0]]
    rows = [r for r in rows if not leaks(r[1], items)]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 2 * total[s]]
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else unit * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    out = set()
    for s in names:
        sure = int(target[s] // total[s])
        rest, before = target[s] - sure * total[s], 0
        own = [r[0] for r in rows if r[3] == s]
        for doc in sorted(own, key=lambda d: int(hashlib.md5(f"{d}:mix".encode()).hexdigest()[:13], 16)):
            n = sure + (2 * before + size[doc] < 2 * rest)
            before += size[doc]
            if n:
                out.add((doc, s, n, n * size[doc]))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(benchmark(), "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def test_pipeline_against_brute_force(spark, folder):
    got = {(r["doc_id"], r["source"], r["copies"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect()}
    want = brute(corpus(), [t for _, t in benchmark()])
    assert got == want
    assert {44, 49} & {r[0] for r in got} and not {41, 42, 43, 45, 46, 47, 48} & {r[0] for r in got}


CLASHING = ("score", "kept", "lang_pred", "n_lines", "n_dropped", "kept_sha256", "_p", "_h", "class_id", "rest", "other", "again", "leak", "one", "a.b", "size")


@pytest.mark.parametrize("number", range(4))
def test_stages_leave_other_columns_alone(spark, folder, number):
    names = ["doc_id", "text", "lang", "source", *CLASHING]
    rows = [(*r, *(f"{c}-{r[0]}" for c in CLASHING)) for r in corpus()] + [(None, "a row that has no id at all", "en", "a", *CLASHING)]
    kinds = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, kinds)
    out = corpus_pipeline.STAGES[number][1](spark, docs, folder)
    assert out.columns == names
    got = out.collect()
    assert got and all(r[c] == (c if r["doc_id"] is None else f"{c}-{r['doc_id']}") for r in got for c in CLASHING)
    assert any(r["doc_id"] is None for r in got)
    assert corpus_pipeline.STAGES[number][1](spark, docs.limit(0), folder).count() == 0


def test_mixing_stage_with_clashing_columns_and_no_rows(spark, folder):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 7, 8)], "doc_id long, text string, lang string, source string, size long, u long")
    assert [(r["doc_id"], r["size"]) for r in corpus_pipeline.mixed(spark, docs, folder).collect()] == [(1, 2)]
    assert corpus_pipeline.mixed(spark, docs.limit(0), folder).count() == 0


def test_without_any_language_nothing_is_rejected(spark, folder):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.known_language(spark, docs, folder).count() == 2


def test_one_row_of_each_id_stays(spark, folder):
    rows = [(1, text(1), 1), (1, text(1), 1), (1, None, 2), (2, None, 3), (2, "", 4), (3, text(3), 5), (None, "x", 6), (None, "x", 6)]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, n long"), folder)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text(1), 1), (2, "", 4), (3, text(3), 5), (None, "x", 6), (None, "x", 6)], key=str)


def test_first_by_hash_is_exact_and_skips_nulls(spark):
    rows = [(i, "big") for i in range(3000)] + [(i, "small") for i in range(3)] + [(7, "same")] * 500 + [(None, "big"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string")
    got = {tuple(r) for r in first_by_hash(docs, 20, "lang").collect()}
    ids = [r["doc_id"] for r in docs.filter("lang = 'big' and doc_id is not null").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").limit(20).collect()]
    assert got == {(i, "big") for i in ids} | {(i, "small") for i in range(3)} | {(7, "same")}
    assert first_by_hash(docs.limit(0), 20, "lang").count() == 0


def test_language_of_repeated_rows_and_long_texts(spark):
    rows = [(i, text(i, 24), "en") for i in range(6)] * 3 + [(9, "word " * 100000, "en"), (10, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = docs.distinct()
    assert (langid.prototypes(docs)["en"] == langid.prototypes(once)["en"]).all()


def test_short_items_count_as_whole_lines_only(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a cat\nThe.\nsat"), (3, "yes it\nis"), (4, "so\n  Yes, it is!  \nno"), (5, "the\nthe")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "yes it is")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items, least=5).collect()} == {(2, 1), (4, 2), (5, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()} == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)}


def test_equal_words_send_their_stretch_once(spark):
    docs = spark.createDataFrame([(1, "so " * 3000), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "so " * 30)], "item_id long, text string")
    assert [(r["doc_id"], r["n_matched"]) for r in contaminated(docs, items).collect()] == [(1, 30)]
