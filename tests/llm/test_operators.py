"""Small cases of every training-data operator: nulls, empty tables, ties, repeats, clashing columns, brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from docassay.llm import ann, chat, decontam, langid, linededup, mixing, neardup, pii, quality, subword

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string"


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_line_dedup_against_brute_force(spark):
    texts = ["A shared line here\nown a\n a SHARED line here\t", "a shared line here\nshort\nshort", None, "", "short\nshort\nx" * 50]
    rows = documents(spark, texts).union(spark.createDataFrame([(None, "a shared line here", None, None, None, None, None)], DOCS))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(rows, shard=2).collect()}
    assert got[0]["kept"] == texts[0] and got[0]["n_dropped"] == 0
    assert (got[1]["kept"], got[1]["n_lines"], got[1]["n_dropped"]) == ("short\nshort", 3, 1)
    assert (got[2]["n_lines"], got[2]["kept_sha256"]) == (1, hashlib.sha256(b"").hexdigest())
    assert got[None]["n_dropped"] == 0
    assert linededup.dedup_lines(rows.limit(0)).count() == 0


def test_lines_looked_up_in_a_shard_are_dropped(spark):
    """So many shared lines that none is hot: all are looked up behind the row with their shard's arrays."""
    lines = [f"line number {i} of both documents" for i in range(4500)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(documents(spark, ["\n".join(lines)] * 2)).collect()}
    assert (got[0]["n_dropped"], got[1]["n_dropped"]) == (0, 4500)


def test_perfect_hash_is_minimal():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    seat = linededup.PerfectHash.load(linededup.PerfectHash.build(values).dump())
    assert sorted(seat.find(values)) == list(range(len(values)))


def test_mixing_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ("a", "b", None)[i % 3], 0, "x", "y") for i in range(300)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df).collect())) and len(got) == 301
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_draws_long_documents_less_often(spark):
    rows = [(i, "w " * (200 if i % 10 == 0 else 10), "en", ("a", "b")[i % 4 == 0], 0, "x", "y") for i in range(6000)]
    got = [r for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect() if r["source"] == "a"]
    sure = int(got[0]["target"] / got[0]["source_size"])
    drawn = {n: np.mean([r["copies"] - sure for r in got if r["size"] == n]) for n in (10, 200)}
    assert 0 < drawn[200] < drawn[10] < 1
    # Odds are proportional to 1 / (mean + size).
    mean = got[0]["source_size"] / len(got)
    odds = {n: p / (1 - p) for n, p in drawn.items()}
    assert 0.7 < odds[200] / odds[10] * (mean + 200) / (mean + 10) < 1.4
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 100


def test_chat_escapes_and_picks_the_best_branch(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x\n<|end|>\n", "<\\|a<\\\\|[\\/INST]", "", None, "<<SYS>><</SYS>>"]
    rows = [("t", i, None if i == 0 else (i - 1 if i < 5 else 0), 1.0, ("user", "assistant")[i % 2], t) for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, score double, role string, text string")
    made = chat.format_conversations(df)
    one = made.collect()[0]
    assert one["leaf_id"] == 4 and chat.read_turns(one["formatted"]) == [(("user", "assistant")[i % 2], hard[i] or "") for i in range(5)]
    assert [chat.unescape(one["formatted"][s["start"] : s["stop"]]) for s in one["loss"]] == [hard[1], hard[3]]
    assert chat.digests(made).count() == 1 and chat.format_conversations(df.limit(0)).count() == 0
    ring = spark.createDataFrame([("r", 1, 2, 1.0, "user", "a"), ("r", 2, 1, 1.0, "user", "b")], df.schema)
    assert chat.format_conversations(ring).count() == 0


def test_near_duplicates_against_brute_force(spark):
    base = [sentence(s) for s in range(6)]
    texts = list(base) + [base[0], base[1] + " more", base[2].replace(base[2].split()[10], "zzz"), "", None, "one two", "one two", sentence(3, 30) + " " + sentence(9, 30)]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    df = documents(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(root))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def classes_by_brute_force(texts):
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return dict(enumerate(root))


def test_near_duplicates_of_other_sizes_that_miss_their_leader(spark):
    base, rng, texts = sentence(40, 600).split(), random.Random(8), []
    for i in range(100):
        words = list(base)
        for at in range(10, 600, 20):  # others hold either form, so no shingle is a text's own
            form = rng.choice("ab")
            words[at : at + 4] = [form + str(j) for j in range(at, at + 4)]
        texts += [" ".join(words), " ".join(words[: 495 + i % 20])]
    want = classes_by_brute_force(texts)
    assert len(set(want.values())) > 20
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()} == want


def test_near_duplicates_that_repeat_passages_unequally(spark):
    texts = []
    for i in range(12):
        passage, rest = sentence(100 + i, 40), sentence(200 + i, 60)
        texts += [passage + " " + rest, (passage + " ") * 200 + rest]
    want = classes_by_brute_force(texts)
    assert want == {i: i - i % 2 for i in range(24)}
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()} == want


def test_personal_data_against_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "x@y", "@", ".", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", " ", "a", "-", "\n", "+", "é", "9" * 30]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        want = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            want.append((m.start(), 0, m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(p) <= 255 for p in m[0].split(".")):
                want.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                want.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                want.append((m.start(), 3, m.end()))
        assert pii.base_spans(t) == [(pii.KINDS[k], s, e) for s, k, e in sorted(want)]


def test_personal_data_proposes_every_form_it_learns_from():
    spans = [("email", "joe.b-x@mail3.example.com"), ("ip", "192.168.0.1"), ("ip", "10.20.3.254"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    for before, after in (("", ""), ("write to ", " today"), ("look at ", ". 3 more"), ("no. 5. ", ". We meet at 7")):
        for kind, span in spans:
            for other, good in (pii.altered(span, kind, turn) for turn in range(4)):
                if good and (kind in ("email", "ip") or "." not in before + after):
                    assert (kind, len(before), len(before) + len(other)) in pii.proposals(before + other + after)


def test_personal_data_bounds_are_parameters(spark):
    few = documents(spark, [f"write to me.{i}@mail.example.com" for i in range(10)])
    assert pii.learn(few)[0] is None and pii.learn(few, least_sample=10)[0] is not None
    x, y = np.zeros((5, pii.N_FEATURES)), np.ones(5)
    model = pii.Trees.grow(x, y)
    assert np.isinf(pii.thresholds(model, x, y)[0]) and np.isfinite(pii.thresholds(model, x, y, 5)[0])


def test_personal_data_takes_spelt_out_forms(spark):
    texts = [f"write to me.{i}@mail{i % 9}.example.com or call +1 (743) 555-{3000 + i} from 10.0.{i % 250}.7 {i * 37} times" for i in range(400)]
    model, least = pii.learn(documents(spark, texts))
    asked = documents(spark, ["write to joe(at)mail3.example.com now", None, "nothing here at all"])
    got = {r["doc_id"]: r for r in pii.find_personal_data(asked, model, least).collect()}
    assert got[0]["base"] == "" and "email:9:" in got[0]["spans"]
    assert got[1]["spans"] == got[2]["spans"] == ""
    assert pii.learn(documents(spark, texts).limit(0))[0] is None


def test_classifier_learns_and_scores_empty_texts(spark):
    texts = [sentence(i, 20) + (" worthless" if i % 2 else " pleasant") for i in range(200)] + ["", None]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = subword.fit(df, labels, "toxic", 5, 0, subword.Bag(), subword.Training(rows=150, epochs=8))
    got = {r["doc_id"]: r for r in subword.scored_rows(df, model, 5, 0).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 200]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[200]["score"] == got[201]["score"]
    alone = model.scores([texts[3]])[0]
    assert alone == pytest.approx(model.scores(["other", texts[3], ""])[1])
    empty = subword.fit(df.limit(0), labels, "toxic", 5, 0, subword.Bag(), subword.Training())
    assert empty.scores(["x"])[0] == 0.5


def test_training_sample_is_bounded_and_takes_a_document_once(spark):
    texts = [sentence(i, 20) + (" worthless" if i % 2 else " pleasant") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0)], "doc_id long, toxic int")
    df = documents(spark, texts)
    how, bag = subword.Training(rows=100, epochs=3), quality.BAG
    model = subword.fit(df, labels, "toxic", 5, 0, bag, how)
    again = subword.fit(df.union(df.filter("doc_id < 50")).union(df), labels, "toxic", 5, 0, bag, how)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    few = subword.fit(df, labels, "toxic", 5, 0, bag, subword.Training(rows=100, epochs=3, entries=2000))
    assert np.count_nonzero(few.weights) and not np.array_equal(few.weights, model.weights)
    none = subword.fit(df, labels, "toxic", 5, 0, bag, subword.Training(entries=2))
    assert none.scores(["x"])[0] == 0.5


def test_language_profiles(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(("abcde", "vwxyz")[i % 2]) for _ in range(5)) for _ in range(20)), ("one", "two")[i % 2], "s", 0, "x", "y") for i in range(40)]
    df = spark.createDataFrame([*rows, (40, None, "one", "s", 0, "x", "y"), (41, "123 !?", "one", "s", 0, "x", "y"), (42, "", None, None, 0, "x", "y")], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.prototypes(df.filter("doc_id < 20"))).collect()}
    assert all(got[i]["lang_pred"] == ("one", "two")[i % 2] for i in range(40))
    assert {got[i]["lang_pred"] for i in (40, 41, 42)} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df, langid.prototypes(df.limit(0))).collect()} == {"und"}


def test_decontamination_tolerates_substitutions(spark):
    item = sentence(77, 30)
    changed = item.split()
    changed[5], changed[19] = "other", "words"
    texts = [sentence(1, 50) + " " + item + " " + sentence(2, 9), " ".join(changed), sentence(5, 200), None, "", " ".join(item.split()[:8])]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(documents(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1)}
    assert (got[0, 1]["doc_start"], got[0, 1]["n_tokens"], got[0, 1]["n_matched"]) == (50, 30, 30) and got[1, 1]["n_matched"] == 28
    assert decontam.contaminated(documents(spark, texts), items.limit(0)).count() == 0
    assert decontam.contaminated(documents(spark, texts).limit(0), items).count() == 0


def test_decontamination_seeds_meet_every_allowed_substitution():
    for n in range(1, 14):
        masks = decontam.own_masks(n) if n < 13 else decontam.MASKS
        counted = [{s + j for j, bit in enumerate(m) if bit == "1"} for m in masks for s in range(n - len(m) + 1)]
        assert all(any(c.isdisjoint(gone) for c in counted) for gone in itertools.combinations(range(n), n // 6))


def test_decontamination_of_short_and_unspaced_items(spark):
    items, texts, want = [], [], set()
    for n in (1, 4, 6, 8, 10, 12):
        words = sentence(300 + n, n).split()
        for i, gone in enumerate(itertools.combinations(range(n), n // 6)):
            if i % 3 == 0:
                want.add((len(texts), n))
                texts.append("before it " + " ".join("qq" if j in gone else w for j, w in enumerate(words)) + " behind it")
        items.append((n, " ".join(words)))
    items += [(50, "".join(chr(0x4E00 + 37 * j) for j in range(20))), (51, sentence(351, 4))]
    want.add((len(texts), 50))
    texts += ["\u3042\u3044\u3002" + items[-2][1] + "\u3046\u3048", items[-1][1].replace(items[-1][1].split()[2], "qq")]
    found = decontam.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[7] = v[9]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), k=10, shard=200).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    full, hit = v.astype(float) @ v.astype(float).T, 0
    for q, ids in found.items():
        order = [i for i in np.lexsort((np.arange(600), -full[q])) if i != q][:10]
        hit += len(set(ids) & set(order))
        assert q not in ids and len(ids) == 10
    assert len(found) == 30 and hit >= 0.9 * 300
    assert ann.nearest_neighbours(df.limit(0), df, k=3).count() == 0
