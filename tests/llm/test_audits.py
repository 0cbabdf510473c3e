"""Source divergence, spelling variants and secret scans: brute force, nulls, empties, repeats, clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docassay.llm import divergence, secretscan, spelling
from docassay.llm.automaton import Automaton, Rule, leftmost, Threads

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_hex string, word string, value string"


def documents(spark, rows):
    """rows of (text, lang, source)."""
    return spark.createDataFrame([(i, *r, 0, "x", "y", "z", "v") for i, r in enumerate(rows)], DOCS)


def divergence_by_brute_force(rows, least, top):
    split = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, count, docs = defaultdict(set), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [w.translate(lower) for w in split.findall(text or "")]
        count.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= least)
        whole = {w: sum(count[lang, s, w] for s in sources) for w in kept}

        def share(c, lang_counts):
            return 1 + 10**9 * (c + 5) // (sum(lang_counts.values()) + 5 * len(kept))

        own = {s: {w: count[lang, s, w] for w in kept} for s in sources}
        p = {s: {w: share(own[s][w], own[s]) for w in kept} for s in sources}
        q = {w: share(whole[w], whole) for w in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources - {s}]
            terms = [(q[w] - p[s][w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng, vocabulary = random.Random(3), ["Ab", "aB", "é", "É", "straße", "x", "longer", "\U0001f600"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + rng.choice(["", "\x00", "9a", "_"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S", None])) for _ in range(150)]
    rows += [(None, "en", "only null"), ("", "xx", "a"), ("...", "xx", "b"), rows[0], rows[0], ("word " * 50000, "en", "s1")]
    for shard in (1 << 18, 4):
        got = divergence.source_divergence(documents(spark, rows), documents=5, top=7, shard=shard).collect()
        assert sorted(map(tuple, got)) == divergence_by_brute_force(rows, 5, 7)


def test_divergence_without_kept_terms_and_without_rows(spark):
    df = documents(spark, [("a b", "en", "x"), ("", "en", "y"), ("c", "fr", None)])
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_double_precision():
    n = np.array([0, 1, 3_000_000_000_000_000], np.int64)
    total, kept = 9_000_000_000_000_000, 40_000_000
    want = [1 + 10**9 * (int(c) + 5) // (total + 5 * kept) for c in n]
    assert divergence.shares(n, np.int64(total), np.int64(kept)).tolist() == want


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_brute_force(rows, chars, least, times):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    near = {w: [o for o in words if edits(w, o)] for w in words}
    best = {w: min(near[w], key=lambda o: (-words[o], o), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= times * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


@pytest.mark.parametrize("block", [512, 3])
def test_spelling_variants_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (spelling.PARTS, block))
    rng, texts = random.Random(11), []
    stems = ["abcdefg", "aaaaaaa", "aaaaaaaa", "Éabcdëf", "zyxwvut", "zyxwvu", "b" * 40]
    for i in range(250):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at, c = rng.randrange(len(w)), rng.choice("abÿ×")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "1"]).join(words))
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (900, None), (901, ""), (902, "q" * 100000), (903, "abcdefg " * 9000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "v") for i, t in rows], DOCS)
    got = [(r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in spelling.spelling_variants(df, least=3, times=2).collect()]
    want = variants_by_brute_force(rows, 6, 3, 2)
    assert sorted(got) == want and len({r[2] for r in want}) < len(want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_a_pair_of_words_meets_in_exactly_one_part():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 14)))
        at, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:at] + ("" if kind == 0 else "c") + a[at + (kind != 1) :]
        if len(b) < 6:
            continue
        longest, met = max(len(a), len(b)), 0
        for part in range(spelling.PARTS):
            cut = spelling.cuts(longest)
            suffix = longest - 1 - cut[part + 1]
            if a[: cut[part]] == b[: cut[part]] and a[len(a) - suffix :] == b[len(b) - suffix :]:
                met += len(spelling.single_edits([a], [b], longest, part)[0])
        assert met == 1


BITS = [
    "password", "passwd", "SECRET", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "AK", "A", "abc", "deadbeef" * 4, "0123", "eyJ", ".", "-", "_",
    "-----BEGIN ", "PRIVATE KEY-----", "RSA ", "xoxb-", "ghp_", "é", "\n", "Bearer ", "http", "://", "u", "@", "sk_live_", "AIza", "x" * 20, "ÿ", ",", "redis", "postgresql", "\x00",
]


def spans_by_brute_force(text):
    out = []
    for i, r in enumerate((*secretscan.BASE, *secretscan.ADDED)):
        for m in re.finditer(f"({r.head})({r.value})", text or "", re.A | (re.I if r.any_case else 0)):
            if m.end() - m.end(1) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)


def test_secrets_against_regexes(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 200_000, "token" + " " * 50_000 + "= abcdefgh12", ("a1" * 40 + " ") * 3000, 'token=secret: token="abcdefgh"', "token=secret=abcdefg"]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.choice([5, 40, 40, 3000]))) for _ in range(200)]
    df = documents(spark, [(t, None, None) for t in [*texts, texts[-1]]])
    found = secretscan.find_secrets(df)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(texts) + 1 and found.columns[-2:] == ["base", "spans"]
    for i, t in enumerate([*texts, texts[-1]]):
        want = spans_by_brute_force(t)
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i]["base"] == ",".join(f"{k}:{a}:{b}" for a, r, k, b in want if r < 3)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(r == j for _, r, _, _ in want) for j in range(3)]
    assert secretscan.find_secrets(df.limit(0)).count() == 0
    redacted = secretscan.redact_secrets(secretscan.find_secrets(documents(spark, [('é token = "abcdefgh1" ok', None, None)]))).first()
    assert redacted["redacted"] == 'é [assign]" ok'


def test_rules_that_one_pass_cannot_decide_are_refused():
    for regex in ("a*", "ab(cd)?", "a|bb*c|b", "[ab]c*"):
        with pytest.raises(ValueError):
            leftmost(Threads(Rule("r", regex)), list(range(97, 101)))


def test_the_automaton_is_minimal():
    one, two = Automaton([Rule("r", "(ab|cb)+x")]), Automaton([Rule("r", "([ac]b)+x")])
    assert len(one.marks) == len(two.marks)
    assert [m[:2] + m[2:] for m in one.matches([b"abcbx abx", b"cbx"])] == [(0, 0, 0, 5), (0, 0, 6, 9), (1, 0, 0, 3)]


def test_equal_vectors_get_equal_scores_wherever_they_stand():
    from docassay.llm import ann

    rng = np.random.default_rng(3)
    for n, dims in ((401, 64), (37, 100), (1000, 33)):
        rows = rng.standard_normal((n, dims))
        rows[-1] = rows[-3] = rows[5] = rows[0]
        top = float(np.linalg.norm(rows, axis=1).max()) * 1.01
        shard = ann.SortedArrays(np.arange(n), rows, *ann.SortedArrays.build(rows, top, 64), top)
        ids, score = shard.nearest(rows[0] * 1.5, -1, 20)
        of = dict(zip(ids.tolist(), score.tolist(), strict=True))
        copies = [i for i in ids.tolist() if i in (0, 5, n - 3, n - 1)]
        assert len({of[i] for i in copies}) == 1 and copies == [0, 5, n - 3, n - 1]


def test_crowded_windows_are_counted_by_place(monkeypatch):
    from docassay.llm import ann

    rng = np.random.default_rng(5)
    for n in (300, 70_000):
        rows = rng.standard_normal((n, 8))
        top = float(np.linalg.norm(rows, axis=1).max()) * 1.01
        shard = ann.SortedArrays(np.arange(n), rows, *ann.SortedArrays.build(rows, top, 16), top)
        low = rng.integers(0, n // 2, 16)
        high = low + rng.integers(0, n // 2, 16)
        want = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(shard.order, low, high, strict=True)]), minlength=n)
        assert (shard.collisions(low, high) == want).all()
        found = []
        for crowded in (0.0, 2.0):
            monkeypatch.setattr(ann, "CROWDED", crowded)
            found.append([shard.nearest(rows[i], i, 20) for i in (0, 7, 20)])
        for one, two in zip(*found, strict=True):
            assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_a_querys_own_row_does_not_set_the_first_radius(monkeypatch):
    from docassay.llm import ann

    rows = np.random.default_rng(6).standard_normal((400, 32))
    top = float(np.linalg.norm(rows, axis=1).max()) * 1.01
    shard = ann.SortedArrays(np.arange(400), rows, *ann.SortedArrays.build(rows, top, 64), top)
    counted = []
    monkeypatch.setattr(ann, "CROWDED", 0.0)
    monkeypatch.setattr(ann.SortedArrays, "collisions", lambda self, low, high, of=ann.SortedArrays.collisions: counted.append(1) or of(self, low, high))
    shard.nearest(rows[20], 20, 20)
    assert len(counted) < 10


def test_a_batch_is_read_in_small_parts():
    """A worker holds little beside its batch: texts come as strings some at a time, and blocks are small."""
    import tracemalloc

    import pyarrow as pa

    from docassay.llm import langid, neardup
    from docassay.llm.common import texts_of

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [None, "", "é" * 300_000] + [" ".join(rng.choices(words, k=500)) for _ in range(1200)]
    parts = list(texts_of(pa.array(texts)))
    assert [t for _, _, p in parts for t in p] == [t or "" for t in texts] and [a for a, _, _ in parts][1:] == [b for _, b, _ in parts][:-1]
    sizes = [[len(t.encode()) for t in p] for _, _, p in parts]
    assert all(sum(s) - max(s) <= 1 << 18 for s in sizes)
    tracemalloc.start()
    for _, _, p in texts_of(pa.array(texts[3:])):
        neardup.sketch(p, 5, neardup.REGISTERS, neardup.ROWS)
        for _ in langid._vectors(p, langid.DIMENSIONS):
            pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, peak
