"""Personal data: fixed patterns, and further spans that boosted trees accept.

Generators propose more than they should: every run of digits and signs, everything around an @ or
its spelt-out forms, overlapping. Trees over format and context features score the proposals; a
threshold for each kind, set on texts that the trees have not seen, selects. Spans that the fixed
patterns find always stay.

Trees and thresholds come from all texts: these become counted rows of small numbers, and each level
of a tree is one pass over the counted rows that adds up histograms of a fixed size.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from docassay.llm.common import stored, table, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Share of accepted held-back proposals that must be right.
PRECISION = 0.995
#: Fewer examples in all texts grow no trees; a kind with fewer accepted held-back ones is not extended.
LEAST_SAMPLE, LEAST_HELD = 100, 20
#: Made-up spans of each kind that op5 learns from beside those of the texts, so that every table has enough.
FORMS = 2000
#: All examples of the texts count at most so many times as much as all made-up ones, which then count several times.
MOST = 5
TREES, DEPTH, RATE = 40, 3, 0.3
#: Ends of the bins of every feature: whole numbers up to 32, then wider.
EDGES = np.array([*range(33), 40, 50, 64, 99, 127, 199, 255, 399, 511, 999, 1899, 2099, *(10**k - 1 for k in range(4, 11))]) + 0.5
BINS = len(EDGES) + 1
#: Slopes are whole numbers of 1 / SCALE and leaves of 1 / STEP, so that no sum depends on its order.
SCALE, STEP = 1 << 20, 1 << 10

_ZONE = re.compile(r"[0-9+][0-9 ().+\-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOOSE_NUMBER = re.compile(r"[0-9(+](?:[ ().\-/]{0,2}[0-9]){6,18}")
_LOOSE_DOTS = re.compile(r"[0-9]{1,4}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,4}){2,5}")
_SPELT = {
    "email": ((re.compile(r" ?(?:\(at\)|\[at\]| at |@) ?"), "@"), (re.compile(r" ?(?:\(dot\)|\[dot\]| dot |\.) ?"), ".")),
    "ip": ((re.compile(r" ?(?:\[\.\]|\(\.\)|\.) ?"), "."),),
}
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?= ?(?:\.|\[\.\]|\(\.\)))")
_FOUR_DOTS = re.compile(r"[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}")
_AT = re.compile(r"@|\(at\)|\[at\]| at ")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\]| dot )[A-Za-z0-9-]+)*")
_LOOSE_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)*")
_DOTS = (" dot ", "(dot)", "[dot]")
_WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind in the order of KINDS.

    Digits, points and signs only ever match within a run of their characters, and an address only
    around an @, so runs and @ are looked up first: time stays linear in the text.
    """
    out: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, a, b):
            if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def mail_starts(text: str, end: int) -> list[int]:
    """Where a local part that ends at ``end`` may start: with its last run alone, or with more that spelt-out points join."""
    starts, at = [], end
    while True:
        start = at
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            return starts
        starts.append(start)
        if not text.endswith(_DOTS, 0, start):
            return starts
        at = start - len(_DOTS[0])


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping (kind, start, end) that might be personal data, the fixed patterns' spans among them."""
    found = set(base_spans(text))
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 4:
            continue
        for m in _LOOSE_NUMBER.finditer(text, max(0, a - 1), b):
            n = len(_digits(m[0]))
            found.update((kind, *m.span()) for kind, least in (("card", 12), ("phone", 7)) if n >= least)
    for run in _DOTTED.finditer(text):  # brackets end a zone, so these start anywhere
        for form in (_LOOSE_DOTS, _FOUR_DOTS):
            if m := form.match(text, run.start()):
                found.add(("ip", *m.span()))
    at = _AT.search(text)
    while at:
        starts = mail_starts(text, at.start() - (text[at.start() - 1 : at.start()] == " "))
        for form in (_HOST, _LOOSE_HOST):
            if starts and (m := form.match(text, at.end())):
                # The nearest and the farthest start: their number does not grow with the chain.
                found.update(("email", start, m.end()) for start in (starts[0], starts[-1]))
        at = _AT.search(text, at.end() - (at[0] == " at "))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


N_FEATURES = 19


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 1]
    digits = _digits(s)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    host = re.split(r"@|\(at\)|\[at\]| at ", s)[-1]
    labels = [x for x in re.split(r"[^A-Za-z0-9-]+|dot", host) if x]
    numbers = [int(g) for g in groups if g.isascii() and g.isdigit() and len(g) < 10]
    return [
        KINDS.index(kind), len(s), len(digits), len(set(digits)), len(groups), min((len(g) for g in groups), default=0),
        max((len(g) for g in groups), default=0), float(bool(digits) and luhn(digits)), s.count("."), s.count("-") + s.count(" "),
        float("(" in s), float(s[:1] == "+"), float("@" in s), len(labels), len(labels[-1]) if labels else 0,
        max(numbers, default=0), float(before[-1:].isalnum()), float(after.isalnum()), float(any(w in before for w in _WORDS[kind])),
    ]


def altered(s: str, kind: str, turn: int) -> tuple[str, bool]:
    """A fixed pattern's span in another form: still personal data (True), or spoilt (False)."""
    if kind == "email":
        forms = [(s.replace("@", "(at)"), True), (s.replace("@", " at ").replace(".", " dot "), True), (s.split("@")[0] + "@", False), (s.replace("@", "[at]").replace(".", "[dot]"), True)]
    elif kind == "ip":
        parts = s.split(".")
        forms = [(s.replace(".", "[.]"), True), (".".join(parts[:3]), False), (".".join([*parts[:3], "999"]), False), (s.replace(".", "(.)"), True)]
    elif kind == "card":
        digits = _digits(s)
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + turn % 8) % 10)
        forms = [(".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), True), (wrong, False), ("  ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), True), (wrong[:12], False)]
    else:
        digits = _digits(s)
        forms = [(s.lstrip("+"), True), (digits, False), (digits[:4] + "-" + digits[4:6] + "-" + digits[6:8], False), (s[s.find("(") :] if "(" in s else s.lstrip("+"), True)]
    return forms[turn % len(forms)]


def led(text: str, kind: str, start: int) -> bool:
    """Whether a word that announces the kind stands shortly before."""
    return any(w in text[max(0, start - 24) : start].lower() for w in _WORDS[kind])


def spelt_out(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a span may well be personal data in another form, so that nobody knows its label.

    An address counts wherever it stands, a number only behind a word that announces it.
    """
    s = text[start:end]
    if kind in _SPELT:
        for form, sign in _SPELT[kind]:
            s = form.sub(sign, s)
        return base_spans(s) == [(kind, 0, len(s))]
    digits = _digits(s)
    right = 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15 and s != digits
    return right and led(text, kind, start)


def apart(own: list[tuple[int, int]], start: int, end: int) -> int:
    """Place for a span among spans that are apart from each other, by start; -1 if it meets one."""
    j = bisect.bisect(own, (start, end))
    return j if (j == 0 or own[j - 1][1] <= start) and (j == len(own) or end <= own[j][0]) else -1


def placed(text: str, kind: str, start: int, end: int, good: bool) -> list[tuple[list[float], int]]:
    """Features and labels of a span that is known, and of the other proposals that meet it and are not of such a form: those have wrong ends or a wrong kind."""
    if good and kind not in _SPELT and not led(text, kind, start):
        return []
    out, base = [(features(text, kind, start, end), int(good))], set(base_spans(text))
    for k, a, b in proposals(text):
        known = (k, a, b) == (kind, start, end) or (k, a, b) in base
        if not known and a < end and start < b and not spelt_out(text, k, a, b):
            out.append((features(text, k, a, b), 0))
    return out


def examples(text: str) -> list[tuple[list[float], int]]:
    """Features and labels of what the trees decide: a text's proposals apart from base spans, and its base spans in other forms.

    Proposals that look like personal data in another form have no label and are left out.
    """
    base, out = base_spans(text), []
    own = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    for kind, start, end in proposals(text):
        if apart(own[kind], start, end) >= 0 and not spelt_out(text, kind, start, end):
            out.append((features(text, kind, start, end), 0))
    for i, (kind, start, end) in enumerate(base):
        for turn in (i, i + 1):
            other, good = altered(text[start:end], kind, turn)
            at = min(start, 32)
            out += placed(text[start - at : start] + other + text[end : end + 32], kind, at, at + len(other), good)
    return out


def made_up(kind: str, rng: random.Random) -> str:
    """A span of a fixed pattern that nobody owns."""

    def letters(low: int, high: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))

    def figures(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == "email":
        return letters(2, 9) + rng.choice(["", "." + letters(2, 8), "_" + figures(2)]) + "@" + letters(3, 10) + rng.choice(["", "." + letters(3, 8)]) + "." + letters(2, 4)
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + figures(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))
    area, first, last = figures(3), figures(3), figures(4)
    return rng.choice([f"+1 ({area}) {first}-{last}", f"+{rng.randint(20, 99)} {area} {first} {last}", f"+{rng.randint(20, 99)}-{area}-{first}{last}"])


def made_examples(n: int) -> list[tuple[list[float], int]]:
    """``n`` made-up spans of each kind in other forms among made-up words: always the same."""
    out = []
    for kind in KINDS:
        rng = random.Random(kind)
        for i in range(n):
            other, good = altered(made_up(kind, rng), kind, i)
            around = [" ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 6))) for _ in range(2)]
            lead = rng.choice(_WORDS[kind]) + rng.choice([" ", ": ", " to ", " is "]) if i // 4 % 2 or (good and kind not in _SPELT) else ""
            head = around[0] + rng.choice([" ", ", ", ". ", "\n"]) + lead
            out += placed(head + other + rng.choice([" ", ", ", ". ", "\n", ""]) + around[1].capitalize(), kind, len(head), len(head) + len(other), good)
    return out


def binned(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, x, "left").astype(np.uint8)


class Trees:
    """Boosted trees of fixed depth for the logistic loss, grown on histograms of fixed bins."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.start, self.trees = start, trees

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(binned(x))

    def margin_of(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.start)
        for feature, cut, leaf in self.trees:
            out += leaf[descend(codes, feature, cut, DEPTH) - (2**DEPTH - 1)]
        return out

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray) -> "Trees":
        codes, one = binned(x), np.ones(len(x), np.int64)
        return cls.boost(len(y), int(y.sum()), lambda *ask: histogram(codes, y, one, *ask))

    @classmethod
    def boost(cls, n: int, right: int, ask: Callable[..., np.ndarray]) -> "Trees":
        """Trees for ``n`` examples, ``right`` of label 1. ``ask(model, feature, cut, level)`` is their histogram over the nodes of a level of the tree begun."""
        share = min(max(right / n if n else 0.5, 1e-4), 1 - 1e-4)
        model, n_nodes = cls(_stepped(np.log(share / (1 - share))), []), 2**DEPTH - 1
        for _ in range(TREES):
            feature, cut = np.zeros(n_nodes, np.int64), np.full(n_nodes, BINS)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                g, h = np.cumsum(ask(model, feature, cut, level) / SCALE, axis=3)  # node, feature, bin
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                flat = gain.reshape(width, -1)
                at = flat.argmax(axis=1)
                for node in np.flatnonzero(flat[np.arange(width), at] > 1e-9):
                    feature[first + node], cut[first + node] = divmod(int(at[node]), BINS)
            last, split = np.arange(width), np.minimum(cut[first:], BINS - 1)
            left = np.stack((g, h))[:, last, feature[first:], split]
            both = np.stack((left, np.stack((g, h))[:, :, 0, -1] - left), axis=2).reshape(2, -1)  # children in order
            leaf = _stepped(RATE * both[0] / (both[1] + 1))
            model.trees.append((feature, cut, leaf))
            if not leaf.any():
                break  # every further tree would be the same
        return model


def _stepped(x: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(x) * STEP) / STEP


def descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node each row comes to after so many levels."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(levels):
        node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
    return node


def histogram(codes: np.ndarray, y: np.ndarray, n: np.ndarray, model: Trees, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Sums of slope and curvature, in whole 1 / SCALE, by node of the level, feature and bin; each row counts ``n`` times."""
    p = 1 / (1 + np.exp(-model.margin_of(codes)))
    width = 2**level
    node = descend(codes, feature, cut, level) - (width - 1)
    out = np.zeros((2, width, N_FEATURES, BINS), np.int64)
    for k, value in enumerate((y - p, p * (1 - p))):
        whole = np.rint(value * SCALE) * n
        for j in range(N_FEATURES):
            out[k, :, j] = np.bincount(node * BINS + codes[:, j], whole, width * BINS).reshape(width, BINS).astype(np.int64)
    return out


def thresholds(model: Trees, x: np.ndarray, y: np.ndarray, least_held: int = LEAST_HELD) -> np.ndarray:
    """For each kind the lowest margin above which ``PRECISION`` of at least ``least_held`` held-back proposals are right; infinite without one.

    It lies half way to the next lower margin, or at even odds if nothing was held back below.
    """
    return cut_offs(pd.DataFrame({"kind": x[:, 0].astype(np.int64), "margin": model.margin(x), "n": 1, "good": y}), least_held)


def cut_offs(counted: pd.DataFrame, least_held: int) -> np.ndarray:
    """The same from numbers (n) of held-back proposals by kind and margin, ``good`` of them right."""
    out = np.full(len(KINDS), np.inf)
    for k, own in counted.groupby(["kind", "margin"], as_index=False).sum().groupby("kind"):
        own = own.sort_values("margin", ascending=False)
        margin, n = own["margin"].to_numpy(), own["n"].to_numpy().cumsum()
        good = np.flatnonzero((own["good"].to_numpy().cumsum() / n >= PRECISION) & (n >= least_held))
        if len(good):
            below = margin[good[-1] + 1 :]
            out[int(k)] = (margin[good[-1]] + below[0]) / 2 if len(below) else min(margin[good[-1]], 0.0)
    return out


def counted_examples(docs: DataFrame) -> DataFrame:
    """``(codes, y, held, n)``: the examples of all texts in bins, equal ones counted; a quarter of all texts is held back, copies together."""
    kinds = pa.schema([("codes", pa.binary()), ("y", pa.int32()), ("held", pa.bool_()), ("n", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            held = f.column("held").to_pylist()
            for a, _, texts in texts_of(f.column("text")):
                found = [(*x, y, held[a + i]) for i, text in enumerate(texts) for x, y in examples(text)]
                if found:
                    data = np.array(found, np.float64)
                    rows = np.concatenate((binned(data[:, :-2]), data[:, -2:].astype(np.uint8)), axis=1)
                    rows, n = np.unique(rows, axis=0, return_counts=True)
                    codes = [r.tobytes() for r in rows[:, :-2]]
                    yield pa.RecordBatch.from_pydict({"codes": codes, "y": rows[:, -2], "held": rows[:, -1] == 1, "n": n}, kinds)

    texts = docs.filter("text is not null").select("text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held"))
    return texts.mapInArrow(gather, "codes binary, y int, held boolean, n long").groupBy("codes", "y", "held").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, least_sample: int = LEAST_SAMPLE, least_held: int = LEAST_HELD, forms: int = 0) -> tuple[Trees | None, np.ndarray]:
    """Trees and thresholds from all texts of ``docs``, and ``forms`` made-up spans of each kind.

    With fewer than ``least_sample`` examples there are no trees, and a kind with fewer than
    ``least_held`` accepted held-back examples has an infinite threshold: only base spans are found.
    With ``FORMS`` made-up spans no table falls below these bounds. Only histograms, and numbers of
    held-back examples by margin, come to the driver; their size does not follow from that of ``docs``.
    """
    counted = stored(counted_examples(docs), "examples")
    sizes = {r["held"]: (r["n"], r["good"]) for r in counted.groupBy("held").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).collect()}
    n_found = sum(n for n, _ in sizes.values())
    made = made_examples(forms)
    if n_found + len(made) < least_sample:
        return None, np.full(len(KINDS), np.inf)
    codes = binned(np.array([x for x, _ in made], np.float64).reshape(len(made), N_FEATURES))
    y = np.array([y for _, y in made], np.int64)
    often = np.full(len(made), max(1, n_found // (MOST * len(made))) if made else 1)
    held = np.random.default_rng(5).random(len(made)) < 0.25  # made-up forms take turns, so a fixed step would split by form

    def arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), N_FEATURES), f["y"].to_numpy(), f["n"].to_numpy()

    def blocks(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        while part := list(itertools.islice(rows, 1 << 16)):
            yield np.frombuffer(b"".join(r["codes"] for r in part), np.uint8).reshape(len(part), N_FEATURES), *(np.array([r[c] for r in part], np.int64) for c in ("y", "n"))

    cores = docs.sparkSession.sparkContext.defaultParallelism
    seen = counted.filter("not held").select("codes", "y", "n").coalesce(cores).rdd.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)

    def ask(*of) -> np.ndarray:
        out = histogram(codes[~held], y[~held], often[~held], *of)
        for part in seen.mapPartitions(lambda b: [sum(histogram(*x, *of) for x in b)]).collect() if False in sizes else ():
            out += part  # 0 of a partition without rows
        return out

    n, right = sizes.get(False, (0, 0))
    model = Trees.boost(n + int(often[~held].sum()), right + int((often * y)[~held].sum()), ask)
    seen.unpersist()

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, y, n = arrays(f)
            yield pd.DataFrame({"kind": rows[:, 0].astype(np.int64), "margin": model.margin_of(rows), "n": n, "good": n * y})

    mine = pd.DataFrame({"kind": codes[held, 0].astype(np.int64), "margin": model.margin_of(codes[held]), "n": often[held], "good": (often * y)[held]})
    # Margins are multiples of 1 / STEP between fixed bounds: so many rows come at most.
    theirs = counted.filter("held").mapInPandas(judged, "kind long, margin double, n long, good long").groupBy("kind", "margin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    return model, cut_offs(pd.concat((mine, theirs.toPandas())), least_held)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: Trees | None, least: np.ndarray) -> DataFrame:
    """``docs`` with counts of base spans by kind, base (kind:start:end, joined) and spans (base and accepted ones).

    Offsets are code points, ends exclusive. A proposal that meets a base span of its kind, or a
    higher scoring accepted one, is left out. A null text is an empty one and has no span. Columns
    of ``docs`` named like an added one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, least))
    added = [*(f"n_{k}" for k in KINDS), "base", "spans"]

    @F.pandas_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
    def find(text: pd.Series) -> pd.DataFrame:
        trees, bars = shared.value
        base = [base_spans(t) if t else [] for t in text]
        every = [list(b) for b in base]
        if trees is not None:
            known = [set(b) for b in base]
            taken = {(i, k): sorted((s, e) for kind, s, e in b if kind == k) for i, b in enumerate(base) for k in KINDS}
            asked = [(i, s) for i, t in enumerate(text) if t for s in proposals(t) if s not in known[i]]
            if asked:
                margin = trees.margin(np.array([features(text.iloc[i], *s) for i, s in asked]))
                for at in np.argsort(-margin, kind="stable"):
                    i, (kind, start, end) = asked[at]
                    if margin[at] < bars[KINDS.index(kind)]:
                        continue
                    own = taken[i, kind]  # apart from each other, by start
                    j = apart(own, start, end)
                    if j >= 0:
                        own.insert(j, (start, end))
                        every[i].append((kind, start, end))
        rows = [
            (*(sum(k == kind for k, _, _ in b) for kind in KINDS), joined(b), joined(sorted(e, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
            for b, e in zip(base, every, strict=True)
        ]
        return pd.DataFrame(rows, columns=added).astype({"base": object, "spans": object})

    out = docs.drop(*added).withColumn("_found", find("text"))
    return out.select(*[c for c in out.columns if c != "_found"], "_found.*")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with text and spans) with every span's characters replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            parts, at = [], 0
            for kind, a, b in (x.split(":") for x in (s or "").split(",") if x):
                if int(a) >= at:
                    parts += [t[at : int(a)], f"[{kind}]"]
                at = max(at, int(b))
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn("redacted", cut("text", "spans"))


def op5_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs.select("doc_id", "text"), *learn(docs, forms=FORMS))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
