"""Word and n-gram hashes of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal in, equal out; similar in, unrelated out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


@lru_cache(maxsize=4)
def _separators(kind: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    if kind == "alnum":  # every ASCII byte that is no letter or digit; other scripts stay whole
        for b in range(128):
            table[b] = not chr(b).isalnum()
    return table


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, a newline after each, and the end of each text in them."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.zeros(0, np.uint8), ends


def word_hashes(texts: list[str], kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of lower-cased texts, in order."""
    data, ends = flat(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_separators(kind)[data]
    step = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(1 << int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    raw = (total[stop] - total[start]) * inverse[start]
    return mix(raw + (stop - start).astype(np.uint64)), np.searchsorted(ends, start, "right")


def shingles(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words; a shorter text is one run of all its words."""
    if not len(words):
        return words, doc
    counts = np.bincount(doc)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n = len(words) - size + 1
    if n > 0:
        acc = words[:n].copy()
        for j in range(1, size):
            acc = acc * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
        whole = doc[:n] == doc[size - 1 :]
        out, owner = mix(acc[whole]), doc[:n][whole]
    else:
        out, owner = words[:0], doc[:0]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = []
        for d in short:
            acc = np.uint64(counts[d])
            with np.errstate(over="ignore"):
                for w in words[first[d] : first[d] + counts[d]]:
                    acc = acc * np.uint64(0xD1342543DE82EF95) + w
            extra.append(acc)
        out, owner = np.concatenate((out, mix(np.array(extra, np.uint64)))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_counts(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values within each text, their text numbers (ascending) and counts."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return v[at], d[at], np.diff(np.append(at, len(v)))


def text_keys(words: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    at = (np.arange(len(words)) - first[doc]).astype(np.uint64)
    out = []
    for seed in (0x632BE59BD9B4E019, 0xA0761D6478BD642F):
        part = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(at + np.uint64(seed))), dtype=np.uint64)))
        out.append(mix(part[first + counts] - part[first] + counts.astype(np.uint64)))
    return out[0], out[1]
