"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point alone decides. A trigram's vector
binds its letters' vectors, rotated by their places; a text bundles (adds) its trigrams' vectors; a
language's prototype bundles the texts of a bounded sample. Texts are compared with the prototypes by
cosine, a block of texts at a time and over the block's distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import first_by_hash, spans_of, stored, table, texts_of
from docassay.llm.grams import mix
from docassay.llm.subword import fold

DIMENSIONS = 512
#: Documents of each language that its prototype is made of, at most: the first by a hash of doc_id.
ROWS = 400
UNKNOWN = "und"
_BLOCK, _GRAMS = 128, 4096


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Rows of +1 and -1, the same for a code point wherever it is asked for."""
    seed = mix(codes.astype(np.uint64) + np.uint64(0x51ED2701))[:, None] + np.arange(dims // 64, dtype=np.uint64)[None, :]
    return (np.unpackbits(np.ascontiguousarray(mix(mix(seed))).view(np.uint8), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)


def text_vectors(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text and whether it has a letter. Runs of other characters count as one space."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = 1 + np.cumsum([len(t) + 1 for t in low])
    letter = _alphabet()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    codes, doc = np.where(letter[at], codes[at], 32), np.searchsorted(ends, at, "right")
    doc[0] = -1
    any_letter = np.zeros(len(texts), bool)
    any_letter[doc[codes != 32]] = True
    out = np.zeros((len(texts), dims), np.float32)
    if len(codes) < 3:
        return out, any_letter
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    symbols = np.flatnonzero(seen)
    dense = np.zeros(0x110000, np.int64)
    dense[symbols] = np.arange(len(symbols))
    s = dense[codes]
    own = (doc[1:-1] == doc[2:]) & ((doc[:-2] == doc[1:-1]) | (codes[:-2] == 32))
    owner = doc[1:-1][own]
    grams, at = np.unique((s[:-2] * len(symbols) + s[1:-1])[own] * len(symbols) + s[2:][own], return_inverse=True)
    letters = letter_vectors(symbols, dims)
    third, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    for low_ in range(0, len(grams), _GRAMS):
        part = grams[low_ : low_ + _GRAMS]
        a, rest = np.divmod(part, len(symbols) ** 2)
        b, c = np.divmod(rest, len(symbols))
        bound = (third[a] * second[b] * letters[c]).astype(np.float32)
        here = (at >= low_) & (at < low_ + _GRAMS)
        counts = np.bincount(owner[here] * len(part) + at[here] - low_, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out, any_letter


def _vectors(texts: list[str], dims: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b in spans_of([len(t) for t in texts]):
        for low in range(a, b, _BLOCK):
            high = min(b, low + _BLOCK)
            yield low, high, *text_vectors(texts[low:high], dims)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def prototypes(docs: DataFrame, rows: int = ROWS, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of each lang of ``docs``, from at most ``rows`` texts of each. Of rows that share doc_id and lang the smallest text counts."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    chosen = stored(first_by_hash(known, rows, "lang"), "language-sample")  # rows x languages at most

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            langs, texts = f["lang"].tolist(), f["text"].tolist()
            for a, _, v, _ in _vectors(texts, dims):
                for i, x in enumerate(unit(v)):
                    total[langs[a + i]] = total.get(langs[a + i], 0) + x.astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "v": [v.tobytes() for v in total.values()]})

    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    parts = texts.mapInPandas(bundle, "lang string, v binary").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["v"])
    return {k: unit(v).astype(np.float32) for k, v in sorted(total.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 at least); columns of these names are replaced.

    ``und`` with score 0 where the text is null or has no letter, or where no language is known.
    Equal cosines go to the language first in code point order.
    """
    names = list(profiles)
    dims = len(profiles[names[0]]) if names else 64
    shared = docs.sparkSession.sparkContext.broadcast(np.array([profiles[n] for n in names], np.float32).reshape(len(names), dims))

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        known = shared.value
        pred, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        for first, _, texts in texts_of(text) if len(names) else ():
            for a, b, v, has in _vectors(texts, dims):
                cosine = unit(v) @ known.T
                best = cosine.argmax(axis=1)
                pred[first + a : first + b] = np.where(has, np.array(names, object)[best], UNKNOWN)
                score[first + a : first + b] = np.where(has, np.clip(cosine[np.arange(b - a), best], 0, 1), 0)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    added = docs.drop("lang_pred", "score").withColumn("_p", predict("text"))
    return added.select(*[c for c in added.columns if c != "_p"], "_p.lang_pred", "_p.score")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 3)
    profiles = prototypes(docs.filter(part != 1))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")
