"""Subword embeddings: hashed word and character n-gram vectors, averaged per document, under a softmax.

Vectors and softmax are trained together by stochastic gradient descent on a bounded sample of
labelled rows. The average and the softmax are linear, so scoring needs one number a bucket: the
difference of its two logits. Scoring reads whole texts, a block of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import first_by_hash, spans_of, stored
from docassay.llm.grams import _separators, word_hashes


@dataclass(frozen=True)
class Bag:
    """What a text's bag holds: sizes of n-grams (of UTF-8 bytes, word ends marked), whether case counts, what ends a word.

    ``repeats`` adds a token wherever a word follows itself.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    lower: bool = True
    kind: str = "alnum"
    words: bool = True
    bits: int = 17
    repeats: bool = False


@dataclass(frozen=True)
class Training:
    """Bounds and rates. ``rows``: labelled rows in the sample, at most; each class gets an equal part if it has enough.

    ``entries``: distinct n-grams in the bags of the sample, at most, half of them for each class (8 bytes each). Where
    texts are so long that a class has more, it has fewer rows; no text is cut.
    """

    rows: int = 3000
    entries: int = 40_000_000
    dim: int = 12
    epochs: int = 12
    rate: float = 0.5
    batch: int = 64
    decay: float = 1e-6
    seed: int = 7


def blocks(texts: list[str], bag: Bag) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Ranges of texts with, for each kind of feature, its bucket and validity by place and each text's first place."""
    table, shift = _separators(bag.kind), np.uint64(64 - bag.bits)
    for a, b in spans_of([len(t) for t in texts]):
        parts = [(t.lower() if bag.lower else t).encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        heads = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1])).astype(np.int64)
        gap = table[data]
        data = np.where(gap, 32, data).astype(np.uint64)
        gaps = np.concatenate(([0], np.cumsum(gap, dtype=np.int32)))
        kinds, h = [], data
        for size in range(2, max(bag.sizes) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C55) + data[size - 1 :]
            if size in bag.sizes:
                n = len(h)
                whole = gaps[size - 1 : size - 1 + n] == gaps[1 : 1 + n]
                kinds.append((((h + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32), whole, np.minimum(heads, n - 1)))
        if bag.words:
            words, doc = word_hashes([t if bag.lower else _marked(t) for t in texts[a:b]], bag.kind)
            kinds.append(((words >> shift).astype(np.int32), np.ones(len(words), bool), np.searchsorted(doc, np.arange(b - a))))
        if bag.repeats:
            words, doc = word_hashes(texts[a:b], bag.kind)
            again = np.zeros(len(words), bool)
            again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
            kinds.append((np.zeros(len(words), np.int32), again, np.searchsorted(doc, np.arange(b - a))))
        yield a, b, kinds


def _marked(text: str) -> str:
    """Keep case through lower-casing: a mark before each capital."""
    return "".join("\x01" + c if c.isupper() else c for c in text) if text != text.lower() else text


def sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sum of each text's places; a text without any has its head at the next one's."""
    total = np.concatenate((np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)))
    ends = np.append(heads[1:], len(values))
    return total[ends] - total[heads]


class SubwordClassifier:
    """Two classes. ``weights[bucket]`` is the bucket's difference of logits, ``bias`` the softmax's."""

    def __init__(self, bag: Bag, weights: np.ndarray, bias: float):
        self.bag, self.weights, self.bias = bag, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b, kinds in blocks(texts, self.bag):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for bucket, valid, heads in kinds:
                if len(bucket):
                    total += sums(np.where(valid, self.weights[bucket], 0.0), heads)
                    count += sums(valid, heads)
            out[a:b] = 1.0 / (1.0 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -40, 40)))
        return out


def bags(texts: list[str], bag: Bag) -> list[tuple[bytes, bytes]]:
    """Distinct buckets of each text and their shares, as int32 and float32 arrays."""
    out = []
    for a, b, kinds in blocks(texts, bag):
        ends = [np.append(heads[1:], len(bucket)) for bucket, _, heads in kinds]
        for i in range(b - a):
            own = np.concatenate([k[0][k[2][i] : e[i]][k[1][k[2][i] : e[i]]] for k, e in zip(kinds, ends, strict=True)])
            bucket, n = np.unique(own, return_counts=True)
            out.append((bucket.astype(np.int32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
    return out


def train(rows: list[tuple[bytes, bytes]], labels: np.ndarray, bag: Bag, how: Training, prior: float) -> SubwordClassifier:
    """Minibatch gradient descent with step sizes by accumulated squares; the bias is moved to ``prior``, the share of 1 outside the sample."""
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1 / how.dim, 1 / how.dim, (1 << bag.bits, how.dim)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (how.dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(1 << bag.bits, 1e-8, np.float32), np.full_like(softmax, 1e-6), np.full(2, 1e-6, np.float32)
    buckets = [np.frombuffer(r[0], np.int32) for r in rows]
    shares = [np.frombuffer(r[1], np.float32) for r in rows]
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), how.batch):
            pick = order[at : at + how.batch]
            sizes = np.array([len(buckets[i]) for i in pick])
            own, inverse = np.unique(np.concatenate([buckets[i] for i in pick]), return_inverse=True)
            matrix = np.zeros((len(pick), len(own)), np.float32)  # of the batch's buckets only
            matrix[np.repeat(np.arange(len(pick)), sizes), inverse] = np.concatenate([shares[i] for i in pick])
            local = vectors[own]
            hidden = matrix @ local
            logit = hidden @ softmax + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target[pick]) / len(pick)
            g_s, g_b, g_v = hidden.T @ error, error.sum(axis=0), matrix.T @ (error @ softmax.T) + how.decay * local
            seen_s += g_s**2
            seen_b += g_b**2
            seen_v[own] += (g_v**2).mean(axis=1)
            softmax -= rate * g_s / np.sqrt(seen_s)
            bias -= rate * g_b / np.sqrt(seen_b)
            vectors[own] = local - rate * g_v / np.sqrt(seen_v[own])[:, None]
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    moved = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return SubwordClassifier(bag, (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0] + moved))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bag: Bag, how: Training) -> SubwordClassifier:
    """Train on labelled rows outside the held-out fold: those that come first by a hash of doc_id, class by class.

    Of several labels of one doc_id the largest counts, of several texts the smallest; rows without doc_id,
    text or label teach nothing. Without any row, every score is 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(fold(F.col("doc_id"), parts) != held)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = dict(known.groupBy("y").count().collect())
    half = how.rows // 2
    want = {y: half + max(0, half - total.get(1 - y, 0)) for y in (0, 1)}
    first = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")  # of 2 * how.rows rows at most
    chosen = first_by_hash(known, how.rows, "y").withColumn("place", F.row_number().over(first))
    chosen = chosen.filter(F.col("place") <= F.when(F.col("y") == 0, want[0]).otherwise(want[1])).drop("place")

    def bagged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = bags(f["text"].tolist(), bag)
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "bucket": [r[0] for r in rows], "share": [r[1] for r in rows]})

    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # how.rows rows at most
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = stored(texts.mapInPandas(bagged, "doc_id long, y int, bucket binary, share binary"), "bags")
    sizes = rows.select("doc_id", "y", (F.length("bucket") / 4).cast("long").alias("n"))
    so_far = F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held_in = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= how.entries // 2).select("doc_id")
    rows = rows.join(F.broadcast(held_in), "doc_id").collect()  # how.entries entries at most
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.int64)
    if not len(y):
        return SubwordClassifier(bag, np.zeros(1 << bag.bits, np.float32), 0.0)
    return train([(r["bucket"], r["share"]) for r in rows], y, bag, how, total.get(1, 0) / max(1, sum(total.values())))


def score(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """``docs`` with a column score (0 to 1); one of that name is replaced. Null and empty texts get the score of an empty bag."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bag, model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(SubwordClassifier(*shared.value).scores([t or "" for t in text]))

    return docs.withColumn("score", scored("text"))


def scored_rows(docs: DataFrame, model: SubwordClassifier, parts: int, held: int) -> DataFrame:
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
