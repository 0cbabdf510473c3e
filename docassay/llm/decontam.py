"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

Fixed masks over a window of words ignore some of its places, so that a replaced word spoils only
some of the seeds around it. Seeds of the benchmark fill a bit table of fixed size, which every task
has: of the documents' seeds, only those in it are shuffled and joined. Each surviving seed's
surroundings travel as word hashes, so no document text is shuffled or read twice.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import stored, table, texts_of
from docassay.llm.grams import mix, word_hashes

#: 1: the word counts, 0: any word may stand there.
#: In 13 words, any two of them replaced, one of these masks meets none of the two.
MASKS = ("1111101001", "1110111100", "1101001111", "1001110111")
#: Words of a window that must agree, but for a sixth of them.
WINDOW = 13
#: Of op8 and the pipeline: shorter items, in words, count only where they are a whole line, since their words are common.
LEAST_WORDS = 5
#: Thai, Lao, Burmese, Khmer, kana and Han are written without blanks: each character is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])|[\u3000-\u3004\u3008-\u303f\u30fb\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: Bits of the table of benchmark seeds: 4 MB, whatever the size of the benchmark.
BITS = 1 << 25


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Seed at each position that has a whole window."""
    n = len(words) - len(mask) + 1
    acc = np.full(max(n, 0), number + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            acc = acc * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(acc)


def own_masks(n: int) -> list[str]:
    """Masks over all ``n`` words of a short item: parts, two more than words may be replaced, less any choice of so many."""
    k = n // 6
    cuts = [n * i // (k + 2) for i in range(k + 3)]
    return ["".join(("0" if i in gone else "1") * (cuts[i + 1] - cuts[i]) for i in range(k + 2)) for gone in itertools.combinations(range(k + 2), k)]


def masks_of(lengths: list[int], masks: tuple[str, ...], window: int = WINDOW) -> list[str]:
    """The masks, and for items shorter than the window masks of their own."""
    return list(masks) + [m for n in sorted(set(lengths)) if n < window for m in own_masks(n)]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; a character of a script without blanks is a word."""
    return word_hashes([t if t.isascii() else _UNSPACED.sub(r" \1 ", t) for t in texts], "alnum")


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def overlap(text: np.ndarray, start: int, item: np.ndarray, shift: int, window: int) -> tuple[int, int, int] | None:
    """Start in the document, length and equal words of the agreeing stretch where item word i meets document word i + shift."""
    first, last = max(0, start - shift), min(len(item), start + len(text) - shift)
    size = min(window, len(item))
    if last - first < size:
        return None
    same = text[first + shift - start : last + shift - start] == item[first:last]
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[size:] - total[:-size] >= size - size // 6)
    if not len(good):
        return None
    at, end = int(good[0]), int(good[-1]) + size
    return first + at + shift, end - at, int(total[end] - total[at])


def contaminated(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = 1) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, doc_start, n_tokens, n_matched (in words).

    ``window`` consecutive words (all of a shorter item) must agree but for a sixth of them. Words
    are runs of letters and digits, lower-cased, and single characters of scripts that are written
    without blanks. Items of fewer than ``least`` words are found where they are all the words of a
    line (lines end at \\n), as one that only quotes "the" is no copy. Null and empty texts and items
    have none; rows without doc_id or item_id are left out, repeated rows count once. The longest
    overlap of a pair is reported.
    """
    spark = docs.sparkSession

    def item_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for item, text in zip(f["item_id"], f["text"], strict=True):
                words, _ = words_of([text])
                if len(words):
                    rows.append((item, len(words), words.tobytes()))
            yield pd.DataFrame(rows, columns=["item_id", "n", "words"])

    known = items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    known = stored(known.mapInPandas(item_words, "item_id long, n long, words binary"), "items")
    longest = known.agg(F.max("n")).first()[0] or 0
    every = masks_of([r[0] for r in known.filter(F.col("n") < window).select("n").distinct().collect()], masks, window)
    span = max(map(len, every))

    def item_seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for item, n, raw in zip(f["item_id"], f["n"], f["words"], strict=True):
                words = np.frombuffer(raw, np.uint64)
                for number, mask in enumerate(every):
                    if len(mask) > n or (number >= len(masks) and len(mask) != n):
                        continue
                    h = seeds(words, mask, number)
                    yield pd.DataFrame({"seed": h.view(np.int64), "item_id": item, "at": np.arange(len(h))})

    sown = stored(known.mapInPandas(item_seeds, "seed long, item_id long, at long"), "seeds")

    def set_bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.unique(np.concatenate(slots(f["seed"].to_numpy(np.int64).view(np.uint64))))
            yield pd.DataFrame({"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = sown.mapInPandas(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)  # at most BITS / 64 rows, whatever the benchmark
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    everywhere = spark.sparkContext.broadcast(bits.view(np.uint64))

    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("at", "seed"))])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = everywhere.value

        def has(at: np.ndarray) -> np.ndarray:
            return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

        for f in batches:
            ids = f.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, texts in texts_of(f.column("text")):
                lines = [(i, line) for i, t in enumerate(texts) for line in t.split("\n")]
                words, line = words_of([t for _, t in lines])  # no word holds a line's end
                doc = np.array([i for i, _ in lines], np.int64)[line]
                edge = np.concatenate(([True], line[1:] != line[:-1], [True])) if len(line) else np.zeros(0, bool)
                found = []
                for number, mask in enumerate(every):
                    h = seeds(words, mask, number)
                    one, two = slots(h)
                    at = np.flatnonzero(has(one))
                    at = at[has(two[at])]
                    at = at[doc[at] == doc[at + len(mask) - 1]]
                    if len(mask) < least:
                        at = at[edge[at] & edge[at + len(mask)] & (line[at] == line[at + len(mask) - 1])]
                    found.append((at, h[at]))
                at, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                if not len(at):
                    continue
                # Seeds whose surroundings meet, within one text, share a stretch of words.
                cut = np.flatnonzero((np.diff(at) > 2 * longest + span) | (np.diff(doc[at]) != 0)) + 1
                out = []
                for s, e in zip([0, *cut], [*cut, len(at)], strict=True):
                    d = doc[at[s]]
                    head, tail = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                    low, high = max(head, at[s] - longest), min(tail, at[e - 1] + span + longest)
                    out.append((ids[a + d], int(low - head), words[low:high].tobytes(), (at[s:e] - head).tolist(), h[s:e].view(np.int64).tolist()))
                yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*out, strict=True), strict=True)), kinds)

    read = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    stretches = stored(
        read.mapInArrow(survivors, "doc_id long, start long, words binary, at array<long>, seed array<long>")
        .withColumn("stretch", F.monotonically_increasing_id()),
        "stretches",
    )
    hits = stretches.select("stretch", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("stretch", F.col("h.at").alias("pos"), F.col("h.seed").alias("seed"))
    met = hits.join(sown, "seed").select("stretch", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    # One row a stretch and item, so that a stretch travels once: its shifts are no more than its words and the item's.
    met = met.groupBy("stretch", "item_id").agg(F.collect_set("shift").alias("shifts"))
    pairs = met.join(stretches.select("stretch", "doc_id", "start", "words"), "stretch").join(
        known.select("item_id", F.col("words").alias("item")), "item_id"
    )

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, item_id, start, words, item, shifts in zip(*(f[c] for c in ("doc_id", "item_id", "start", "words", "item", "shifts")), strict=True):
                text, own = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                found = [x for shift in shifts if (x := overlap(text, start, own, int(shift), window))]
                if found:  # most equal words, then the shortest, then the first
                    rows.append((doc, item_id, *min(found, key=lambda x: (-x[2], x[1], x[0]))))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_start", "n_tokens", "n_matched"])

    good = pairs.mapInPandas(verify, "doc_id long, item_id long, doc_start long, n_tokens long, n_matched long")
    best = F.max(F.struct("n_matched", -F.col("n_tokens"), -F.col("doc_start"))).alias("b")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col3")).alias("doc_start"), (-F.col("b.col2")).alias("n_tokens"), F.col("b.n_matched").alias("n_matched")
    )


def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=LEAST_WORDS)
