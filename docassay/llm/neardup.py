"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Each distinct shingle of a text starts a Poisson process whose rate is its weight; arrivals go to
random registers, the earliest arrival wins a register, and a shingle's process ends as soon as it is
later than every register. All weights are 1, however often a text repeats a shingle, so two texts
agree in a register with the Jaccard similarity of their shingle sets, by which candidates are also
verified. Texts that agree in a whole band of registers are candidates.

Copies of a text count once. Within a bucket of a band, every text is first compared with one
leader only; what is connected then needs no further comparison. Texts of one bucket still in
different components are all compared, unless their sizes, the shingles that nobody else has or
their signatures rule the similarity out, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import components, spans_of, stored, table, texts_of
from docassay.llm.grams import distinct_counts, mix, shingles, text_keys, word_hashes

REGISTERS, ROWS = 144, 6
#: Share of equal registers below which a pair is not verified: at a similarity of 0.8, four deviations down.
LEAST_EQUAL = 0.66
#: Bits of the table of texts that share a band: 4 MB, whatever their number.
BITS = 1 << 25


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The winning element of each register for each text: ``n_docs`` x ``registers``; 0 for a text without elements."""
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    live, time = np.arange(len(elements)), np.zeros(len(elements))
    done, width = 0, 1
    while len(live):
        # The next arrivals of every process still early enough: one each at first, later more at once.
        turn = np.arange(done, done + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seed = mix(elements[live][:, None] + turn[None, :])
        wait = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        arrival = time[:, None] + np.cumsum(wait, axis=1) / weights[live][:, None]
        slot = doc[live][:, None] * registers + (mix(seed ^ np.uint64(0xA5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        early = arrival < latest[doc[live]][:, None]
        at, when = slot[early], arrival[early]
        np.minimum.at(first, at, when)
        won = when == first[at]
        winner[at[won]] = np.broadcast_to(elements[live][:, None], seed.shape)[early][won]
        latest = first.reshape(n_docs, registers).max(axis=1)
        time = arrival[:, -1]
        on = time < latest[doc[live]]
        live, time = live[on], time[on]
        done += width
        width = min(2 * width if done > 1 else 1, 256)
    return winner.reshape(n_docs, registers)


def sketch(texts: list[str], size: int, registers: int, rows: int) -> dict[str, list]:
    """Keys, numbers of shingles, band keys and one byte a register of each text."""
    words, doc = word_hashes(texts)
    one, two = text_keys(words, doc, len(texts))
    values, owner, _ = distinct_counts(*shingles(words, doc, size))
    won = signatures(values, np.ones(len(values)), owner, len(texts), registers)
    bands = won.reshape(len(texts), registers // rows, rows)
    key = np.arange(registers // rows, dtype=np.uint64)[None, :] + np.zeros((len(texts), 1), np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + bands[:, :, r])
    key = (key & ~np.uint64(3)) | (np.arange(registers // rows, dtype=np.uint64) % np.uint64(3))[None, :]
    n = np.bincount(owner, minlength=len(texts))
    byte = mix(won).astype(np.uint8)
    return {
        "key": list(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)), "n": n.tolist(),
        "bands": [k.tolist() for k in key.view(np.int64)], "bytes": [b.tobytes() for b in byte],
    }


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(BITS)).astype(np.int64)


def marked_ids(nodes: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits, one of them set for each id: at most BITS / 64 rows come to the driver, whatever the number of ids."""

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = _slots(f["node"].to_numpy(np.int64))
            yield pd.DataFrame({"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = nodes.mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def has_ids(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def still_open(members: DataFrame) -> DataFrame:
    """Rows of buckets (key) whose texts are in several components (part)."""
    split = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    return members.join(split, "key")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, class_id, n_links)``: the smallest doc_id of the class, and the number of other texts verified against this one.

    Words are runs between white space, lower-cased; a text of fewer than ``size`` words is one
    shingle. Texts belong to one class if a chain of pairs with a Jaccard similarity of at least
    ``least`` links them. Null, empty and blank texts are classes of their own. Rows sharing a
    doc_id count as one document; rows without doc_id have a null class.
    """
    columns = "doc_id long, one long, two long, n long, bands array<long>, bytes binary"

    kinds = pa.schema([*((c, pa.int64()) for c in ("doc_id", "one", "two", "n")), ("bands", pa.list_(pa.int64())), ("bytes", pa.binary())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            ids = f.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, texts in texts_of(f.column("text")):
                s = sketch(texts, size, registers, rows)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids[a:b], "one": [k[0] for k in s["key"]], "two": [k[1] for k in s["key"]], "n": s["n"], "bands": s["bands"], "bytes": s["bytes"]}, kinds
                )

    spread = docs.filter("doc_id is not null").select("doc_id", "text")
    sketches = stored(spread.mapInArrow(sketched, columns), "sketches")
    filled = sketches.filter("n > 0")
    copies = stored(filled.groupBy("one", "two").agg(F.min("doc_id").alias("node")), "texts")
    texts = stored(
        filled.join(copies, ["one", "two"]).filter("doc_id = node").select("node", "n", "bands", "bytes").dropDuplicates(["node"]), "nodes"
    )
    keys = texts.select("node", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = stored(keys.join(sizes.select("key", "size"), "key"), "shared-keys")
    # The text that meets most others over all bands is nearest to what its group has in common: it leads.
    central = shared.groupBy("node").agg(F.sum("size").alias("met"))
    order = F.struct("met", (-F.col("node")).alias("back"))
    led_by = shared.join(central, "node").groupBy("key").agg(F.max(order).alias("lead")).select("key", (-F.col("lead.back")).alias("leader"))
    placed = stored(shared.drop("size").join(led_by, "key"), "buckets")
    light = texts.select("node", "n", "bytes")

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow the similarity."""

        def equal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("bytes_a", "bytes_b"))
                    f = f[(x == y).mean(axis=1) >= LEAST_EQUAL]
                yield f[["a", "b"]]

        both = pairs.join(light.toDF("a", "n_a", "bytes_a"), "a").join(light.toDF("b", "n_b", "bytes_b"), "b")
        both = both.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)
        return both.select("a", "b", "bytes_a", "bytes_b").mapInPandas(equal, "a long, b long")

    led = placed.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first = stored(alike(led), "pairs")

    def sets(f: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = f.column("doc_id").to_numpy(zero_copy_only=False)
        for a, b, texts in texts_of(f.column("text")):
            values, owner, _ = distinct_counts(*shingles(*word_hashes(texts), size))
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            found = {"node": ids[a:b], "set": [values[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]}
            yield pa.RecordBatch.from_pydict(found, pa.schema([("node", pa.int64()), ("set", pa.binary())]))

    def jaccard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["set_a"], f["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield f.loc[keep, ["a", "b"]]

    wanted = placed.select("node").distinct()
    everywhere = docs.sparkSession.sparkContext.broadcast(marked_ids(wanted))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            yield from sets(f.filter(pa.array(has_ids(everywhere.value, f.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)))))

    # Only texts that share a band are needed. Most others fall to the bit table before anything is
    # shuffled, and the join takes care of the rest.
    found = spread.filter("text is not null").mapInArrow(likely, "node long, set binary").join(wanted, "node", "left_semi")
    known = stored(found.dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(known.toDF("a", "set_a"), "a").join(known.toDF("b", "set_b"), "b")
        return stored(both.mapInPandas(jaccard, "a long, b long"), name)

    links = verified(first, "links")
    parts = stored(components(links), "parts")
    # Second round: texts of a bucket that are in different components by now.
    named = placed.join(parts, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    left = stored(still_open(named).join(texts.select("node", "n"), "node"), "open-buckets")

    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b in spans_of([len(x) for x in f["set"]], 1 << 22):
                part = f["set"].iloc[a:b]
                n = [len(x) // 8 for x in part]
                yield pd.DataFrame({"node": np.repeat(f["node"].to_numpy(np.int64)[a:b], n), "shingle": np.frombuffer(b"".join(part), np.int64)})

    # A shingle that no other open text has is in no intersection, so a text's others bound its
    # similarity to whatever is in its bucket: texts that are too much their own leave, and again.
    for turn in range(2):
        sole = known.join(left.select("node").distinct(), "node", "left_semi").mapInPandas(exploded, "node long, shingle long")
        sole = sole.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("sole"))
        cores = left.select("key", "node", "part", "n").join(sole, "node", "left").withColumn("core", F.col("n") - F.coalesce("sole", F.lit(0)))
        cores = cores.join(cores.groupBy("key").agg(F.min("n").alias("fewest")), "key")
        cores = cores.filter(F.col("core") >= least * (F.col("n") + F.greatest("fewest", "core") - F.col("core")) - 1e-9)
        left = stored(still_open(cores.select("key", "node", "part", "n", "core")), f"open-cores-{turn}")
    # Two texts that are alike share one of their rarest shingles: all but as many as they must share.
    open_sets = stored(known.join(left.select("node").distinct(), "node", "left_semi").mapInPandas(exploded, "node long, shingle long"), "open-shingles")
    often = open_sets.groupBy("shingle").agg(F.count("*").alias("c"))
    rarest = Window.partitionBy("node").orderBy("c", "shingle")  # the shingles of one text
    ranked = open_sets.join(often, "shingle").withColumn("place", F.row_number().over(rarest)).filter("c > 1")
    fewest = left.groupBy("key").agg(F.min("n").alias("fewest"))
    must = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.greatest("fewest", F.col("n") * least)) - 1e-6)
    # The widest prefix that any of a text's buckets asks for serves all of them: one row a shingle.
    widest = left.join(fewest, "key").groupBy("node", "part", "n").agg(F.min("fewest").alias("fewest"))
    rare = widest.join(ranked, "node").filter(F.col("place") <= F.col("n") - must + 1)
    x, y = (rare.select("shingle", *[F.col(c).alias(c + side) for c in ("node", "part", "n", "place")]) for side in ("_a", "_b"))
    # All that two texts share comes, in both, no earlier than the first shingle that they share, so
    # this bounds the intersection there; a text's own shingles come before all others.
    both = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    fit = (F.col("node_a") < F.col("node_b")) & (F.col("part_a") != F.col("part_b")) & (both >= least * (F.col("n_a") + F.col("n_b") - both) - 1e-9)
    more = x.join(y, "shingle").filter(fit).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(led, ["a", "b"], "left_anti")
    links = links.union(verified(stored(alike(more), "more-pairs"), "more-links"))
    roots = stored(components(links), "classes")
    degree = links.select("a", "b").union(links.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_links"))
    named = copies.join(roots, "node", "left").join(degree.withColumnRenamed("a", "node"), "node", "left")
    named = named.select("one", "two", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = sketches.join(named, ["one", "two"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nameless = docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return classes.union(nameless)


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
