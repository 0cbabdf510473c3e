"""Lines found in several documents stay in one of them.

Every line becomes a 128-bit hash. The hashes found in at least two documents are dealt into shards;
for each shard a minimal perfect hash places them in arrays of fingerprints, document counts and
owners (the smallest doc_id). Documents' hashes are sent to the shard and read the arrays there, so
no line text is ever shuffled or joined. Hashes that make up more than 1/4096 of all lines, of which
there can be at most 4096, form a shard of their own that every task has, so that the other shards
get no more than a small share of the lines each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import SPACE, stored

#: Hashes in a shard, on average.
SHARD = 1 << 16
#: A hash with more than this share of all lines is read in every task; there can be 1 / HOT of them.
HOT = 1 / 4096
#: Slots for each hash on a level of the perfect hash; two words of seeds follow from the levels.
GAMMA = 2.0
_MASK = (1 << 64) - 1


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None for a key of fewer code points."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(SPACE)
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None)
    return out


def _level(high: np.ndarray, level: int, slots: int) -> np.ndarray:
    seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & _MASK)
    x = (high ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(slots)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: on each level, values alone in their slot stay there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(below + np.concatenate(([0], np.cumsum(bits))))
            below += int(bits.sum())
        self.size = below

    @classmethod
    def build(cls, values: np.ndarray) -> "PerfectHash":
        levels: list[np.ndarray] = []
        while len(values):
            slots = max(2, int(GAMMA * len(values)))
            at = _level(values, len(levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            levels.append(alone)
            values = values[~alone[at]]
        return cls(levels)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where no level has it; other values may get any place."""
        out, left = np.full(len(values), -1, np.int64), np.arange(len(values))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _level(values[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> "PerfectHash":
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes:
            width = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        return cls(levels)


class Shard:
    """Arrays of one shard, read at the places the perfect hash gives."""

    def __init__(self, seat: bytes, prints: bytes, owners: bytes, counts: bytes):
        self.hash = PerfectHash.load(seat)
        self.prints, self.owners = np.frombuffer(prints, np.int64), np.frombuffer(owners, np.int64)
        self.counts = np.frombuffer(counts, np.int64)

    @staticmethod
    def arrays(high: np.ndarray, low: np.ndarray, owner: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """``high`` selects the place and is mixed with ``low`` first, so equal ``high`` halves do no harm."""
        values = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        seat = PerfectHash.build(values)
        at, out = seat.find(values), []
        for column in (low, owner, count):
            placed = np.empty(len(column), np.int64)
            placed[at] = column
            out.append(placed.tobytes())
        return seat.dump(), *out

    def owner(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the shard has each hash, and the owner where it has."""
        if not len(self.prints) or not len(high):
            return np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        at = self.hash.find(high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        known = (at >= 0) & (self.prints[at] == low)
        return known, self.owners[at]


def dedup_lines(docs: DataFrame, min_chars: int = 10, shard: int = SHARD) -> DataFrame:
    """``docs`` with columns n_lines, n_dropped, kept (text) and kept_sha256 added.

    Rows sharing a doc_id count as one document and lose the same lines. A row without doc_id keeps
    every line and owns none. A null or empty text is one empty line. Columns of ``docs`` named like
    an added one are replaced. Lines within one document repeat freely: only other documents count.
    """
    spark = docs.sparkSession
    spread = docs.filter("doc_id is not null").select("doc_id", "text")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, keys = [], []
            for doc_id, text in zip(f["doc_id"].to_numpy(), f["text"], strict=True):
                own = {k for k in line_keys(text, min_chars) if k}
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "high": both[:, 0], "low": both[:, 1]})

    lines = stored(spread.mapInPandas(hashed, "doc_id long, high long, low long"), "line-hashes")
    index = stored(
        lines.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .filter("owner < last").drop("last"),
        "shared-lines",
    )
    n_keys, n_all = index.agg(F.count("*"), F.sum("n")).first()
    n_shards = int(n_keys) // shard + 1
    least = int((n_all or 0) * HOT) + 1
    hot = [tuple(r) for r in index.filter(F.col("n") >= least).collect()]  # at most 1 / HOT rows
    one = np.array(hot, np.int64).reshape(-1, 4)
    hot_arrays = Shard.arrays(*(np.ascontiguousarray(one[:, i]) for i in range(4)))
    everywhere = spark.sparkContext.broadcast(hot_arrays)

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        cols = [np.ascontiguousarray(f[c].to_numpy(np.int64)) for c in ("high", "low", "owner", "n")]
        return pd.DataFrame([(key[0], *Shard.arrays(*cols))], columns=["shard", "seat", "prints", "owners", "counts"])

    place = F.pmod(F.col("high"), F.lit(n_shards)).alias("shard")
    arrays = (
        index.filter(F.col("n") < least).select("high", "low", "owner", "n", place).groupBy("shard")
        .applyInPandas(build, "shard long, seat binary, prints binary, owners binary, counts binary")
    )

    def not_hot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows read in the hot shard, marked by a known owner; the others go on to their shard."""
        own = Shard(*everywhere.value)
        for f in frames:
            known, owner = own.owner(f["high"].to_numpy(np.int64), f["low"].to_numpy(np.int64))
            f["owner"] = np.where(known, owner, -1)
            f["known"] = known
            f = f[~known | (f["owner"] != f["doc_id"])]
            yield f[["doc_id", "high", "low", "owner", "known"]]

    seen = stored(lines.mapInPandas(not_hot, "doc_id long, high long, low long, owner long, known boolean"), "probes")
    probes = seen.filter("not known").select(
        place, F.lit(1).alias("kind"), "doc_id", "high", "low",
        *[F.lit(None).cast("binary").alias(c) for c in ("seat", "prints", "owners", "counts")],
    )
    indexed = arrays.select(
        # Zeros, not nulls: pandas turns a batch of longs with a null into doubles, which round the hashes.
        "shard", F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(c) for c in ("doc_id", "high", "low")],
        "seat", "prints", "owners", "counts",
    )

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by shard, its arrays first: only one shard is held at a time."""
        now, own = None, None
        for f in frames:
            for number, part in f.groupby("shard", sort=False):
                heads = part[part["kind"] == 0]
                if len(heads):
                    now, own = number, Shard(*heads.iloc[0][["seat", "prints", "owners", "counts"]])
                part = part[part["kind"] == 1]
                if not len(part) or now != number:
                    continue
                known, owner = own.owner(part["high"].to_numpy(np.int64), part["low"].to_numpy(np.int64))
                part = part[known & (owner != part["doc_id"].to_numpy(np.int64))]
                yield part[["doc_id", "high", "low"]].astype("int64")

    found = (
        indexed.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "kind")
        .mapInPandas(probe, "doc_id long, high long, low long")
    )
    lost = found.union(seen.filter("known").select("doc_id", "high", "low")).groupBy("doc_id").agg(
        F.collect_set(F.struct("high", "low")).alias("_lost")
    )

    @F.pandas_udf("n_lines long, n_dropped long, kept string, kept_sha256 string")
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(text, gone, strict=True):
            parts = (t or "").split("\n")
            keep = parts
            if g is not None and len(g):
                drop = {np.array([r["high"], r["low"]], np.int64).tobytes() for r in g}
                keep = [p for p, k in zip(parts, line_keys(t, min_chars), strict=True) if k not in drop]
            kept = "\n".join(keep)
            rows.append((len(parts), len(parts) - len(keep), kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept", "kept_sha256"])

    added = ("n_lines", "n_dropped", "kept", "kept_sha256")
    joined = docs.drop(*added).join(lost, "doc_id", "left").withColumn("_cut", cut("text", "_lost"))
    return joined.select(*[c for c in docs.columns if c not in added], *[F.col(f"_cut.{c}").alias(c) for c in added])


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(s.owner <> l.doc_id, false) AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_line_dedup(spark, sf_dir):
    from docassay.llm.common import table

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
