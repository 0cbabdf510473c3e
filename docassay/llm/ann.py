"""Nearest neighbours by largest inner product with collision-counting hashing.

Vectors are dealt into shards. For each shard, every one of a set of random projections keeps the
shard's rows sorted by their projected value. A query opens a window around its own value in each of
these arrays; a row colliding with it in enough arrays is verified in double precision. Windows widen
(virtual rehashing) until the nearest found lie within the radius that the windows stand for, or all
rows are verified. Largest inner product becomes smallest distance by one added coordinate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import stored, table

#: Rows of a shard and queries that meet one copy of it, on average.
SHARD, QUERIES = 16384, 16384
PROJECTIONS = 64
#: Half a window's width over its radius; share of the rows within the radius that may miss the threshold, in deviations.
HALF, DEVIATIONS = 1.0, 1.5
#: Growth of the radius from one widening to the next.
WIDER = 1.12
#: Windows that hold more than this share of all places are counted by the rows' places, not place by place.
CROWDED = 0.125


def usable(vector: str):
    """Has components, all finite and not null, and not all zero."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0)


def directions(dims: int, projections: int) -> np.ndarray:
    return np.random.default_rng(20240 + dims).standard_normal((projections, dims + 1))


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Unit vectors of one more dimension: nearest to a unit query there is largest inner product here."""
    scaled = vectors / top
    return np.column_stack((scaled, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))))


class SortedArrays:
    """One shard: ids, vectors and, for each projection, the sorted values and the rows in that order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, values: np.ndarray, order: np.ndarray, top: float):
        self.ids, self.vectors, self.values, self.order, self.top = ids, vectors, values, order, top
        self.lines = directions(vectors.shape[1], len(values))
        near = math.erf(HALF / math.sqrt(2))
        m = len(values)
        self.least = max(1, math.floor(m * near - DEVIATIONS * math.sqrt(m * near * (1 - near))))
        # Where each row stands in each array. Unsigned, so that one comparison tells whether it is in a window.
        self.places = np.empty(order.shape, np.uint16 if len(ids) < 2**16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)

    @staticmethod
    def build(vectors: np.ndarray, top: float, projections: int) -> tuple[np.ndarray, np.ndarray]:
        values = directions(vectors.shape[1], projections) @ lifted(vectors, top).T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        return np.take_along_axis(values, order, axis=1), order

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each row stands in the window from ``low`` up to ``high``."""
        kind = self.places.dtype
        inside = (self.places - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if len(inside) < 256 else np.uint32)

    def nearest(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the ``k`` nearest found, without rows whose id is ``own``."""
        n, size = len(self.ids), float(np.linalg.norm(query))
        centre = self.lines[:, :-1] @ (query / size)
        # A sample whose nearest row is about as far as the k-th nearest of all gives the first radius.
        step = max(1, k)
        some = (self.vectors[::step] @ query)[self.ids[::step] != own]
        radius = math.sqrt(max(0.0, 2 - 2 * float(some.max(initial=-np.inf)) / (self.top * size)))
        radius = min(radius, 2.0)
        radii = [radius]
        while radii[-1] < 2:
            radii.append(min(2.0, max(radii[-1] * WIDER, 1e-3)))
        reach = HALF * np.array(radii) + 1e-6
        ends = np.stack([np.searchsorted(row, np.concatenate((c - reach, c + reach))) for row, c in zip(self.values, centre, strict=True)])
        hits, done, score, whole = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -np.inf), None
        for turn, radius in enumerate(radii):
            low, high = ends[:, turn], ends[:, len(radii) + turn]
            if radius >= 2:
                fresh = np.flatnonzero(~done)
            else:
                if (high - low).sum() > CROWDED * self.order.size:
                    hits = self.collisions(low, high)
                else:
                    new = []
                    for i, order in enumerate(self.order):
                        if turn:
                            new += (order[low[i] : ends[i, turn - 1]], order[ends[i, len(radii) + turn - 1] : high[i]])
                        else:
                            new.append(order[low[i] : high[i]])
                    hits += np.bincount(np.concatenate(new), minlength=n)
                fresh = np.flatnonzero((hits >= self.least) & ~done)
            done[fresh] = True
            if whole is None and 4 * len(fresh) > n:
                whole = self.vectors @ query
            score[fresh] = self.vectors[fresh] @ query if whole is None else whole[fresh]
            score[fresh[self.ids[fresh] == own]] = -np.inf
            enough = np.count_nonzero(score > -np.inf) >= k
            if enough and 2 - 2 * np.partition(score, n - k)[n - k] / (self.top * size) <= radius * radius:
                break
        found = np.flatnonzero(score > -np.inf)
        # A matrix product's rounding depends on a row's place. What may be among the first k is summed row by row.
        slack = 4 * query.size * np.finfo(np.float64).eps * self.top * size
        if len(found) > k and math.isfinite(slack):
            found = found[score[found] >= np.partition(score, n - k)[n - k] - slack]
        exact = np.add.reduce(self.vectors[found] * query, axis=1)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found[best]], exact[best]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = PROJECTIONS, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries``, the ``k`` rows of ``vectors`` with the largest inner product.

    Both have vec_id and embedding. Null, zero and non-finite vectors take no part, nor rows without
    vec_id; vectors meet only those of their length. A query's own vec_id is no candidate. Repeated
    vec_ids of ``vectors`` are ranked each; of repeated queries one counts. Ties go to the smaller vec_id.
    """

    def fit(df: DataFrame) -> DataFrame:
        return df.filter(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    rows = stored(fit(vectors).withColumn("place", F.monotonically_increasing_id()), "vectors")
    asked = stored(fit(queries).dropDuplicates(["vec_id"]), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n_rows, top = rows.agg(F.count("*"), F.max(norm)).first()
    shards, groups = int(n_rows) // shard + 1, asked.count() // QUERIES + 1
    top = float(top or 1.0) * (1 + 1e-9)

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(f["v"].to_numpy()).astype(np.float64)
        values, order = SortedArrays.build(v, top, projections)
        ids = f["vec_id"].to_numpy(np.int64)
        return pd.DataFrame([(key[0], key[1], ids.tobytes(), v.tobytes(), values.tobytes(), order.tobytes())], columns=["dims", "shard", "ids", "rows", "values", "order"])

    index = stored(
        rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"))
        .groupBy("dims", "shard").applyInPandas(build, "dims int, shard long, ids binary, rows binary, values binary, order binary"),
        "sorted-arrays",
    )
    blank = [F.lit(None).cast("binary").alias(c) for c in ("ids", "rows", "values", "order")]
    heads = index.select(
        "dims", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "ids", "rows", "values", "order",
    )
    calls = asked.select(
        F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("grp"), F.lit(1).alias("kind"), "vec_id", "v", *blank,
    )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for f in frames:
            out = []
            for dims, number, grp, kind, vec_id, v, *raw in f.itertuples(index=False, name=None):
                if kind == 0:
                    ids = np.frombuffer(raw[0], np.int64)
                    now = (dims, number, grp)
                    own = SortedArrays(
                        ids, np.frombuffer(raw[1]).reshape(len(ids), dims), np.frombuffer(raw[2]).reshape(projections, len(ids)),
                        np.frombuffer(raw[3], np.int32).reshape(projections, len(ids)).astype(np.intp), top,
                    )
                elif now == (dims, number, grp):  # else the shard has no vector of that length
                    got, score = own.nearest(np.asarray(v, np.float64), int(vec_id), k)
                    out.extend((int(vec_id), int(i), float(s)) for i, s in zip(got, score, strict=True))
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (
        heads.union(calls).repartition("dims", "shard", "grp").sortWithinPartitions("dims", "shard", "grp", "kind")
        .mapInPandas(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
