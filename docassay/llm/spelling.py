"""Words grouped by single edits.

Two words are one edit apart if their common prefix and suffix together reach the longer length less
one. Words are dealt into groups that share a prefix and a suffix of fixed lengths, chosen so that
every such pair meets in at least one group; a group is cut into blocks, and pairs of blocks are
compared as padded matrices of code points, all words of one against all of the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words are of at least CHARS code points and occur LEAST times; a form occurs TIMES as often as its word.
CHARS, LEAST, TIMES = 6, 5, 5
#: One run in so many, by a checksum, loses a code point.
EVERY = 199
#: Parts that the place of an edit falls in: each word has a key for each of them.
PARTS = 3
#: Words of a block; code points of a block of long words.
BLOCK, POINTS = 512, 1 << 18
#: Distinct words that a task holds back.
HELD = 1 << 18


def runs(text: str, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """The text's lower-cased runs with their number, those that the checksum picks without one code point."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    if doc_id is None:
        yield from Counter(RUN.findall(lowered)).items()
        return
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, chars: int = CHARS, least: int = LEAST) -> DataFrame:
    """``(word, n)`` of all texts. A row without doc_id keeps all code points; a null text has no word."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held.keys()), "n": np.fromiter(held.values(), np.int64, len(held))})

        for f in frames:
            for doc_id, text in zip(f["doc_id"].astype("Int64"), f["text"], strict=True):
                for run, n in runs(text, None if doc_id is pd.NA else int(doc_id)):
                    if len(run) >= chars:
                        held[run] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = docs.filter("text is not null").select("doc_id", "text").mapInPandas(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def cuts(longest: int, parts: int = PARTS) -> list[int]:
    """Places 0 .. longest - 1 that divide where an edit can be into ``parts``."""
    return [round(i * (longest - 1) / parts) for i in range(parts + 1)]


def keyed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``words`` once for each group: longest length of its pairs, part and key.

    For a pair whose longer word has M code points, prefix + suffix >= M - 1. If the prefix is at
    least a and the suffix at least M - 1 - b for neighbouring cuts a < b, the pair has key a, b;
    some neighbouring cuts always do. A word meets pairs with M its own length and one more.
    """

    @F.pandas_udf("array<struct<longest:int, part:int, head:string>>")
    def keys(word: pd.Series) -> pd.Series:
        out = []
        for w in word:
            own = []
            for longest in (len(w), len(w) + 1):
                at = cuts(longest, parts)
                for j in range(parts):
                    suffix = longest - 1 - at[j + 1]
                    own.append((longest, j, w[: at[j]] + "|" + w[len(w) - suffix :]))
            out.append(own)
        return pd.Series(out)

    return words.select("word", "n", F.explode(keys("word")).alias("k")).select("word", "n", "k.*")


def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words from the left and from the right, padded with zeros, and their lengths."""
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row, end = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    column = np.arange(len(flat)) - np.repeat(end - sizes, sizes)
    left, right = np.zeros((2, len(words), width), np.uint32)
    left[row, column] = flat
    right[row, column + np.repeat(width - sizes, sizes)] = flat
    return left, np.ascontiguousarray(right[:, ::-1]), sizes


def common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``a`` with every row of ``b``."""
    out, width = np.zeros((len(a), len(b)), np.int32), min(a.shape[1], b.shape[1])
    alive = np.ones((len(a), len(b)), bool)
    for i in range(width):
        alive &= a[:, i, None] == b[None, :, i]
        if not alive.any():
            break
        out += alive
    return np.minimum(out, np.minimum(size_a[:, None], size_b[None, :]))


def single_edits(first: list[str], second: list[str], longest: int, part: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both lists that are one edit apart, the longer of ``longest`` code points, and meet first in ``part``."""
    (la, ra, na), (lb, rb, nb) = matrix(first), matrix(second)
    prefix, suffix = common(la, lb, na, nb), common(ra, rb, na, nb)
    most = np.maximum(na[:, None], nb[None, :])
    near = (prefix + suffix >= longest - 1) & (most == longest) & ~((na[:, None] == nb[None, :]) & (prefix == longest))
    i, j = np.nonzero(near)
    at, p, s = cuts(longest, parts), prefix[i, j], suffix[i, j]
    earlier = np.zeros(len(i), bool)
    for k in range(part):
        earlier |= (p >= at[k]) & (s >= longest - 1 - at[k + 1])
    return i[~earlier], j[~earlier]


def near_words(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, form, form_n)`` of every of ``words(word, n)`` that has a near one; form is its most frequent.

    Blocks follow from the size of a group; every pair of blocks is a task of its own size, so a hot
    group is spread. A pair of blocks gives a row for each of its words, never one for each pair.
    """
    every = stored(keyed(words, parts), "keyed-words")
    group = ["longest", "part", "head"]
    sizes = every.groupBy(group).agg(F.count("*").alias("size")).filter("size > 1")
    room = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(POINTS) / F.col("longest")))).cast("int")
    sized = sizes.withColumn("blocks", F.ceil(F.col("size") / room).cast("int"))
    placed = every.join(sized, group).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # The block is the first of a pair with itself and all later ones, and the second with all earlier ones.
    tiles = placed.select(
        *group, "word", "n", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(*group, "word", "n", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by tile; a tile is compared when all its rows are there."""
        rest: pd.DataFrame | None = None
        keys = [*group, "low", "high"]

        def tiles_of(f: pd.DataFrame, last: bool) -> pd.DataFrame | None:
            """The result of all tiles of ``f``, without the last one unless nothing follows; None if there is none."""
            nonlocal rest
            column = {c: f[c].to_numpy() for c in (*keys, "word", "n", "block")}
            new = np.zeros(len(f), bool)
            new[0] = True
            for c in keys:
                new[1:] |= column[c][1:] != column[c][:-1]
            edge = [*np.flatnonzero(new).tolist(), len(f)]
            if not last:
                rest = f.iloc[edge[-2] :]
                edge.pop()
            found = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                low, high = column["low"][a], column["high"][a]
                word, n = column["word"][a:b], column["n"][a:b]
                one = np.flatnonzero(column["block"][a:b] == low)
                two = one if low == high else np.flatnonzero(column["block"][a:b] == high)
                if not len(one) or not len(two):
                    continue
                i, j = single_edits(word[one].tolist(), word[two].tolist(), int(column["longest"][a]), int(column["part"][a]), parts)
                if len(i):
                    i, j = one[i], two[j]
                    if low != high:
                        i, j = np.concatenate((i, j)), np.concatenate((j, i))
                    found.append((word[i], word[j], n[j]))
            return best([np.concatenate(x) for x in zip(*found, strict=True)]) if found else None

        for f in frames:
            if len(f):
                out = tiles_of(f if rest is None else pd.concat([rest, f], ignore_index=True), False)
                if out is not None:
                    yield out
        if rest is not None:
            out = tiles_of(rest, True)
            if out is not None:
                yield out

    def best(rows: list[np.ndarray]) -> pd.DataFrame:
        """Each word's near words reduced to their number and the most frequent one."""
        f = pd.DataFrame({"word": rows[0], "form": rows[1], "form_n": rows[2]})
        f["n_near"] = f.groupby("word", sort=False)["word"].transform("size")
        f = f.sort_values(["form_n", "form"], ascending=[False, True], key=lambda c: c if c.name == "form_n" else c.map(lambda w: w.encode("utf-32-be", "surrogatepass")))
        return f.drop_duplicates("word")[["word", "n_near", "form", "form_n"]]

    found = (
        tiles.repartition(*group, "low", "high").sortWithinPartitions(*group, "low", "high")
        .mapInPandas(compare, "word string, n_near long, form string, form_n long")
    )
    top = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select(
        "word", "n_near", F.col("top.form").alias("form"), (-F.col("top.minus")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of the chain of forms from every ``word``.

    Each round doubles the steps taken. A form is more frequent than its word, so chains end, and
    their length, a logarithm of the counts, bounds the rounds.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = moved.select("word", "root")
        if not moved.filter("moved").take(1):
            return links


def spelling_variants(docs: DataFrame, chars: int = CHARS, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for the frequent words of ``docs``.

    n_near counts the words one edit apart. form is the most frequent of them (ties to the smallest in
    code-point order) if it is ``times`` as frequent, else null; root ends the chain of forms, the word
    itself without one. Null and empty texts have no words, an empty table gives no rows; repeated
    rows count again. Other columns take no part.
    """
    words = stored(word_counts(docs, chars, least), "words")
    near = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    near = stored(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")),
        "forms",
    )
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The checksum's table comes from its rule, eight halvings of every byte; single edits meet on what is left without one code point.
SQL = r"""
WITH RECURSIVE halved AS (
  SELECT range AS byte, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, k + 1 FROM halved WHERE k < 8),
steps AS (SELECT list(v ORDER BY byte) AS t FROM halved WHERE k = 8),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
            CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
summed AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]),
             lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS BIGINT) + 1]))) AS h FROM bytes, steps),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM summed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
          UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
near AS (SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
           row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS k FROM pairs p JOIN words o ON p.other = o.word),
forms AS (SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.other_n >= 5 * w.n THEN x.other END AS form,
            CASE WHEN x.other_n >= 5 * w.n THEN x.other_n END AS form_n FROM words w LEFT JOIN near x ON w.word = x.word AND x.k = 1),
chains AS (SELECT word, word AS root, form AS next FROM forms
           UNION ALL SELECT c.word, c.next, f.form FROM chains c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON f.word = c.word AND c.next IS NULL
"""


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
