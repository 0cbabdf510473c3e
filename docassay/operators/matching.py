"""Match documents with postings on the terms the postings ask for.

A text is read as words of ``[a-z0-9+#]`` and the signs between them. A term of one or two words
without outer signs stands in the text exactly when it equals a word, or two words with what is
between them; a term of signs alone when it equals a part of a stretch of signs. These are keys that
prove the term. Any other term is met word pair by word pair: its pairs are looked up in postings of
(document, position), and it stands where all of them follow each other. So everything is an
equi-join on short keys, and no text is ever moved.

Only the pairs asked for are compared, so the result is as large as the request.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from docassay.functions import text as tx
from docassay.functions.phrasing import percent
from docassay.functions.rows import explode_rows, explode_values


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint, joins know its size in bytes."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


WORD = "[a-z0-9+#]+"
_WORD = re.compile(f"({WORD})")
#: Bits of a vocabulary's table (4 MB), keys whose bits a task remembers, rows a task hands on together.
SLOTS, REMEMBERED, TOGETHER = 1 << 25, 1 << 20, 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Terms by their join keys, and what a text must be cut into to meet them."""

    #: ``(key, placed, term, step, steps, lead, trail)``; a key that is not placed proves its term.
    keys: DataFrame
    #: Longest stretch of signs within a term; lengths of the terms of signs alone.
    signs: int
    sign_terms: tuple[int, ...]
    #: Whether terms are to be met by position: single words with signs around them, word pairs.
    words: bool
    pairs: bool
    #: Bit tables of the keys that prove a term, of those met by position and of the words that word pairs begin with.
    bits: tuple[np.ndarray, ...]


def vocabulary(terms: DataFrame) -> Vocabulary:
    """Distinct terms with the keys that texts are joined on; an empty term stands nowhere.

    Reads the terms once, and their keys for the few figures that the texts' side depends on. Only the
    lengths of terms made of signs alone and bit tables of fixed size reach the driver.
    """
    t = F.col("term")
    cut = terms.select("term").distinct().filter("term <> ''").select(
        "term", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"), F.split(t, WORD, -1).alias("s")
    )
    cut = cut.withColumns({"lead": F.get("s", F.lit(0)), "trail": F.element_at("s", -1), "n": F.size("w")})
    outer = (F.col("lead") != "") | (F.col("trail") != "")
    proof = (F.col("n") == 0) | ((F.col("n") <= 2) & ~outer)
    steps = F.when(F.col("n") == 1, F.array(F.get("w", F.lit(0)))).otherwise(
        F.transform(
            tx.between(F.col("w"), F.lit(0), F.col("n") - 2),
            lambda w, i: F.concat(w, F.get("s", i + 1), F.get("w", i + 1)),
        )
    )
    placed = F.when(proof, F.array(t)).otherwise(steps)
    keys = stored(
        cut.select(
            "term", "lead", "trail", "n", (~proof).alias("placed"), F.array_max(F.transform("s", F.length)).alias("signs"),
            F.posexplode(placed).alias("step", "key"), F.size(placed).alias("steps"),
        ),
        "vocabulary",
    )
    by_place, alone = F.col("placed"), F.col("n") == 0
    signs, words, pairs, lengths = keys.agg(
        F.max("signs"), F.bool_or(by_place & (F.col("n") == 1)), F.bool_or(by_place & (F.col("n") > 1)),
        F.collect_set(F.when(alone, F.length("term"))),
    ).first()
    heads = keys.filter("n > 1").select(F.regexp_extract("key", WORD, 0).alias("key"))
    return Vocabulary(
        keys.select("key", "placed", "term", "step", "steps", "lead", "trail"), int(signs or 0), tuple(sorted(lengths)), bool(words), bool(pairs),
        (bit_table(keys.filter("not placed")), bit_table(keys.filter("placed")), bit_table(heads)),
    )


def bit_table(keys: DataFrame) -> np.ndarray:
    """Which slots the keys' checksums fall into, one bit each: as large for any number of keys.

    A text's key whose bit is not set is in no vocabulary row; one whose bit is set goes on to the join.
    """
    slot = F.crc32(F.col("key").cast("binary")) % SLOTS + 1
    rows = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    table = np.zeros(SLOTS // 8, np.uint8)
    for bucket, bits in rows.collect():
        table[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return table


class Known(dict):
    """Whether a key's bit is set, remembered for the keys met lately."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tobytes()

    def __missing__(self, key: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        slot = zlib.crc32(key.encode("utf-8", "replace")) % SLOTS
        self[key] = bit = self.table[slot >> 3] >> (slot & 7) & 1
        return bit


def sign_parts(s: list[str], length: int) -> set[str]:
    """Parts of the text's stretches of signs, of the given length, that no word or left dot touches.

    Of a stretch, its ends count as touched by a word unless they are the text's own ends.
    """
    out, last = set(), len(s) - 1
    for signs, opens, ends in {(x, i == 0, i == last) for i, x in enumerate(s)}:
        count = len(signs) - length + 1
        out.update(
            signs[o : o + length] for o in range(count) if (signs[o - 1] != "." if o else opens) and (o < count - 1 or ends)
        )
    return out


def text_keys(text: str, vocab: Vocabulary, sure: Known, by_place: Known, heads: Known) -> Iterator[tuple[str, int, str, str]]:
    """``(key, place, left, right)`` of a lower-case text, but for keys that are surely in no vocabulary row.

    Every distinct word is looked up once; only word pairs whose first word begins one of the
    vocabulary's are put together.
    """
    cut, most = _WORD.split(text), vocab.signs
    s, w = cut[::2], cut[1::2]
    last, distinct = len(w) - 1, set(w)
    begin, prove = {x for x in distinct if heads[x]}, {x for x in distinct if sure[x]}
    pairs = [
        (i, x + s[i + 1] + w[i + 1]) for i, x in enumerate(w) if x in begin and i < last and len(s[i + 1]) <= most
    ]
    keys = {x for x, signs in zip(w, s) if x in prove and not signs.endswith(".")}
    keys.update(key for i, key in pairs if not s[i].endswith(".") and sure[key])
    for length in vocab.sign_terms:
        keys.update(key for key in sign_parts(s, length) if sure[key])
    for key in keys:
        yield key, -1, "", ""
    placed = [(i, i, key) for i, key in enumerate(w) if by_place[key]] if vocab.words else []
    if vocab.pairs:
        placed += [(i, i + 1, key) for i, key in pairs if by_place[key]]
    for i, end, key in placed:
        left, right = ("w" if i else "") + s[i], s[end + 1] + ("w" if end < last else "")
        yield key, i, left[-most - 1 :], right[: most + 1]


def doc_keys(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(doc_id, key, place, left, right)``: what a text holds, cut as the vocabulary needs it.

    ``place`` is -1 for keys that prove a term; these are distinct within a text. ``left`` and
    ``right`` are the signs around a placed key, as many as a term can have and one character more;
    a word beyond them counts as that character. Keys that the vocabulary's bit tables rule out are
    dropped where they are cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab.bits)
    bare = replace(vocab, keys=None, bits=())
    names = ("key", "place", "left", "right")
    types = (pa.string(), pa.int32(), pa.string(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Known(table) for table in shared.value]

        def out(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), types, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=["doc_id", *names])

        for batch in batches:
            ids, at, rows = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                found = list(text_keys(text.as_py(), bare, *known)) if text.is_valid else []
                rows += found
                at += [i] * len(found)
                if len(rows) >= TOGETHER:
                    yield out(ids, at, rows)
                    at, rows = [], []
            if rows:
                yield out(ids, at, rows)

    schema = StructType([docs.schema["doc_id"], *(StructField(n, IntegerType() if n == "place" else StringType()) for n in names)])
    return docs.select("doc_id", F.lower("text").alias("cut")).mapInArrow(cut, schema)


def doc_terms(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(doc_id, term)`` for every vocabulary term that stands in a document, as a whole.

    Spark picks the join by the vocabulary's size in bytes; with a broadcast, documents' keys never
    move. Null and empty texts hold no term but those that an empty text has room for, none.
    """
    found = doc_keys(docs, vocab).withColumn("placed", F.col("place") >= 0).join(vocab.keys, ["key", "placed"])
    if not (vocab.words or vocab.pairs):
        return found.select("doc_id", "term").distinct()
    hits = checkpoint(found)  # read twice below, and small: only keys of the vocabulary
    before = F.left("left", F.length("left") - F.length("lead"))
    beyond = F.substr("right", F.length("trail") + 1)
    starts = (F.col("step") > 0) | (F.endswith("left", F.col("lead")) & ~before.rlike(r"[a-z0-9+#.]\z"))
    stops = (F.col("step") < F.col("steps") - 1) | (F.startswith("right", F.col("trail")) & ~beyond.rlike("^[a-z0-9+#]"))
    rows = hits.filter(F.col("placed") & starts & stops)
    met = rows.groupBy("doc_id", "term", (F.col("place") - F.col("step")).alias("start")).agg(
        F.count("*").alias("n"), F.first("steps").alias("steps")
    ).filter("n = steps")
    return hits.filter("not placed").select("doc_id", "term").union(met.select("doc_id", "term")).distinct()


def match_postings(docs: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(doc_id, posting_id, rank, term, cnt, is_skill, matched)`` for every pair asked for.

    ``terms`` is the long form of the mined postings, ``pairs`` is ``(doc_id, posting_id)``.
    The last join is on document and term together: a document or a posting in a third of the
    pairs spreads over its terms, and the looked-up side holds each key once. A pair whose posting
    has no terms keeps one row, with a null term.
    """
    terms = stored(terms, "posting-terms")
    present = doc_terms(docs, vocabulary(terms)).withColumn("matched", F.lit(True))
    wanted = pairs.join(terms, "posting_id", "left")
    return wanted.join(present, ["doc_id", "term"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def match_postings_naive(docs: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reference plan: every pair carries the text and tests every term that it contains by regex.

    The pattern of a row is compiled for it, so the plain search goes first; it settles nearly all rows.
    """
    escaped = F.regexp_replace("term", r"([^a-z0-9 ])", r"\\$1")
    pattern = F.concat(F.lit("(^|[^a-z0-9+#.])"), escaped, F.lit("($|[^a-z0-9+#])"))
    wanted = pairs.join(terms, "posting_id", "left").join(
        docs.select("doc_id", F.lower("text").alias("lower")), "doc_id"
    )
    there = F.contains("lower", F.col("term")) & F.regexp_like("lower", pattern)
    return wanted.withColumn("matched", F.coalesce(there, F.lit(False))).drop("lower")


def match_report(matches: DataFrame) -> DataFrame:
    """Coverage and ordered term lists per pair; at most ``k`` rows meet in one group.

    A pair whose posting has no terms is reported with zeros, empty lists and ``compared`` false.
    """
    m, s = F.col("matched"), F.col("is_skill")

    def listed(test: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(test, F.struct("rank", "term"))))
        return F.array_join(F.transform(rows, lambda x: x["term"]), ", ")

    return matches.groupBy("doc_id", "posting_id").agg(
        F.count("term").cast("int").alias("n_terms"),
        (F.count("term") > 0).alias("compared"),
        F.count_if(m).cast("int").alias("n_matched"),
        percent(F.count_if(m), F.count("term")).alias("coverage"),
        percent(F.count_if(m & s), F.count_if(s)).alias("skill_coverage"),
        listed(m).alias("matched"),
        listed(~m).alias("missing"),
    )


def dict_match(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Inner join of distinct tokens with a dictionary ``(token, ...)``."""
    return tokens.join(dictionary, "token")


def demonstrated(graded: DataFrame) -> DataFrame:
    """``(doc_id, term, shown)``: the listed terms, and whether the evidence has them; within the row."""

    def marked(terms: str, shown: bool) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(shown).alias("shown")))

    return explode_rows(graded, ["doc_id"], F.concat(marked("s_shown", True), marked("s_unbacked", False)))


def pair_up(docs: DataFrame, n_postings: int, per_doc: int) -> DataFrame:
    """A request table: each document with ``per_doc`` postings numbered from 0."""
    turns = F.sequence(F.lit(0), F.lit(min(per_doc, n_postings) - 1))
    step = max(1, n_postings // per_doc)
    ids = F.transform(turns, lambda i: (F.col("doc_id") * 7 + i * step) % n_postings)
    return explode_values(docs.select("doc_id", ids.alias("ids")), ["doc_id"], "ids", "posting_id")


