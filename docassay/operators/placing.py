"""Rows of text of pages of placed fragments, worked out on whole columns of many pages at once.

On the map side the fragments of a page become one compressed block, so a page and not a fragment is
what a shuffle moves. Blocks meet by page, and rows, their order and their clusters come out of a few
sorts over some pages at a time. Spark's order holds: nulls first, NaN last, 0.0 equal to -0.0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docassay.functions.patterns import re2

#: Fragments that are cut into blocks, or worked out, at a time; a page is never split when it is worked out.
AT_ONCE = 1 << 17
NUMBERS = ("page_width", "x", "right", "y", "size")
#: Bytes of a fragment in a block: five numbers, its place, the length of its text, what is null.
WIDTH = 8 * (len(NUMBERS) + 1) + 4 + 1
_HEAD = struct.Struct("<QQ")
_LEAST = np.iinfo(np.int64).min
#: A word with a letter or digit, from the first of these on.
_WORD = re2(r"[A-Za-z0-9]\S*")

_CLUSTER = pa.struct([("x", pa.float64()), ("right", pa.float64()), ("words", pa.int32())])
_ROW = pa.struct(
    [*[(k, pa.float64()) for k in ("anchor", "page_width", "y", "x", "right", "size")], ("text", pa.string()), ("chars", pa.int32()), ("clusters", pa.list_(_CLUSTER))]
)
#: What documents need of a row: ``wide`` and ``filled`` are its clusters of enough words to be a column, and of any.
_BRIEF = pa.struct([("page_width", pa.float64()), ("x", pa.float64()), ("text", pa.string()), *[(k, pa.int32()) for k in ("chars", "wide", "filled")]])
BRIEF_ROWS = "array<struct<page_width:double,x:double,text:string,chars:int,wide:int,filled:int>>"
#: Words of a cluster that may be a column, and of one that is a cell.
COLUMN_WORDS, CELL_WORDS = 3, 1
#: The full type for Spark.
ROWS = (
    "array<struct<anchor:double,page_width:double,y:double,x:double,right:double,size:double,text:string,chars:int,"
    "clusters:array<struct<x:double,right:double,words:int>>>>"
)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where null, and where they are null."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), none


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, page, block)`` of batches ``(doc_id, page, numbers, ord, text)``, the numbers being :data:`NUMBERS`.

    A page has a block for every run of :data:`AT_ONCE` or so fragments that holds some of it.
    """
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield _blocks(held)
            held, rows = [], 0
    if rows:
        yield _blocks(held)


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    batch = table.to_batches(max_chunksize=table.num_rows)[0]
    codes = [batch.column(k).dictionary_encode() for k in ("doc_id", "page")]
    key = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
    if (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        batch, key = batch.take(pa.array(order)), key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = len(key)
    cells = np.empty((n, WIDTH), np.uint8)
    nulls = np.zeros(n, np.uint8)
    values, none = _numbers(batch.column("numbers").flatten())
    cells[:, : 8 * len(NUMBERS)] = np.ascontiguousarray(values, np.float64).view(np.uint8).reshape(n, -1)
    for i in range(len(NUMBERS)):
        nulls |= none[i :: len(NUMBERS)].astype(np.uint8) << i
    values, none = _numbers(batch.column("ord"))
    cells[:, 8 * len(NUMBERS) : -5] = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(n, 8)
    nulls |= none.astype(np.uint8) << len(NUMBERS)
    text = batch.column("text")
    nulls |= text.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 6
    bare = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(bare.buffers()[1], np.int64)[bare.offset : bare.offset + n + 1]
    letters = memoryview(bare.buffers()[2] or b"")
    cells[:, -5:-1] = np.diff(offsets).astype("<u4").view(np.uint8).reshape(n, 4)
    cells[:, -1] = nulls
    codec, blocks = pa.Codec("zstd", 1), []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n]):
        raw = cells[a:b].T.tobytes() + letters[int(offsets[a]) : int(offsets[b])].tobytes()
        blocks.append(_HEAD.pack(b - a, len(raw)) + codec.compress(raw, asbytes=True))
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page").take(at), pa.array(blocks, pa.binary())], ["doc_id", "page", "block"])


def group_anchors(key: np.ndarray, values: np.ndarray, tol: float) -> np.ndarray:
    """First value of the group of each value; ``values`` go down within equal ``key``, which stand side by side.

    A value joins the group while it lies within ``tol`` of the group's first value (not of its neighbour).
    All keys are walked through at once, value by value.
    """
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    out, size = values.copy(), np.diff(begin, append=len(key))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    anchor = values[begin].copy()
    left = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k in range(1, len(left)):
        at = begin[: left[k]] + k
        v, now = values[at], anchor[: left[k]]
        near = (now - v <= tol) | (np.isnan(now) & np.isnan(v)) | (now == v)
        anchor[: left[k]] = np.where(near, now, v)
        out[at] = anchor[: left[k]]
    return out


def anchors_of(lists: pa.Array, tol: float) -> pa.Array:
    """For every list of distinct numbers: its ``(value, anchor)``."""
    flat = lists.flatten().to_numpy(zero_copy_only=False) + 0.0
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((~_sortable(flat), key))
    pairs = pa.StructArray.from_arrays([pa.array(flat[order]), pa.array(group_anchors(key, flat[order], tol))], ["value", "anchor"])
    return pa.ListArray.from_arrays(_offsets(sizes), pairs)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _sortable(values: np.ndarray, none: np.ndarray | None = None) -> np.ndarray:
    """Whole numbers in the order of ``values``: nulls first, NaN last."""
    plain = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(plain).view(np.int64)
    bits = np.where(np.isnan(plain), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
    return bits if none is None else np.where(none, _LEAST, bits)


def _above(a: np.ndarray, b) -> np.ndarray:
    """``a > b``, NaN being above all other values."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def rows_of_pages(batches: Iterator[pa.RecordBatch], *cuts: float) -> Iterator[pa.RecordBatch]:
    """``(doc_id, page, rows)`` of ``(doc_id, page, blocks)``, some pages at a time."""
    for batch in batches:
        blocks = batch.column("blocks")
        sizes, flat, at, start, held = pc.list_value_length(blocks).to_pylist(), blocks.flatten(), 0, 0, _Held()
        for i, size in enumerate(sizes):
            held.add([flat[k].as_buffer() for k in range(at, at + size)])
            at += size
            if held.n >= AT_ONCE or i + 1 == len(sizes):
                keys = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([keys.column("doc_id"), keys.column("page"), held.rows(*cuts)], ["doc_id", "page", "rows"])
                start, held = i + 1, _Held()


def pages_of_documents(batches: Iterator[pa.RecordBatch], *cuts: float) -> Iterator[pa.RecordBatch]:
    """``(doc_id, pages)`` of ``(doc_id, parts)``, some documents at a time.

    Parts are ``(page, listed, block)`` in the order of their pages; pages ``(page, listed, rows)`` are
    those listed at least once.
    """
    for batch in batches:
        parts = batch.column("parts")
        sizes, flat = pc.list_value_length(parts).to_pylist(), parts.flatten()
        page, listed, block = (flat.field(k) for k in ("page", "listed", "block"))
        names, times, full = page.to_pylist(), listed.to_pylist(), block.is_valid().to_pylist()
        at, start, held, first, often, counts = 0, 0, _Held(), [], [], []
        for i, size in enumerate(sizes):
            ends, before = at + size, len(first)
            while at < ends:
                begin, own, n = at, [], 0
                while at < ends and names[at] == names[begin]:
                    n += times[at]
                    if full[at]:
                        own.append(block[at].as_buffer())
                    at += 1
                if n:
                    held.add(own)
                    first.append(begin)
                    often.append(n)
            counts.append(len(first) - before)
            if held.n >= AT_ONCE or i + 1 == len(sizes):
                found = pa.StructArray.from_arrays([page.take(pa.array(first, pa.int64())), pa.array(often, pa.int32()), held.rows(*cuts, brief=True)], ["page", "listed", "rows"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, i + 1 - start), pa.ListArray.from_arrays(_offsets(counts), found)], ["doc_id", "pages"])
                start, held, first, often, counts = i + 1, _Held(), [], [], []


class _Held:
    """Blocks of the next pages, and how many fragments they have."""

    def __init__(self) -> None:
        self.pages, self.n = [], 0

    def add(self, blocks: list[pa.Buffer]) -> None:
        self.pages.append(blocks)
        self.n += sum(_HEAD.unpack_from(b)[0] for b in blocks)

    def rows(self, *cuts: float, brief: bool = False) -> pa.Array:
        return _rows(self.pages, *cuts, brief)


def _unpack(pages: list[list[pa.Buffer]]):
    codec, cells, texts, key = pa.Codec("zstd"), [], [], []
    for page, own in enumerate(pages):
        for block in own:
            n, size = _HEAD.unpack_from(block)
            raw = codec.decompress(block.slice(_HEAD.size), size)
            cells.append(np.frombuffer(raw, np.uint8, n * WIDTH).reshape(WIDTH, n))
            texts.append(memoryview(raw)[n * WIDTH :])
            key.append((page, n))
    every = np.concatenate(cells, axis=1) if cells else np.empty((WIDTH, 0), np.uint8)
    n = every.shape[1]
    words = np.ascontiguousarray(every[:-5].reshape(-1, 8, n).transpose(0, 2, 1)).view(np.int64)[:, :, 0]
    lengths = np.ascontiguousarray(every[-5:-1].T).view("<u4")[:, 0]
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))
    if (every[-1] >> 6).any():
        text = pc.if_else(pa.array((every[-1] >> 6).astype(bool)), pa.scalar(None, pa.large_string()), text)
    col = {k: words[i].view(np.float64) for i, k in enumerate(NUMBERS)} | {"ord": words[-1]}
    none = {k: (every[-1] >> i & 1).astype(bool) for i, k in enumerate((*NUMBERS, "ord", "text"))}
    return np.repeat([p for p, _ in key], [n for _, n in key]).astype(np.int64), col, none, text


def _largest(values: np.ndarray, none: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Largest value from each of ``begin`` up to the next, NaN above all, null where all are."""
    if not len(begin):
        return pa.array([], pa.float64())
    low = np.where(none, -np.inf, values)
    return pa.array(np.maximum.reduceat(low, begin), mask=np.minimum.reduceat(none, begin))


def _rows(pages: list[list[pa.Buffer]], tol: float, column_gap: float, word_gap: float, brief: bool) -> pa.Array:
    page, col, none, text = _unpack(pages)
    n = len(page)
    y = col["y"] + 0.0
    down = np.lexsort((~_sortable(y), page))
    # The distinct baselines of each page, from top to bottom, decide the rows.
    key, base = page[down], y[down]
    fresh = np.concatenate(([True], (np.diff(key) != 0) | ~((base[1:] == base[:-1]) | (np.isnan(base[1:]) & np.isnan(base[:-1])))))[:n]
    found = group_anchors(key[fresh], base[fresh], tol)
    which = np.cumsum(fresh) - 1
    starts = np.concatenate(([True], (np.diff(key[fresh]) != 0) | ~((found[1:] == found[:-1]) | (np.isnan(found[1:]) & np.isnan(found[:-1])))))[: len(found)]
    row = np.empty(n, np.int64)
    row[down] = (np.cumsum(starts) - 1)[which] if n else which
    anchor = found[starts]

    keys = [_sortable(col["x"], none["x"]), _sortable(-y)]
    keys += [np.where(none["ord"], _LEAST, col["ord"]), _sortable(col["right"], none["right"]), _sortable(col["size"], none["size"])]
    order = np.lexsort((*keys[::-1], row))
    order = _by_text(order, [row, *keys], none["text"], text)
    row, col, none = row[order], {k: v[order] for k, v in col.items()}, {k: v[order] for k, v in none.items()}
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(begin, append=n)
    opening = np.zeros(n, bool)
    opening[begin] = True

    x, right, width = col["x"], col["right"], col["page_width"][begin][row]
    gap = x - np.concatenate(([0.0], right[:-1]))[:n]
    known = ~opening & ~none["x"] & ~np.concatenate(([False], none["right"][:-1]))[:n]
    wide = known & ~none["page_width"][begin][row] & _above(gap, width * column_gap)
    blank = wide | (known & _above(gap, word_gap))
    lead = pa.array(["", " "], pa.large_string()).take(pa.array(blank.astype(np.int8)))
    pieces = pc.fill_null(pc.binary_join_element_wise(lead, text.take(pa.array(order)), pa.scalar("", pa.large_string())), "")

    cluster = np.flatnonzero(opening | wide)
    words = pc.count_substring_regex(_joined(pieces, cluster, n), _WORD).cast(pa.int32())
    clusters = pa.StructArray.from_arrays([pa.array(x[cluster], mask=none["x"][cluster]), _largest(right, none["right"], cluster), words], type=_CLUSTER)
    per_row = np.bincount(row[cluster], minlength=len(begin))

    sized = np.lexsort((_sortable(col["size"]), none["size"], row))
    middle = begin + count // 2
    size = col["size"][sized][np.minimum(middle, max(n - 1, 0))] if n else np.empty(0)
    given = np.add.reduceat((~none["size"]).astype(np.int64), begin) if n else np.empty(0, np.int64)
    per_page = _offsets(np.bincount(key[fresh][starts], minlength=len(pages)))
    texts, chars = _joined(pieces, begin, n).cast(pa.string()), _plain_chars(pieces, begin, n)
    if brief:
        enough = [words.to_numpy(zero_copy_only=False) >= k for k in (COLUMN_WORDS, CELL_WORDS)]
        counts = [pa.array(np.bincount(row[cluster][e], minlength=len(begin)).astype(np.int32)) for e in enough]
        width_x = [pa.array(col[k][begin], mask=none[k][begin]) for k in ("page_width", "x")]
        return pa.ListArray.from_arrays(per_page, pa.StructArray.from_arrays([*width_x, texts, chars, *counts], type=_BRIEF)).cast(pa.list_(_BRIEF))
    rows = pa.StructArray.from_arrays(
        [
            pa.array(anchor), pa.array(col["page_width"][begin], mask=none["page_width"][begin]), pa.array(col["y"][begin]),
            pa.array(x[begin], mask=none["x"][begin]), _largest(right, none["right"], begin), pa.array(size, mask=count // 2 >= given),
            texts, chars, pa.ListArray.from_arrays(_offsets(per_row), clusters),
        ],
        type=_ROW,
    )
    return pa.ListArray.from_arrays(per_page, rows).cast(pa.list_(_ROW))


def _joined(pieces: pa.Array, begin: np.ndarray, n: int) -> pa.Array:
    """The texts from each of ``begin`` up to the next as one; they lie side by side already."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + n + 1] if n else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.ascontiguousarray(offsets[np.append(begin, n)])), pieces.buffers()[2])


def _plain_chars(pieces: pa.Array, begin: np.ndarray, n: int) -> pa.Array:
    """Characters but blanks of rows of plain ASCII words with single blanks between them, null for all others."""
    if not n:
        return pa.array([], pa.int32())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + n + 1]
    edges = offsets[np.append(begin, n)]
    letters = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: edges[-1]]
    blank = letters == 32
    odd = (letters < 32) | (letters > 126)
    odd[1:] |= blank[1:] & blank[:-1]
    odds, blanks = (np.concatenate(([0], np.cumsum(flags))) for flags in (odd, blank))
    first, last = edges[:-1], edges[1:]
    some = last > first
    ends = np.zeros(len(begin), bool)
    ends[some] = blank[first[some]] | blank[last[some] - 1]
    chars = (last - first) - (blanks[last] - blanks[first])
    return pa.array(chars.astype(np.int32), mask=(odds[last] > odds[first]) | ends)


def _by_text(order: np.ndarray, keys: list[np.ndarray], none: np.ndarray, text: pa.Array) -> np.ndarray:
    """``order`` with fragments that are equal in all ``keys`` sorted by the bytes of their texts."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= np.diff(k[order]) == 0
    if not same.any():
        return order
    order, edge = order.copy(), np.diff(np.concatenate(([0], same, [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        order[a : b + 1] = sorted(order[a : b + 1].tolist(), key=lambda i: (not none[i], b"" if none[i] else text[i].as_buffer().to_pybytes()))
    return order
