"""Stretches of a fixed width that repeat across documents, found exactly without shipping each one.

Every stretch (a window) has an anchor that depends on its content alone. Consecutive windows with
the same anchor travel as one packed string to the bucket of that anchor, where sorting brings equal
windows together. What a window needs to know is only the least doc_id that holds it.

Hashes find candidates only; whether two stretches are equal is always decided on their bytes.

Two shuffles: packed strings to buckets, then marks of repeated windows together with the documents to
blocks of documents. Rows are compressed blocks of arrays, so their number follows tasks times buckets
and not windows.

Skew. A task sends each distinct packed string once, for its least doc_id: copies in the same piece
of input are resolved on the spot. An anchor whose strings would fill a bucket is hot: its windows
are sent one by one, to buckets by their own content, so that a passage shared by a third of all
documents fills no bucket. Hot anchors are found by the bytes of their strings in a sample of documents,
which only chooses routes; results do not depend on it. In a bucket, memory is bounded by working on
``CHUNK_BYTES`` of strings and ``PORTION`` windows at a time, also within one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import Rolling, byte_codes, flat_ranges, gather, give_back, joined, pieces, utf8, word_spans

WIDTH = 50
FLUSH_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
EVEN_BUCKETS = 256  # beyond so many, buckets grow, up to
WIDEST = 4  # times BUCKET_BYTES
SLICES = 48  # of BUCKET_BYTES; a slice's number is one byte
CHUNK_BYTES = 1 << 20
PORTION = 1 << 19
BLOCK_BYTES = 2 << 20
SAMPLE_DOCUMENTS = 20_000
SAMPLE_SHARE = 0.001
ROWS_AT_ONCE = 16
STRING_MORE = 20  # bytes of a packed string beside its text

_NOT_SPACE = np.arange(256) != 0x20


@dataclass
class Symbols:
    """Texts as sequences of coded symbols: words or bytes. Symbol i is ``data[starts[i]:ends[i]]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # of the n+1 texts, in symbols
    codes: np.ndarray


def _words_of(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    starts, ends, cuts = word_spans(data, offsets, _NOT_SPACE)
    return Symbols(data, starts, ends, cuts, Rolling(byte_codes(0)[data]).stretches(starts, ends))


def _bytes_of(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    place = np.arange(len(data) + 1, dtype=np.int32 if len(data) < 2**31 - 1 else np.int64)
    return Symbols(data, place[:-1], place[1:], offsets, byte_codes(0)[data])


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D."""
    return text.split()


@dataclass(frozen=True)
class Method:
    """How texts become symbols, and how each window gets its anchor."""

    normalise: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    symbols: Callable[..., Symbols]
    anchors: Callable[[Rolling, int], np.ndarray]  # by window start, for windows of a width
    growth: float  # packed bytes for each byte of text, roughly
    piece_bytes: int  # text worked on at a time
    level: int = 3  # of compression of packed strings


def as_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, with one space between."""
    raw = data.tobytes()
    return joined([b" ".join(split_words(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])


def unchanged(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    """One for each level and worker: making its tables anew costs more than compressing a small block."""
    return zstandard.ZstdCompressor(level=level)


def _pack(arrays: list[np.ndarray], text: np.ndarray | None = None, level: int = 3) -> bytes:
    """Arrays of one length, the first as differences, and a text after them.

    The first bytes of all numbers lie together, then the second ones and so on: many compress to nothing.
    """
    parts = [np.array([len(arrays[0]), 0 if text is None else len(text)], np.int64).tobytes()]
    for a in (np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]):
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    if text is not None:
        parts.append(text.tobytes())
    return _compressor(level).compress(b"".join(parts))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0])
    return [*out, np.frombuffer(raw, np.uint8, size, at)]


_PACKED = [np.int64, np.int32, np.int32, np.int32, np.uint8]  # doc_id, first window, windows, bytes, slice
_MARKS = [np.int64, np.int32, np.int32]  # doc_id, first window, windows


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int32()] * (len(columns) - 1) + [pa.binary()]
    names = ["bucket", "block", "blob"][-len(columns) :]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


@dataclass
class _Runs:
    """Windows [at, at + count) of a text that share an anchor; ``at`` counts symbols of the piece."""

    at: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # symbol where the text begins
    content: np.ndarray  # hash of all symbols of the windows

    def take(self, which: np.ndarray) -> _Runs:
        return _Runs(*(x[which] for x in vars(self).values()))

    def marks(self) -> list[np.ndarray]:
        return [self.doc, (self.at - self.first).astype(np.int32), self.count.astype(np.int32)]


def _runs(symbols: Symbols, rolling: Rolling, ids: np.ndarray, known: np.ndarray, method: Method, width: int) -> _Runs:
    n = np.diff(symbols.offsets)
    windows = np.where(known, np.maximum(n - width + 1, 0), 0)
    at = flat_ranges(symbols.offsets[:-1], windows)
    if not len(at):
        none = np.zeros(0, np.int64)
        return _Runs(none, none, none.astype(np.uint64), none, none, none.astype(np.uint64))
    anchor = method.anchors(rolling, width)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    new[np.cumsum(windows)[:-1][windows[1:] > 0]] = True
    begin = np.flatnonzero(new)
    row = np.searchsorted(symbols.offsets, at[begin], "right") - 1
    count = np.diff(np.append(begin, len(at)))
    content = rolling.stretches(at[begin], at[begin] + count + width - 1)
    return _Runs(at[begin], count, anchor[begin], ids[row], symbols.offsets[row], content)


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive stretches of about ``most`` in sum, of one item at least."""
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield slice(a, b)


def same_bytes(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the stretches [start, end) of ``a`` and ``b``, none of them empty, hold the same bytes, pair by pair."""
    sizes = a[1] - a[0]
    equal = sizes == b[1] - b[0]
    at = np.flatnonzero(equal)
    for part in _portions(sizes[at], CHUNK_BYTES):
        own = at[part]
        differs = gather(data, a[0][own], a[1][own]) != gather(data, b[0][own], b[1][own])
        if differs.any():
            begin = np.cumsum(sizes[own]) - sizes[own]
            equal[own[np.logical_or.reduceat(differs, begin)]] = False
    return equal


def _repeats_earlier(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which strings [begin, end) also stand in a smaller doc_id among these; all their windows repeat.

    A string that only shares the hash of another is no repeat of it and stays.
    """
    later = np.zeros(len(doc), bool)
    if not len(doc):
        return later
    order = np.lexsort((doc, anchor, content))
    new = np.ones(len(order), bool)
    new[1:] = (content[order[1:]] != content[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    first = order[new][np.cumsum(new) - 1]
    after = doc[order] > doc[first]
    which, least = order[after], first[after]
    later[which] = same_bytes(data, (begin[which], end[which]), (begin[least], end[least]))
    return later


def _bounds(symbols: Symbols, runs: _Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
    return symbols.starts[runs.at].astype(np.int64), symbols.ends[runs.at + runs.count + width - 2].astype(np.int64)


def _once(symbols: Symbols, runs: _Runs, width: int) -> tuple[_Runs, _Runs]:
    """Those that hold the least doc_id of their content, and the others."""
    later = _repeats_earlier(symbols.data, *_bounds(symbols, runs, width), runs.doc, runs.anchor, runs.content)
    return runs.take(~later), runs.take(later)


def _one_by_one(runs: _Runs, rolling: Rolling, width: int) -> _Runs:
    """Each window as a run of its own, with its content as its anchor."""
    at = flat_ranges(runs.at, runs.count)
    each = lambda x: np.repeat(x, runs.count)
    content = rolling.stretches(at, at + width)
    return _Runs(at, np.ones(len(at), np.int64), content, each(runs.doc), each(runs.first), content)


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("_id")
    known = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def _grouped(groups: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)]):
        if b > a:
            yield int(groups[a]), [x[order[a:b]] for x in arrays]


def _block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (np.mod(doc, 0x7FFFFFFF) * 2654435761 >> 20) % blocks


def _block_column(doc: str, text: str, blocks: int) -> Column:
    """The same as a column; documents without an id are dealt out by their text."""
    spread = F.shiftright(F.pmod(F.col(doc), F.lit(0x7FFFFFFF)) * F.lit(2654435761), 20)
    return F.pmod(F.coalesce(spread, F.xxhash64(text)), F.lit(blocks)).cast("int")


def fan_out(packed: float) -> tuple[int, int]:
    """Buckets for so many packed bytes, and the slices of each.

    Every flush of every task makes a block for each bucket, so with more buckets the blocks get smaller
    and many. Buckets therefore grow before their number does; slices keep their size.
    """
    wide = min(WIDEST, max(1, ceil(packed / BUCKET_BYTES / EVEN_BUCKETS)))
    return ceil(packed / BUCKET_BYTES / wide) or 1, SLICES * wide


def _send(method: Method, width: int, buckets: int, slices: int, blocks: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, "_text", method.piece_bytes):
            ids, known = _documents(batch)
            symbols = method.symbols(*method.normalise(*utf8(batch.column("_text"))))
            rolling = Rolling(symbols.codes)
            runs, repeated = _once(symbols, _runs(symbols, rolling, ids, known, method, width), width)
            marks = [repeated.marks()]
            if len(hot):
                is_hot = np.isin(runs.anchor, hot)
                if is_hot.any():
                    single, repeated = _once(symbols, _one_by_one(runs.take(is_hot), rolling, width), width)
                    marks.append(repeated.marks())
                    runs = runs.take(~is_hot)
                    runs = _Runs(*(np.concatenate(x) for x in zip(vars(runs).values(), vars(single).values())))
            begin, end = _bounds(symbols, runs, width)
            held.append((symbols.data, begin + size, end + size, runs.content, runs.anchor, *runs.marks(), marks))
            size += len(symbols.data)
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        texts, *columns, marks = zip(*held)
        data = np.concatenate(texts)
        columns = [np.concatenate(c) for c in columns]
        begin, end, content, anchor, doc = columns[:5]
        later = _repeats_earlier(data, begin, end, doc, anchor, content)
        marks = [*(m for each in marks for m in each), [c[later] for c in columns[4:]]]
        begin, end, _, anchor, doc, first, count = (c[~later] for c in columns)
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        part = (anchor // np.uint64(buckets) % np.uint64(slices)).astype(np.uint8)
        order = np.lexsort((part, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        out: list[tuple[int, int, bytes]] = []
        for b, (i, k) in enumerate(zip(cuts, cuts[1:])):
            if k > i:
                own = order[i:k]
                text = gather(data, begin[own], end[own])
                out.append((b, -1, _pack([doc[own], first[own], count[own], (end - begin)[own].astype(np.int32), part[own]], text, method.level)))
        joint = [np.concatenate(x) for x in zip(*marks)]
        out += [(block % buckets, block, _pack(x)) for block, x in _grouped(_block_of(joint[0], blocks), joint)]
        for i in range(0, len(out), ROWS_AT_ONCE):
            yield _blobs(out[i : i + ROWS_AT_ONCE])
        give_back()

    return run


def _perhaps_equal(prints: np.ndarray) -> np.ndarray:
    """Places of all prints that occur more than once, and of few others.

    The low bits of a print give way to its place, so that one plain sort of numbers does.
    """
    low = np.uint64(max(len(prints) - 1, 1).bit_length())
    keys = (prints >> low << low) | np.arange(len(prints), dtype=np.uint64)
    keys.sort()
    high = keys >> low
    same = high[1:] == high[:-1]
    meets = np.zeros(len(keys), bool)
    meets[1:] |= same
    meets[:-1] |= same
    return (keys[meets] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def _least_holders(prints: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose print also stands in a smaller doc_id, and for each the first window of the least one.

    Windows are taken a portion of the prints at a time; those of a print that occurs once are set aside.
    """
    portions = -(-len(prints) // PORTION)
    found, holder = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(portions):
        own = np.flatnonzero(prints % np.uint64(portions) == k) if portions > 1 else np.arange(len(prints))
        own = own[_perhaps_equal(prints[own])]
        if len(own):
            own = own[np.lexsort((doc[own], prints[own]))]
            new = np.concatenate(([True], prints[own[1:]] != prints[own[:-1]]))
            first = own[new][np.cumsum(new) - 1]
            after = doc[own] > doc[first]
            found.append(own[after]), holder.append(first[after])
    return np.concatenate(found), np.concatenate(holder)


def _equal_windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray, window: np.ndarray, other: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each window holds the same bytes as the other one.

    Consecutive windows of one string that face consecutive windows of another are compared as one stretch.
    """
    if not len(window):
        return np.zeros(0, bool)
    order = np.argsort(window)
    w, o = window[order], other[order]
    new = np.ones(len(w), bool)
    new[1:] = (np.diff(w) != 1) | (np.diff(o) != 1) | (owner[w[1:]] != owner[w[:-1]]) | (owner[o[1:]] != owner[o[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    whole = same_bytes(data, (begin[w[first]], end[w[last]]), (begin[o[first]], end[o[last]]))
    equal = np.repeat(whole, last - first + 1)
    if not whole.all():
        apart = np.flatnonzero(~equal)
        equal[apart] = same_bytes(data, (begin[w[apart]], end[w[apart]]), (begin[o[apart]], end[o[apart]]))
    out = np.empty(len(w), bool)
    out[order] = equal
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, method: Method, count: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For packed strings: which window of which string repeats one of a smaller doc_id.

    Windows that share a 64-bit print are compared, byte for byte, with one of the least doc_id that
    holds the print. Where different windows share a print, all its windows are told apart by their bytes.
    """
    prints, begins, ends = [], [], []
    for part in _portions(np.diff(offsets), CHUNK_BYTES):
        a, b = int(offsets[part.start]), int(offsets[part.stop])
        symbols = method.symbols(data[a:b], offsets[part.start : part.stop + 1] - a)
        at = flat_ranges(symbols.offsets[:-1], count[part])
        prints.append(Rolling(symbols.codes).every(width)[at])
        begins.append((symbols.starts[at] + a).astype(np.int32))
        ends.append((symbols.ends[at + width - 1] + a).astype(np.int32))
    prints, begin, end = (np.concatenate(x) for x in (prints, begins, ends))
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    window, other = _least_holders(prints, doc[owner])
    equal = _equal_windows(data, begin, end, window, other, owner)
    if not equal.all():
        shared = np.unique(prints[window[~equal]])
        window = window[~np.isin(prints[window], shared)]
        among = np.flatnonzero(np.isin(prints, shared))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(begin[among].tolist(), end[among].tolist())]
        docs = doc[owner[among]].tolist()
        least: dict[bytes, int] = {}
        for text, d in zip(texts, docs):
            least[text] = min(least.get(text, d), d)
        window = np.concatenate([window, among[[least[t] < d for t, d in zip(texts, docs)]]])
    window = np.sort(window)
    return owner[window], window - (np.cumsum(count) - count)[owner[window]]


def _by_slice(packed: list[list[np.ndarray]], slices: int) -> Iterator[list[np.ndarray]]:
    """The strings of all blocks by their slice: (doc_id, first window, windows, bytes) of each and their joint text.

    Every block lies in the order of slices. Their borders are found for all blocks at once, since the number
    of blocks in a bucket grows with the input.
    """
    if not packed:
        return
    *facts, part_of = (np.concatenate(x) for x in list(zip(*packed))[:-1])
    texts = [p[-1] for p in packed]
    lengths = np.array([len(p[0]) for p in packed])
    block = np.repeat(np.arange(len(packed)), lengths)
    borders = np.searchsorted(block * slices + part_of, np.arange(len(packed) * slices + 1))
    before = np.concatenate(([0], np.cumsum(facts[3], dtype=np.int64)))
    begins = before[borders[:-1]].reshape(-1, slices)
    ends = before[borders[1:]].reshape(-1, slices) - begins[:, :1]
    begins = begins - begins[:, :1]
    order = np.argsort(part_of, kind="stable")
    cuts = np.searchsorted(part_of[order], np.arange(slices + 1)).tolist()
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            stretches = zip(texts, begins[:, part].tolist(), ends[:, part].tolist())
            yield [*(x[order[a:b]] for x in facts), np.concatenate([text[i:k] for text, i, k in stretches if k > i])]


def _settle_bucket(method: Method, width: int, slices: int, blocks: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_pylist()
        blobs = table.column("blob").to_pylist()
        out = [(b, b"M" + blob) for b, blob in zip(block, blobs) if b >= 0]
        packed = [_unpack(blob, _PACKED) for b, blob in zip(block, blobs) if b < 0]
        marks = []
        for doc, first, count, size, data in _by_slice(packed, slices):
            offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            owner, place = repeated_windows(data, offsets, method, count.astype(np.int64), doc, width)
            if len(owner):
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
                begin = np.flatnonzero(new)
                o = owner[begin]
                length = np.diff(np.append(begin, len(owner)))
                marks.append([doc[o], (first[o] + place[begin]).astype(np.int32), length.astype(np.int32)])
        if marks:
            joint = [np.concatenate(x) for x in zip(*marks)]
            out += [(b, b"M" + _pack(x)) for b, x in _grouped(_block_of(joint[0], blocks), joint)]
        rows = list(zip(*out)) if out else [[], []]
        give_back()
        return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["block", "blob"])

    return run


def _covered(symbols_offsets: np.ndarray, ids: np.ndarray, known: np.ndarray, blobs: list[bytes], width: int) -> np.ndarray:
    """A flag for each symbol of a block: covered by a marked window."""
    edges = np.zeros(int(symbols_offsets[-1]) + 1, np.int64)
    rows = np.flatnonzero(known)
    rows = rows[np.argsort(ids[rows], kind="stable")]
    sorted_ids = ids[rows]
    if blobs:
        doc, first, count = (np.concatenate(x) for x in list(zip(*(_unpack(blob, _MARKS) for blob in blobs)))[:-1])
        a, b = np.searchsorted(sorted_ids, doc), np.searchsorted(sorted_ids, doc, "right")
        to = rows[flat_ranges(a, b - a)]  # every row of that doc_id
        first, count = np.repeat(first, b - a).astype(np.int64), np.repeat(count, b - a).astype(np.int64)
        end = np.minimum(symbols_offsets[to] + first + count + width - 1, symbols_offsets[to + 1])
        begin = np.minimum(symbols_offsets[to] + first, end)
        np.add.at(edges, begin, 1)
        np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def ship_documents(blocks: int):
    """Documents to their blocks, many in one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", FLUSH_BYTES):
            block = batch.column("_block").to_numpy()
            out = []
            for b, (rows,) in _grouped(block, [np.arange(len(block))]):
                sink = pa.BufferOutputStream()
                part = batch.take(pa.array(rows))
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                out.append((b, b"D" + zstandard.ZstdCompressor(level=3).compress(sink.getvalue())))
            yield _blobs(out)

    return run


def read_documents(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob[1:])).read_all()


def _finish(method: Method, width: int, result: Callable[[Symbols, np.ndarray], list[pa.Array]], schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        documents = [read_documents(b) for b in blobs if b[:1] == b"D"]
        batches = pa.concat_tables(documents).combine_chunks().to_batches() if documents else []
        if not batches:
            return schema.empty_table()
        (batch,) = batches
        ids, known = _documents(batch)
        symbols = method.symbols(*method.normalise(*utf8(batch.column("_text"))))
        gone = _covered(symbols.offsets, ids, known, [b[1:] for b in blobs if b[:1] == b"M"], width)
        made = pa.table([batch.column(ROW), *result(symbols, gone)], names=schema.names)
        give_back()
        return made

    return run


def _hot_anchors(source: DataFrame, rows: int, size: int, method: Method, width: int) -> np.ndarray:
    """Anchors whose packed strings, by the sampled documents, fill a bucket."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCUMENTS / max(rows, 1)))
    if size * method.growth <= BUCKET_BYTES:  # not even all strings together do
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", method.piece_bytes):
            ids, known = _documents(batch)
            symbols = method.symbols(*method.normalise(*utf8(batch.column("_text"))))
            runs, _ = _once(symbols, _runs(symbols, Rolling(symbols.codes), ids, known, method, width), width)
            begin, end = _bounds(symbols, runs, width)
            anchor, of = np.unique(runs.anchor, return_inverse=True)
            held = np.bincount(of, end - begin + STRING_MORE, len(anchor)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(held)], names=["anchor", "n"])

    sampled = source.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sizes = sampled.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = sizes.filter(F.col("n") > int(share * BUCKET_BYTES)).select("anchor").collect()
    return np.array([r[0] for r in hot], np.int64).view(np.uint64)


def remove_repeats(
    documents: DataFrame,
    method: Method,
    result: Callable[[Symbols, np.ndarray], list[pa.Array]],
    schema: str,
    *,
    width: int = WIDTH,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns of each document with the columns (``schema``) that ``result`` makes of its
    symbols and a flag for each: covered by a window that also starts in a smaller doc_id.

    A null or empty text has no windows. Documents of a null doc_id are compared with none and lose
    nothing. Rows that share a doc_id are the same document and should share its text: none of them
    is smaller than the other, and all are marked alike. An empty table gives an empty result.
    """
    source = documents.select(named(doc_id).cast("long").alias("_id"), named(text).alias("_text"))
    rows, size = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    buckets, slices = fan_out(size * method.growth)
    blocks = ceil(size / BLOCK_BYTES) or 1
    hot = _hot_anchors(source, rows, size, method, width)
    sent = source.mapInArrow(_send(method, width, buckets, slices, blocks, hot), "bucket int, block int, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(_settle_bucket(method, width, slices, blocks), "block int, blob binary")

    placed = with_row(documents, keep, _id=named(doc_id).cast("long"), _text=named(text))
    out = row_schema(placed, schema)
    placed = placed.withColumn("_block", _block_column("_id", "_text", blocks))
    shipped = placed.mapInArrow(ship_documents(blocks), "block int, blob binary")
    finish = _finish(method, width, result, to_arrow_schema(out))
    return opened(shipped.unionByName(marks).groupBy("block").applyInArrow(finish, out))
