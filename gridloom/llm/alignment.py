"""Alignment of two tokenisations of the same bytes by lockstep merging, and corpus-wide link counts.

A state vector holds, for every document of a batch, a pointer into its A tokens and one into its B tokens.
A step emits the link of each pair of pointers, advances whichever token ends first (both, and a cut,
where they end together), and drops the documents that are done. A long document enters as several
lanes of ``LANE`` A tokens, each beginning at the B token that covers its first byte, so that the number
of steps is bounded.

A task gathers the links of a block of documents: a dictionary of the block's distinct id pairs with the
number of its documents that hold each, and for each document its entries in that dictionary. Only
dictionaries are exploded into rows; they are added up by pair with map-side combine, compared within
their A id (at most as many rows as B has ids), and joined back to the blocks that asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import give_back, pieces, utf8
from gridloom.llm.tokens import ByteBpe, PieceBpe, flat_ids
from gridloom.session import settle

LANE = 256
BLOCK_BYTES = 8 << 20
MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
COUNTED = "n_best long, count_sum long"
_INNER = ["_block long", "_entries binary", "_pairs binary", "_holders binary"]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, offsets_a: np.ndarray, offsets_b: np.ndarray, lane: int = LANE):
    """Links (A place, B place) and flags of the tokens after which both are cut.

    ``ends_*`` are byte offsets over all documents, one after another; each document begins and ends
    at the same bytes in both.
    """
    counts = np.diff(offsets_a)
    lanes = -(-counts // lane)
    document = np.repeat(np.arange(len(counts)), lanes)
    number = np.arange(len(document)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = offsets_a[document] + number * lane
    stop = np.minimum(a + lane, offsets_a[document + 1])
    begin = np.where(a > 0, ends_a[a - 1], 0) if len(a) else a
    b = np.searchsorted(ends_b, begin, "right")
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    linked_a, linked_b = [a[:0]], [b[:0]]
    while len(a):
        linked_a.append(a), linked_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        cut_a[a[both]] = cut_b[b[both]] = True
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.concatenate(linked_a), np.concatenate(linked_b), cut_a, cut_b


def _cells(n: int) -> np.ndarray:
    """Each id in decimal, right-aligned, with room for a mark behind it; 0 where there is no digit."""
    width = len(str(max(n - 1, 0)))
    digits = np.char.rjust(np.arange(n).astype(f"U{width}"), width, " ").astype(f"S{width}").view(np.uint8).reshape(n, width)
    cells = np.zeros((n, width + 1), np.uint8)
    cells[:, :width] = np.where(digits == ord(" "), 0, digits)
    return cells


def group_texts(ids_a, ids_b, cut_a, cut_b, offsets_a, offsets_b, cells) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: its groups between cuts, A ids before B ids."""
    if not len(ids_a):
        return [b""] * (len(offsets_a) - 1)
    ends = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    groups = len(ends[0])
    size_a, size_b = (np.diff(np.concatenate(([-1], e))) for e in ends)
    group_a, group_b = np.repeat(np.arange(groups), size_a), np.repeat(np.arange(groups), size_b)
    before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + before_a[group_b]
    drawn = np.empty((len(ids_a) + len(ids_b), cells.shape[1]), np.uint8)
    drawn[at_a], drawn[at_b] = cells[ids_a], cells[ids_b]
    drawn[at_a, -1] = np.where(cut_a, ord("|"), ord(","))
    drawn[at_b, -1] = np.where(cut_b, ord(";"), ord(","))
    shown = drawn != 0
    raw = drawn[shown].tobytes()
    at = np.concatenate(([0], np.cumsum(shown.sum(1))))[offsets_a + offsets_b].tolist()
    return [raw[i : k - 1] if k > i else b"" for i, k in zip(at, at[1:])]


def _shrunk(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as the narrowest integers, compressed."""
    parts = [np.array([len(arrays[0])], np.int64).tobytes()]
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if x.max(initial=0) < 1 << min(8 * w, 63))
        parts += [bytes([width]), x.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _grown(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(n):
        width = raw[at]
        out.append(np.frombuffer(raw, f"<u{width}", size, at + 1).astype(np.int64))
        at += 1 + width * size
    return out


class Aligner:
    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in x.token_bytes], np.int64) for x in (a, b)]
        self.cells = _cells(max(map(len, self.sizes)))
        self.wide = len(b.token_bytes)  # a pair is A id * wide + B id

    def _tokens(self, text: bytes) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        a, b = self.a.encode(" " + text.decode()), self.b.encode(text.decode())
        whole = b" " + text
        for ids, bytes_of in ((a, self.a.token_bytes), (b, self.b.token_bytes)):
            if b"".join(map(bytes_of.__getitem__, ids)) != whole:
                return [], []
        return a, b

    def align(self, texts: list[bytes]):
        """Columns of ``MADE``, and document, pair and number of each distinct link of a document."""
        both = [self._tokens(t) for t in texts]
        (ids_a, offsets_a), (ids_b, offsets_b) = flat_ids([x for x, _ in both]), flat_ids([x for _, x in both])
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, (ids_a, ids_b)))
        link_a, link_b, cut_a, cut_b = lockstep(ends_a, ends_b, offsets_a, offsets_b)
        document = np.searchsorted(offsets_a, link_a, "right") - 1
        n = len(texts)
        groups = np.diff(np.concatenate(([0], np.cumsum(cut_a)))[offsets_a])
        drawn = group_texts(ids_a, ids_b, cut_a, cut_b, offsets_a, offsets_b, self.cells)
        made = [np.diff(offsets_a), np.diff(offsets_b), groups, np.bincount(document, minlength=n)]
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in drawn]
        pairs = ids_a[link_a].astype(np.int64) * self.wide + ids_b[link_b]
        span = len(self.a.token_bytes) * self.wide
        key, times = np.unique(document * span + pairs, return_counts=True)
        return made, digests, key // span, key % span, times


def _gather(file_a, file_b, pattern: str, schema: pa.Schema, block_bytes: int):
    """Documents with their digests and entries, and after each block its dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteBpe.of(file_a.value, pattern), PieceBpe.of(file_b.value))
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in pieces(batches, "_text"):
            data, offsets = utf8(batch.column("_text"))
            raw, cuts = data.tobytes(), offsets.tolist()
            held.append((batch.column(ROW), *aligner.align([raw[a:b] for a, b in zip(cuts, cuts[1:])])))
            size += len(data)
            if size >= block_bytes:
                yield from flush(held, block)
                held, size, block = [], 0, block + 1
        if held:
            yield from flush(held, block)

    def flush(held: list, block: int) -> Iterator[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([x[4] for x in held]), return_inverse=True)
        begin = 0
        for row, made, digests, document, own, times in held:
            n = len(row)
            mine = place[begin : begin + len(own)]
            begin += len(own)
            cuts = np.searchsorted(document, np.arange(n + 1)).tolist()
            entries = [_shrunk(np.diff(mine[i:k], prepend=0), times[i:k]) for i, k in zip(cuts, cuts[1:])]
            nothing = pa.nulls(n, pa.binary())
            columns = [row, *(pa.array(c, pa.int64()) for c in made), pa.array(digests, pa.string())]
            columns += [pa.array([block] * n, pa.int64()), pa.array(entries, pa.binary()), nothing, nothing]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        last = [pa.nulls(1, f.type) for f in schema]
        last[-4] = pa.array([block], pa.int64())
        last[-2] = pa.array([_shrunk(np.diff(pairs, prepend=0))], pa.binary())
        last[-1] = pa.array([_shrunk(np.bincount(place, minlength=len(pairs)))], pa.binary())
        yield pa.RecordBatch.from_arrays(last, schema=schema)
        give_back()

    return run


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, holders in zip(*(c.to_pylist() for c in batch.columns)):
            pair = np.cumsum(_grown(pairs, 1)[0])
            columns = [np.full(len(pair), block), pair, _grown(holders, 1)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_block", "pair", "n"])


def _look_up(schema: pa.Schema):
    def run(documents: pa.Table, counts: pa.Table) -> pa.Table:
        pair = counts.column("pair").to_numpy()
        order = np.argsort(pair)
        number = counts.column("count").to_numpy()[order]
        best = counts.column("best").to_numpy()[order]
        sums = []
        for blob in documents.column("_entries").to_pylist():
            step, times = _grown(blob, 2)
            at = np.cumsum(step)
            sums.append((int(times[best[at]].sum()), int((times * number[at]).sum())))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        kept = [documents.column(c) for c in schema.names[:-2]]
        give_back()
        return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=schema)

    return run


def align_documents(
    documents: DataFrame,
    tokenizer_a: bytes,
    pattern: str,
    tokenizer_b: bytes,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` columns of each document with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``
    and ``count_sum``.

    A (a byte-level BPE file) encodes a space and the text, B (a sentencepiece model that adds the space
    itself) the text; control strings are plain text. Links are the pairs of token occurrences whose byte
    ranges overlap; groups lie between offsets where tokens of both end. The count of an id pair is the
    number of documents that hold it linked; ``n_best`` are the links whose count is the highest of
    their A id, ``count_sum`` adds the counts over links. ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2``.

    A text that is null or empty, or that either tokenizer does not give back byte for byte, has no
    tokens: zeros, and an empty digest. Every row is a document of its own, whatever its id; other
    columns are dropped unless kept; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    file_a, file_b = spark.sparkContext.broadcast(tokenizer_a), spark.sparkContext.broadcast(tokenizer_b)
    wide = len(PieceBpe.of(tokenizer_b).token_bytes)
    source = with_row(documents, keep, _text=named(text))
    inner = row_schema(source, ", ".join([MADE, *_INNER]))
    inner = T.StructType([T.StructField(f.name, f.dataType) for f in inner])  # a dictionary's row holds no document
    run = _gather(file_a, file_b, pattern, to_arrow_schema(inner), block_bytes)
    linked = settle(source.mapInArrow(run, inner))
    asked = linked.filter("_pairs is not null").select("_block", "_pairs", "_holders").mapInArrow(_dictionaries, "_block long, pair long, n long")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.expr(f"pair div {wide}"))
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))
    answers = asked.select("_block", "pair").join(counts, "pair")
    out = row_schema(source, f"{MADE}, {COUNTED}")
    found = linked.filter("_pairs is null").drop("_pairs", "_holders")
    return opened(found.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_look_up(to_arrow_schema(out)), out))


def brute_force(texts: list[str | None], encode_a, encode_b, bytes_a, bytes_b) -> list[tuple]:
    """The seven columns for each text, by comparing all token ranges; ``encode_a`` gets the space too."""
    held, linked = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        ranges = []
        for ids, known in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(known[i]), i))
                at += len(known[i])
            ranges.append(own)
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups = [
            "|".join(",".join(str(i) for s, e, i in r if lo < e <= hi) for r in ranges) for lo, hi in zip([0, *ends], ends)
        ]
        held.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        linked.append(links)
    count: dict[tuple[int, int], int] = {}
    for links in linked:
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
    most: dict[int, int] = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [(*h, sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)) for h, links in zip(held, linked)]
