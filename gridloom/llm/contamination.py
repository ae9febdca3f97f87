"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import pieces, utf8
from gridloom.session import settle

WINDOW = 13
SLICE_BYTES = 256 << 10

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z become a-z, letters, digits and all bytes from 0x80 stay, the rest becomes a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
IS_WORD = np.array([chr(b) != " " for b in NORMAL])


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Each ``size`` consecutive words, or all words if there are fewer but some."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" " + b" ".join(words[i : i + size]) + b" "


class Windows:
    """The automaton, with the items and the number of words of each window."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows(normal_words((text or "").encode()), size):
                owners[window].add(str(item))
        self.trie = ahocorasick.Automaton()
        self.items: list[list[str]] = []
        for window, names in owners.items():
            self.trie.add_word(window.decode("latin-1"), (len(self.items), len(window), window.count(b" ") - 1))
            self.items.append(sorted(names))
        if owners:
            self.trie.make_automaton()

    def matches(self, text: bytes) -> tuple[list[tuple[int, int, int]], int]:
        """(window, first word, words) of each occurrence, and how many words the text has."""
        words = normal_words(text)
        if not words or not self.items:
            return [], len(words)
        line = " " + b" ".join(words).decode("latin-1") + " "
        found = [(window, end - length + 1, count) for end, (window, length, count) in self.trie.iter(line)]
        if found:
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
            first = np.searchsorted(spaces, [at for _, at, _ in found])
            found = [(window, int(i), count) for (window, _, count), i in zip(found, first)]
        return found, len(words)


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of the runs of hit words."""
    data = np.frombuffer(text, np.uint8)
    inside = IS_WORD[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    run = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    return list(zip(chars[starts[np.flatnonzero(run == 1)]].tolist(), chars[ends[np.flatnonzero(run == -1) - 1]].tolist()))


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def _slices(known: DataFrame, size: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of about ``most`` bytes, read one after another; a long item is cut with all its windows."""
    held, total = [], 0
    for item, text in known.toLocalIterator():
        words = normal_words((text or "").encode())
        step = max(1, most * max(len(words), 1) // max(sum(map(len, words)) + len(words), 1))
        for i in range(0, max(len(words) - size + 1, 1), step):
            part = b" ".join(words[i : i + step + size - 1])
            held.append((str(item), part.decode()))
            total += len(part)
            if total >= most:
                yield held
                held, total = [], 0
    if held:
        yield held


def _made(row: pa.Array, texts: list[bytes], counts: list[int], places: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    """Result columns from the first word and the number of words of each occurrence."""
    hits, spans = [], []
    for text, n, found in zip(texts, counts, places):
        if not found:
            hits.append(0), spans.append([])
            continue
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, [i for i, _ in found], 1)
        np.add.at(edges, [i + k for i, k in found], -1)
        hit = np.cumsum(edges[:-1]) > 0
        hits.append(int(hit.sum()))
        spans.append([{"start": s, "end": e} for s, e in _spans(text, hit)])
    return pa.RecordBatch.from_arrays(
        [
            row,
            pa.array(counts, pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ],
        names=[ROW, "n_words", "n_hit", "items", "spans"],
    )


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = utf8(batch.column("_text"))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _scan(lookup, size: int):
    """Everything at once, for a benchmark of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Windows(lookup.value, size)  # built by the task, and gone with it
        for batch in pieces(batches, "_text"):
            texts = _texts(batch)
            found = [automaton.matches(t) for t in texts]
            items = [sorted({x for w in {w for w, _, _ in f} for x in automaton.items[w]}) for f, _ in found]
            yield _made(batch.column(ROW), texts, [n for _, n in found], [[(i, k) for _, i, k in f] for f, _ in found], items)

    return run


def _scan_slice(lookup, size: int):
    """The occurrences of one slice in each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Windows(lookup.value, size)  # built by the task, and gone with it
        for batch in pieces(batches, "_text"):
            rows = []
            for place, text in zip(batch.column("_place").to_pylist(), _texts(batch)):
                found, _ = automaton.matches(text)
                if found:
                    items = sorted({x for w in {w for w, _, _ in found} for x in automaton.items[w]})
                    rows.append((place, sorted({(i, k) for _, i, k in found}), items))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"first": i, "count": k} for i, k in r[1]] for r in rows], kind),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                names=["_place", "_found", "_items"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        texts = _texts(batch)
        places = [[(p["first"], p["count"]) for p in found or []] for found in batch.column("_found").to_pylist()]
        items = [sorted(x or []) for x in batch.column("_items").to_pylist()]
        yield _made(batch.column(ROW), texts, [len(normal_words(t)) for t in texts], places, items)


def find_benchmark_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The ``keep`` columns of each document with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window
    is ``size`` consecutive words of an item; an item of fewer words is one window. All windows
    form one automaton, which reads each text once; a word inside any occurrence is hit. ``items``
    lists the items with occurring windows, ``spans`` the hit stretches as character offsets in the
    unchanged text. No shuffle is needed.

    A null or empty text has no words and no hits; an item without words matches nothing; a null
    item id counts as ``None``; repeated items and rows change nothing; other columns are dropped
    unless named in ``keep``.

    Benchmark texts are broadcast in slices of ``slice_bytes``; a task builds and holds the automaton of
    one slice, about 500 bytes for a byte of text. A benchmark of one slice is scanned in one pass without
    a shuffle. A larger one is scanned slice by slice over a written copy of the documents, and the
    occurrences, not the texts, are put together by document; any size gives the same rows.
    """
    spark = documents.sparkSession
    known = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    lookups = [spark.sparkContext.broadcast(held) for held in _slices(known, size, slice_bytes)]
    lookups = lookups or [spark.sparkContext.broadcast([])]
    source = with_row(documents, keep, _text=named(text))
    made = row_schema(source, FOUND)
    if len(lookups) == 1:
        return opened(source.mapInArrow(_scan(lookups[0], size), made))
    placed = settle(source.withColumn("_place", F.monotonically_increasing_id()))
    kind = "_place long, _found array<struct<first: int, count: int>>, _items array<string>"
    texts = placed.select("_place", "_text")
    found = reduce(DataFrame.unionByName, [texts.mapInArrow(_scan_slice(x, size), kind) for x in lookups])
    joint = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("_found", "_items")]
    whole = placed.join(found.groupBy("_place").agg(*joint), "_place", "left").drop("_place")
    return opened(whole.mapInArrow(_merge, made))


def contaminated() -> F.Column:
    """At least one hit word, and at least a twentieth of all words hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their columns unchanged.

    Cases of null, empty and repeated rows as in ``find_benchmark_passages``: such documents stay.
    """
    whole = documents.select(F.struct(*(named(c) for c in documents.columns)).alias("document"), named(text).alias("text"))
    found = find_benchmark_passages(whole, benchmark, keep=("document",), **options)
    return found.filter(~contaminated()).select(*(F.col("document")[c].alias(c) for c in documents.columns))


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "spans",
    )


def brute_force(text: str | None, items: list[tuple[object, str | None]], size: int = WINDOW) -> tuple[int, int, str]:
    """What the operator must find in one text, by comparing every window with every stretch of words."""
    words = normal_words((text or "").encode())
    hit, names = set(), set()
    for item, body in items:
        other = normal_words((body or "").encode())
        span = min(size, len(other))
        known = {tuple(other[i : i + span]) for i in range(len(other) - span + 1)} if span else set()
        for i in range(len(words) - span + 1):
            if tuple(words[i : i + span]) in known:
                hit.update(range(i, i + span))
                names.add(str(item))
    return len(words), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
