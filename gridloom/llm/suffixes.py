"""Substring dedup over bytes by the phrases of prefix-free parsing, in buckets keyed by trigger.

A rolling hash over ``TRIGGER_BYTES`` bytes that is divisible by ``TRIGGER_PERIOD`` is a trigger. The
triggers cut each text into phrases; where a trigger falls depends on the bytes there alone, so equal
passages fall into equal phrases. A phrase is shipped with the bytes that its last windows reach
into, to the bucket of the trigger that ends it. Each task ships its distinct phrases only. The bucket
sorts the windows of ``width`` bytes by a fingerprint, sets aside those that occur once, tells the others
apart by their bytes, and reads off, for each, the least document that holds it. No parse and no suffix
array are built: equal windows always meet in one bucket, and the removal needs no order of suffixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.repeats import WIDTH, Method, Symbols, _bytes_of, remove_repeats, unchanged
from gridloom.llm.text import Rolling, least_in_windows

TRIGGER_BYTES = 8
TRIGGER_PERIOD = 48


def phrase_ends(rolling: Rolling, width: int) -> np.ndarray:
    """For each window the hash of the first trigger inside it, which ends the phrase it begins in.

    A window inside a long phrase holds no trigger; its least rolling hash stands in, which also
    depends on the window alone.
    """
    size = min(TRIGGER_BYTES, width)
    hashes = rolling.every(size)
    least = least_in_windows(hashes, width - size + 1)
    place = np.where(hashes % np.uint64(TRIGGER_PERIOD) == 0, np.arange(len(hashes)), len(hashes))
    following = np.minimum.accumulate(place[::-1])[::-1][: len(least)]
    inside = following + size <= np.arange(len(least)) + width
    return np.where(inside, hashes[np.minimum(following, len(hashes) - 1)], least)


PHRASES = Method(unchanged, _bytes_of, phrase_ends, growth=3.3, piece_bytes=1 << 19, level=4)

KEPT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _kept_bytes(symbols: Symbols, gone: np.ndarray) -> list[pa.Array]:
    total = np.concatenate(([0], np.cumsum(gone)))
    removed = total[symbols.offsets]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = symbols.offsets[:-1][np.diff(symbols.offsets) > 0]
    begins[inner] = gone[inner]
    spans = np.concatenate(([0], np.cumsum(begins)))[symbols.offsets]
    raw = symbols.data[~gone].tobytes()
    at = (symbols.offsets - removed).tolist()
    return [
        pa.array(np.diff(symbols.offsets), pa.int64()),
        pa.array(np.diff(removed), pa.int64()),
        pa.array(np.diff(spans), pa.int64()),
        pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()),
    ]


def remove_repeated_bytes(documents: DataFrame, *, width: int = WIDTH, **options) -> DataFrame:
    """Each document with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``.

    A byte of the UTF-8 text goes if a string of ``width`` bytes over it also starts in a document
    with a smaller doc_id; overlaps count, strings never cross documents, and they are judged on the
    input. ``kept`` is binary, since what is left need not be valid UTF-8. ``repeats`` describes the
    shuffles, the treatment of skew and the cases of null, empty and repeated rows.
    """
    return remove_repeats(documents, PHRASES, _kept_bytes, KEPT, width=width, **options)


def brute_force(documents: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, bytes]]:
    """(n_bytes, n_removed, n_spans, kept) of each document, with every string in one dictionary."""
    texts = [(d, (t or "").encode()) for d, t in documents]
    least: dict[bytes, int] = {}
    for d, t in texts:
        for i in range(len(t) - width + 1 if d is not None else 0):
            least[t[i : i + width]] = min(least.get(t[i : i + width], d), d)
    out = []
    for d, t in texts:
        gone = set()
        for i in range(len(t) - width + 1 if d is not None else 0):
            if least[t[i : i + width]] < d:
                gone.update(range(i, i + width))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(t), len(gone), spans, bytes(x for i, x in enumerate(t) if i not in gone)))
    return out
