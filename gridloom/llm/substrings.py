"""Substring dedup over words: windows grouped by minimiser into packed strings (super-k-mers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.repeats import WIDTH, Method, Symbols, _words_of, as_lines, remove_repeats
from gridloom.llm.text import Rolling, least_in_windows

MINIMISER_WORDS = 6


def minimisers(rolling: Rolling, width: int) -> np.ndarray:
    """For each window the least hash of ``MINIMISER_WORDS`` consecutive words in it."""
    size = min(MINIMISER_WORDS, width)
    return least_in_windows(rolling.every(size), width - size + 1)


SUPER_KMERS = Method(as_lines, _words_of, minimisers, growth=2.8, piece_bytes=1 << 20)

KEPT = "n_words long, n_removed long, kept string"


def _kept_words(symbols: Symbols, gone: np.ndarray) -> list[pa.Array]:
    total = np.concatenate(([0], np.cumsum(gone)))
    removed = np.diff(total[symbols.offsets])
    raw = symbols.data.tobytes()
    kept = []
    cuts = symbols.offsets.tolist()
    for a, b, n in zip(cuts, cuts[1:], removed.tolist()):
        if n:
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([raw[s:e] for s, e in zip(symbols.starts[stay].tolist(), symbols.ends[stay].tolist())]))
        else:
            kept.append(raw[symbols.starts[a] : symbols.ends[b - 1]] if b > a else b"")
    return [
        pa.array(np.diff(symbols.offsets), pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array(kept, pa.binary()).cast(pa.string()),
    ]


def remove_repeated_words(documents: DataFrame, *, width: int = WIDTH, **options) -> DataFrame:
    """Each document with ``n_words``, ``n_removed`` and ``kept``, its other words joined by one space.

    Words are runs of characters other than space and 0x09-0x0D, unchanged. A window is ``width``
    consecutive words of one document. A word goes if a window over it, as a sequence of words, also
    starts in a document with a smaller doc_id; windows are judged on the input, not on what is left.

    Windows that share their least hash of six words, their minimiser, travel as one packed string to
    the bucket of the minimiser, where they are sorted and counted. ``repeats`` describes the
    shuffles, the treatment of skew and the cases of null, empty and repeated rows. A text of fewer
    than ``width`` words stays as it is, whatever its copies.
    """
    return remove_repeats(documents, SUPER_KMERS, _kept_words, KEPT, width=width, **options)


def brute_force(documents: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept) of each document, with every window in one dictionary."""
    words = [(d, (t or "").encode().split()) for d, t in documents]
    least: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - width + 1 if d is not None else 0):
            window = tuple(w[i : i + width])
            least[window] = min(least.get(window, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out
