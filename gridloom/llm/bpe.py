"""Byte-level BPE: all merges of a stretch of corpus replayed in rank order over its distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import flat_ranges, give_back, pieces, utf8

CORPUS_BYTES = 4 << 20
KNOWN_WORDS = 1 << 18


class Vocabulary:
    """Ranks of byte strings, by id; ``ids`` finds the id of a byte string."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)})

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the token that each pair of tokens makes, -1 for none."""
        if not len(self.pairs):
            return np.full(len(a), -1)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[flat_ranges(self.starts[ids], self.sizes[ids])]


def replay_merges(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one word after another, and how many each word has.

    An inverted index leads from the rank of a pair of neighbouring tokens to the positions where it
    stands in any word. Ranks are taken in order, and the pair is merged at all its positions, from
    left to right; only the pairs with the touched neighbours are looked up and enter the index anew.
    A word that is itself a token is that token. Each step of a word merges the least rank it holds,
    so every word comes out as if it had been encoded alone.
    """
    whole = [vocabulary.ids.get(w, -1) for w in words]
    text = np.frombuffer(b"".join(words), np.uint8)
    n = len(text)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1])) if len(words) else ends
    token = vocabulary.of_byte[text]
    right = np.arange(1, n + 1)
    left = np.arange(-1, n - 1)
    right[ends[ends > starts] - 1] = -1
    left[starts[ends > starts]] = -1
    done = np.array(whole, np.int64) >= 0
    one = starts[done]
    token[flat_ranges(one, ends[done] - one)] = -1
    right[flat_ranges(one, ends[done] - one)] = -1
    token[one] = np.array(whole, np.int64)[done]

    places = np.flatnonzero((right >= 0) & (token >= 0))
    found = vocabulary.rank_of(token[places], token[right[places]])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, a, b in zip(ranks[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            stretch = index.get(rank)
            if stretch is None:
                index[rank] = [at[a:b]]
                heappush(queue, rank)
            else:
                stretch.append(at[a:b])

    enter(places, found)
    while queue:
        rank = heappop(queue)
        listed = index.pop(rank)
        at = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
        at = at[(token[at] >= 0) & (right[at] >= 0)]
        at = at[vocabulary.rank_of(token[at], token[right[at]]) == rank]
        if len(at) > 1:  # of a run of overlapping pairs, every second one counts from the left
            first = np.concatenate(([True], right[at[:-1]] != at[1:]))
            if not first.all():
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = right[at]
        beyond = right[gone]
        token[at], token[gone] = rank, -1
        right[at] = beyond
        open_end = beyond >= 0
        left[beyond[open_end]] = at[open_end]
        touched = left[at]
        touched = np.unique(np.concatenate((touched[touched >= 0], at[open_end])))
        enter(touched, vocabulary.rank_of(token[touched], token[right[touched]]))
    stays = token >= 0
    total = np.concatenate(([0], np.cumsum(stays)))
    return token[stays].astype(np.uint32), total[ends] - total[starts]


@lru_cache(maxsize=4)
def _split(pattern: str):
    return regex.compile(pattern).findall


class _Places(dict):
    """A number for each word, in the order in which words appear."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Encoder:
    """Encodes stretches of corpus; keeps the ids of a bounded number of words between them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, _split(pattern)
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        """Token ids of the words numbered since the last time."""
        fresh = list(islice(self.place, len(self.starts) - 1, None))
        if fresh:
            ids, counts = replay_merges([w.encode() for w in fresh], self.vocabulary)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the n+1 offsets of the texts in them."""
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        number = self.place.__getitem__
        each = [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]
        self._learn()
        places = np.concatenate([np.zeros(0, np.int32), *each])
        counts = np.array([len(x) for x in each], np.int64)
        sizes = self.starts[places + 1] - self.starts[places]
        ids = self.ids[flat_ranges(self.starts[places], sizes)]
        word_ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, word_ends[np.concatenate(([0], np.cumsum(counts)))]


def encode_documents(
    documents: DataFrame,
    vocabulary: DataFrame,
    pattern: str,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = True,
) -> DataFrame:
    """The ``keep`` columns with ``n_tokens``, ``ids`` and digests of the ids and of the decoded bytes.

    ``vocabulary`` is a text table of rank lines (base64 of the bytes, rank), read by
    ``read_vocabulary``; it is broadcast, and its size does not depend on the documents. Each match
    of ``pattern`` is encoded on its own, without special tokens. A task takes about 4 MB of text
    at a time and replays the merges over its distinct words, so no shuffle is needed and memory
    does not grow with the input.

    A null text counts as empty and has no ids; control strings of other tokenizers are plain text;
    repeated rows are encoded alike; an empty table gives none; other columns are dropped unless kept.
    Decoding goes through the ids: ``decoded_sha256`` is the digest of the bytes they stand for.
    """
    lookup = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lookup.value
        encoder = Encoder(known, pattern)
        for batch in pieces(batches, "_text", CORPUS_BYTES):
            data, offsets = utf8(batch.column("_text"))
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids, cuts = encoder.encode(texts)
            decoded = known.decode(ids)
            sizes = np.concatenate(([0], np.cumsum(known.sizes[ids])))
            coded, plain = ids.astype("<u4").tobytes(), decoded.tobytes()
            at = cuts.tolist()
            byte_at = sizes[cuts].tolist()
            arrays = [
                batch.column(ROW),
                pa.array(np.diff(cuts), pa.int64()),
                pa.array([hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(byte_at, byte_at[1:])], pa.string()),
            ]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=[ROW, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
            give_back()

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = with_row(documents, keep, _text=named(text))
    return opened(source.mapInArrow(run, row_schema(source, made)))


def read_vocabulary(path: str) -> Vocabulary:
    """The rank file at a path of the driver."""
    with open(path, "rb") as file:
        return Vocabulary.parse(file.read())
