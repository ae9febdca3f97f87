"""Encoders of public tokenizer files, from their bytes, one of each kind kept in a worker.

The files are read on the driver and broadcast; their size does not depend on the documents.
"""

from __future__ import annotations

import json
import zlib
from functools import cached_property

import numpy as np
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

# Texts beyond this many characters go to the library of the file: the faster one may fail on very long runs of spaces.
LONG_TEXT = 100_000

_KEPT: dict[tuple, object] = {}


def _kept(kind: type, data: bytes, *more):
    key = (kind, len(data), zlib.crc32(data), *more)
    if key not in _KEPT:
        _KEPT[key] = kind(data, *more)
    return _KEPT[key]


def byte_level(char: str) -> int:
    """The byte that a character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others, in order, for the characters from 256 on.
    """
    code = ord(char)
    if code < 256:
        return code
    return [*range(0x21), *range(0x7F, 0xA1), 0xAD][code - 256]


class ByteBpe:
    """A byte-level BPE of a ``tokenizers`` file; control strings inside texts are plain text."""

    def __init__(self, file: bytes, pattern: str):
        self.file = file.decode()
        model = json.loads(self.file)["model"]
        self.ranks = {bytes(map(byte_level, token)): i for token, i in model["vocab"].items()}
        merged = [self.ranks[bytes(map(byte_level, "".join(m if isinstance(m, list) else m.split(" "))))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @classmethod
    def of(cls, file: bytes, pattern: str) -> ByteBpe:
        return _kept(cls, file, pattern)

    @cached_property
    def plain(self) -> Tokenizer:
        made = Tokenizer.from_str(self.file)
        made.encode_special_tokens = True
        return made

    @cached_property
    def token_bytes(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceBpe:
    """A ``sentencepiece`` model."""

    def __init__(self, file: bytes):
        self.model = SentencePieceProcessor(model_proto=file)

    @classmethod
    def of(cls, file: bytes) -> PieceBpe:
        return _kept(cls, file)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        n = self.model.get_piece_size()
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(n)]
        return [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def flat_ids(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the n+1 offsets of the texts in them."""
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(x) for x in encoded], out=offsets[1:])
    ids = np.empty(int(offsets[-1]), np.int32)
    for x, a, b in zip(encoded, offsets.tolist(), offsets[1:].tolist()):
        ids[a:b] = x
    return ids, offsets


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
