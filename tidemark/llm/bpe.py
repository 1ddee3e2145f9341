"""Byte-level BPE through sentencepiece: a model written straight from a rank file.

Every byte b becomes the character U+0100+b, so a piece of the vocabulary is an ordinary string and
no byte is white space or a control mark to sentencepiece. A piece's score is its negative rank; then
the best-scored adjacent pair is the lowest rank, leftmost first, which is the rank-file merge order.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import regex
import sentencepiece

CACHE_PIECES = 400_000   #: remembered pre-tokens per worker; a full memory is emptied
CACHE_CHARS = 48         #: longer pre-tokens are encoded anew each time

_TO_PIECE = {b: chr(0x100 + b) for b in range(256)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """One protobuf field: a length-delimited value or a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece number = position in rank order, the unknown piece last."""
    normal, unknown, bpe = 1, 2, 2
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, as_piece(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
                          + _field(3, normal)))
    out.append(_field(1, _field(1, "⁇unknown".encode()) + _field(3, unknown)))
    minus_one = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + b"".join((
        _field(40, len(ranks)), *(_field(n, minus_one) for n in (41, 42, 43))))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class _Memory(dict):
    """Pre-token -> encoded form; dict subclasses call __missing__ on a first sight."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[word] = value
        return value


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of = [r for _, r in by_rank]
        self.bytes_of = {r: t for t, r in by_rank}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.length_of = np.zeros(max(self.rank_of) + 1, dtype=np.int64)
        self.length_of[self.rank_of] = [len(t) for t, _ in by_rank]
        self.ids_memory, self.count_memory = _Memory(self._ids), _Memory(self._count)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token. A whole pre-token of the vocabulary is that one id, as in the rank library."""
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return [self.rank_of[p] for p in self.model.encode(as_piece(raw))]

    def _ids(self, word: str) -> bytes:
        ids = self.word_ids(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _count(self, word: str) -> int:
        return len(self.word_ids(word))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids_memory.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return sum(map(self.count_memory.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of every token; a token that holds a part of a character covers that whole character.

        The tokens' bytes in a row are the text, so their lengths give the offsets."""
        ids = np.frombuffer(self.encode(text), "<u4")
        ends = np.cumsum(self.length_of[ids])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        raw = text.encode()
        if len(raw) == len(text):
            return starts, ends
        char_at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return char_at[starts], char_at[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker; later tasks of the same worker find its memory warm."""
    return Codec(path, pattern)
