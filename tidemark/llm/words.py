"""Words, 5-word shingles and their 64-bit hashes for whole texts, vectorised over groups of documents.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text; with `lower`, A-Z become a-z.
Work arrays are bounded by PIECE_BYTES, not by the length of a text: a longer text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

PIECE_BYTES = 1 << 20

_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


class Words(NamedTuple):
    """Words of documents lo..hi-1: document number, byte span in the document, hash."""

    lo: int
    hi: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[1], np.cumprod(np.full(max(0, n - 1), _BASE, dtype=np.uint64))]).astype(np.uint64)


_POWERS = _powers(4096)


def _words(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte string."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    sizes = ends - starts
    chars = table[data[inside[1:-1] == 1]].astype(np.uint64) + np.uint64(1)
    firsts = np.cumsum(sizes) - sizes
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    chars *= powers[np.arange(len(chars)) - np.repeat(firsts, sizes)]
    return starts, ends, mix(np.add.reduceat(chars, firsts))


def _cuts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of a long text that end between words."""
    at = 0
    while at < len(raw):
        to = at + PIECE_BYTES
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        yield at, raw[at:to]
        at = to


def words(texts: Sequence[bytes | None], lower: bool = True) -> Iterator[Words]:
    """Words of all texts, in groups of whole documents; nulls have none."""
    table = _LOWER if lower else _IDENTITY
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") < PIECE_BYTES):
            size += len(texts[hi] or b"") + 1
            hi += 1
        group = [t or b"" for t in texts[lo:hi]]
        if hi == lo + 1:
            parts = [(at, *_words(part, table)) for at, part in _cuts(group[0])] or [(0, *_words(b"", table))]
            start, end = (np.concatenate([p[0] + p[i] for p in parts]) for i in (1, 2))
            yield Words(lo, hi, np.full(len(start), lo), start, end, np.concatenate([p[3] for p in parts]))
        else:
            start, end, h = _words(b"\n".join(group), table)
            first = np.cumsum([0, *(len(g) + 1 for g in group[:-1])])
            doc = np.searchsorted(first, start, side="right") - 1
            yield Words(lo, hi, doc + lo, start - first[doc], end - first[doc], h)
        lo = hi


def shingles(doc: np.ndarray, h: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of n words inside one document."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[:-n + 1] == doc[n - 1:]) if n > 1 else np.arange(len(h))
    total = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(_BASE) + h[at + i]
    return at, mix(total + np.uint64(n))


def shingle_sets(w: Words, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(document, sorted distinct shingle hashes); fewer than n words make one shingle, no word none."""
    at, h = shingles(w.doc, w.hash, n)
    docs = np.arange(w.lo, w.hi)
    word_from, word_to = np.searchsorted(w.doc, docs), np.searchsorted(w.doc, docs, side="right")
    of = w.doc[at]
    from_, to = np.searchsorted(of, docs), np.searchsorted(of, docs, side="right")
    for i, d in enumerate(docs.tolist()):
        if to[i] > from_[i]:
            s = np.sort(h[from_[i]:to[i]])
            yield d, s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif word_to[i] > word_from[i]:
            few = w.hash[word_from[i]:word_to[i]]
            yield d, shingles(np.zeros(len(few)), few, len(few))[1]
        else:
            yield d, np.empty(0, np.uint64)
