"""Words of whole texts as 64-bit hashes, and shingles of them, without a loop over words.

A word is a run of letters, digits or underscores, in lower case.
"""
from __future__ import annotations

import re

import numpy as np

from quern.llm.fingerprints import _VALUES, _tables, mixed

_OTHER = re.compile(r"\W+")
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
_WORD[128:] = True
_PIECE = 1 << 20


def plain(data: bytes) -> bytes:
    """Lower case, with nothing but ASCII between words."""
    return data.lower() if data.isascii() else _OTHER.sub(" ", data.decode().lower()).encode()


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in plain bytes."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _WORD[b], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    powers, inverses = _tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * powers[:len(b)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(data: bytes) -> list[bytes]:
    """A long text cut between words."""
    out, at = [], 0
    while len(data) - at > _PIECE:
        cut = max(data.rfind(b" ", at + 1, at + _PIECE), data.rfind(b"\n", at + 1, at + _PIECE))
        cut = at + _PIECE if cut < 0 else cut
        while cut < len(data) and _WORD[data[cut]]:      # one word longer than a piece
            cut += 1
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one text after the other, and their number by text."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = size = 0

    def close(to: int) -> None:
        nonlocal group, size, first
        if group:
            hashes, starts = _hashed(b" ".join(group))
            edges = np.cumsum([len(g) + 1 for g in group])
            counts[first:to] = np.diff(np.searchsorted(starts, edges), prepend=0)
            parts.append(hashes)
        group, size, first = [], 0, to

    for n, text in enumerate(texts):
        data = plain(text)
        if len(data) > _PIECE:
            close(n)
            for piece in _pieces(data):
                hashes, _ = _hashed(piece)
                counts[n] += len(hashes)
                parts.append(hashes)
            first = n + 1
            continue
        if size + len(data) > _PIECE:
            close(n)
        group.append(data)
        size += len(data) + 1
    close(len(texts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row and the number of the text of each. A text of
    fewer words has one shingle, all its words; one without words has none."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    made = np.zeros(len(hashes), np.uint64)
    n = len(hashes)
    left = np.repeat(ends, counts) - np.arange(n)       # words from here to the end of the text
    for j in range(min(width, n)):
        part = made[:n - j] if j else made
        term = hashes[j:] * _ODD[j]
        part += np.where(left[:n - j] > j, term, np.uint64(0)) if j else term
    short = counts[text] < width if n else np.zeros(0, bool)
    first = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    use = (left >= width) | (short & first)
    return mixed(made[use] + np.minimum(left[use], width).astype(np.uint64)), text[use]


_KIND = np.where(_WORD, 1, 2).astype(np.int8)
_KIND[[*b" \t\r\n\f\v\0"]] = 0


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, for words and runs of ASCII punctuation, both in lower case."""
    parts, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        data = text.lower() if text.isascii() else text.decode().lower().encode()
        for piece in _pieces(data):
            b = np.frombuffer(piece, np.uint8)
            kinds = np.concatenate([[0], _KIND[b], [0]])
            turns = np.flatnonzero(kinds[1:] != kinds[:-1])
            starts, ends = turns[:-1], turns[1:]
            use = kinds[starts + 1] > 0
            starts, ends = starts[use], ends[use]
            powers, inverses = _tables(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_VALUES[b] * powers[:len(b)], dtype=np.uint64, out=sums[1:])
            parts.append(mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)))
            counts[n] += len(starts)
    return np.concatenate(parts), counts
