"""Words of texts as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from tessera.llm.repeats import Sequences, combine, salted

#: Bytes of text that are read at once, and of a word that is hashed eight bytes at a time; a longer one is digested.
PIECE, CHUNKED = 1_000_000, 4096
_SPACE = b" \t\n\r\x0b\x0c"
_SOLID = np.ones(256, bool)
_SOLID[list(_SPACE)] = False


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; the last byte must be white space."""
    solid = _SOLID[data]
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        turn = np.concatenate([[0], turn])
    return turn[::2], turn[1::2]


def _codes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A salted 64-bit hash of each word; ``joined`` has seven bytes at least after the last word."""
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    size = end - begin
    out = salted(size.astype(np.uint64))
    at, done = np.flatnonzero(size <= CHUNKED), 0
    while len(at):
        rest = np.minimum(size[at] - done, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * rest).astype(np.uint64)
        out[at] = combine(out[at], eight[begin[at] + done] & mask)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > CHUNKED).tolist():
        out[i] ^= np.uint64(int.from_bytes(blake2b(joined[begin[i] : end[i]], digest_size=8, key=out[i].tobytes()).digest(), "little"))
    return out


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that end at white space."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _batches(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts, with the texts' numbers, of about PIECE bytes together."""
    number, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            if size and size + len(piece) > PIECE:
                yield number, parts
                number, parts, size = [], [], 0
            number.append(i)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield number, parts


def word_codes(texts: list[bytes]) -> Sequences:
    """The code of each run of bytes other than ASCII white space; equal for equal words."""
    out, sizes = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for number, parts in _batches(texts):
        joined = b"\n".join([*parts, b" " * 8])
        begin, end = word_bounds(np.frombuffer(joined, np.uint8))
        out.append(_codes(joined, begin, end))
        edges = np.cumsum([len(p) + 1 for p in parts])
        np.add.at(sizes, number, np.diff(np.searchsorted(begin, edges), prepend=0))
    return Sequences(np.concatenate(out), sizes)
