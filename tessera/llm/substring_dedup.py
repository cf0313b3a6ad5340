"""Substring dedup on words by prefix-partitioned suffix trees.

A word is removed if a window of ``width`` words that covers it also starts in a document with a smaller id; windows are
judged on the input. Only suffixes whose first window holds a repeated anchor can matter (see ``repeats``); those are
dealt to buckets with the words that follow them. A bucket splits its suffixes by variable-length prefixes: by their
first word, and where a group exceeds ``GROUP`` suffixes by the next word too, until every group fits. Each group is
sorted into suffix order with the lengths of the common prefixes of neighbours, which is its suffix tree; the inner nodes
of depth ``width`` or more lie in intervals of neighbours that share ``width`` words, the maximal repeats' loci. The
least id under the topmost such node decides. Words are compared themselves, there and within a block; hashes only
propose.

Null ids are the least. Null texts have no words; with under ``width`` words nothing is removed. Rows that share an id
are judged separately, and never count as smaller than each other. Ids are read as longs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import release_memory
from tessera.llm.repeats import Sequences, blocked, by_bucket, counts_for, find_repeats, numeric, pack, ranges, unpack, window_hashes
from tessera.llm.words import pieces, word_bounds, word_codes

K = 5
#: Suffixes of a subtree.
GROUP = 200_000


def _sequences(texts: list[bytes]) -> Sequences:
    """Codes of the words, and in the bytes of all texts where each word starts and ends."""
    seq = word_codes(texts)
    seq.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    seq.begin, seq.end = word_bounds(seq.data) if len(seq.data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return seq


def _numbers(seq: Sequences) -> np.ndarray:
    """A number for each word, the same for the same words only."""
    number = Numbers()
    return np.concatenate([np.fromiter(map(number.__getitem__, piece.split()), np.int64) for piece in pieces(seq.data.tobytes())])


class Numbers(dict):
    """0, 1, 2, ... for each new key."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def prefix_groups(ids: np.ndarray, at: np.ndarray, most: int, width: int, depth: int = 0) -> Iterator[np.ndarray]:
    """Suffixes (their starts) in groups of at most ``most`` that share a prefix, or several whole prefixes; only equal windows exceed it."""
    if len(at) <= most or depth == width:
        yield at
        return
    word = ids[at + depth]
    order = np.argsort(word, kind="stable")
    cuts = np.flatnonzero(np.diff(word[order])) + 1
    edges = np.concatenate([[0], cuts, [len(at)]]).tolist()
    start = 0
    for i in range(1, len(edges)):
        if edges[i] - edges[i - 1] > most:
            if edges[i - 1] > start:
                yield at[order[start : edges[i - 1]]]
            yield from prefix_groups(ids, at[order[edges[i - 1] : edges[i]]], most, width, depth + 1)
            start = edges[i]
        elif edges[i] - start > most:
            yield at[order[start : edges[i - 1]]]
            start = edges[i - 1]
    if start < len(at):
        yield at[order[start:]]


def subtree(ids: np.ndarray, at: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the starts, and words (up to ``width``) that each shares with the one before it."""
    fit = max(1, 63 // bits)
    keys = []
    for first in range(0, width, fit):
        key = np.zeros(len(at), np.int64)
        for j in range(first, min(width, first + fit)):
            key = (key << bits) | ids[at + j]
        keys.append((key, min(fit, width - first)))
    order = np.lexsort([key for key, _ in reversed(keys)])
    common, open_ = np.zeros(len(at), np.int64), np.arange(1, len(at))
    for key, size in keys:
        differ = key[order[open_]] ^ key[order[open_ - 1]]
        same = differ == 0
        common[open_[same]] += size
        part = np.floor(np.log2(differ[~same].astype(float))).astype(np.int64) // bits  # the first word, from the left, that differs
        common[open_[~same]] += size - 1 - part
        open_ = open_[same]
    return order, common


def least_below_nodes(order: np.ndarray, common: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each suffix the least owner under its topmost node of depth ``width`` or more (its own where it has none)."""
    if not len(order):
        return owner
    heads = np.flatnonzero(common < width)
    least = np.minimum.reduceat(owner[order], heads)
    out = np.empty(len(owner), owner.dtype)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out


def remove_repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, n_words, kept, spans): the words that stay, joined by one space, and the removed runs (start, end) in words."""
    k = min(K, width)
    blocks, buckets = counts_for(docs, text)

    def send(block: int, ids: np.ndarray, seq: Sequences, runs: tuple) -> list[tuple[int, int, bytes]]:
        hashes, first, last = runs
        if not len(hashes):
            return []
        # Of runs with equal words the first goes, which has the least id. The first and last window cover a run.
        marks = window_hashes(seq.codes, width)
        _, place, inverse = np.unique(np.stack([hashes, marks[first], marks[last], (last - first).astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
        head = place[inverse.ravel()]
        copies = np.flatnonzero(head != np.arange(len(head)))
        if len(copies):
            words, size = _numbers(seq), (last - first)[copies] + width
            differ = words[ranges(first[copies], size)] != words[ranges(first[head[copies]], size)]
            place = np.concatenate([place, copies[np.add.reduceat(differ, np.cumsum(size) - size) > 0]])
        place = np.sort(place)
        owner = numeric(ids)[np.searchsorted(np.cumsum(seq.sizes), first[place], "right")]
        out = []
        for b, at in by_bucket((hashes[place] % np.uint64(buckets)).astype(np.int64)):
            i = place[at]
            begin, end = seq.begin[first[i]], seq.end[last[i] + width - 1] + 1  # with the space after the last word
            out.append((b, 0, pack(first[i], (last[i] - first[i] + 1).astype(np.int32), owner[at], seq.data[ranges(begin, end - begin)].tobytes())))
        return out

    def compare(blobs: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        parts = [(block, *unpack(blob, np.int64, np.int32, np.int64, None)) for block, _, blob in blobs]
        number = Numbers()
        words = [np.fromiter(map(number.__getitem__, piece.split()), np.int64) for p in parts for piece in pieces(p[4])]
        ids = np.concatenate(words)
        n = np.concatenate([p[2] for p in parts]).astype(np.int64)
        own = np.repeat(np.concatenate([p[3] for p in parts]), n)
        size = n + width - 1
        at = ranges(np.cumsum(size) - size, n)
        owner = np.zeros(len(ids), np.int64)
        owner[at] = own
        least = np.zeros(len(ids), np.int64)
        for group in prefix_groups(ids, at, GROUP, width):
            least[group] = least_below_nodes(*subtree(ids, group, width, max(1, len(number).bit_length())), owner[group], width)
        hit = least[at] < own
        out, done = [], 0
        for block, first, count, *_ in parts:
            bits = hit[done : done + int(count.sum())]
            done += len(bits)
            if bits.any():
                out.append((block, 0, pack(first, count, np.packbits(bits))))
        return out

    def finish(ids: np.ndarray, texts: list[bytes], seq: Sequences, replies: list[tuple[int, bytes]]) -> pd.DataFrame:
        n = len(seq.codes)
        gone = np.zeros(n, bool)
        if n >= width:
            told = np.zeros(n, bool)
            for _, blob in replies:
                first, count, bits = unpack(blob, np.int64, np.int32, np.uint8)
                at = ranges(first, count.astype(np.int64))
                told[at[np.unpackbits(bits, count=len(at)).astype(bool)]] = True
            ends = np.cumsum(seq.sizes)
            starts = np.arange(n - width + 1)
            doc = np.searchsorted(ends, starts, "right")
            fits = starts + width <= ends[doc]
            starts, owner = starts[fits], numeric(ids)[doc[fits]]
            # The first of equal windows of a block has the least id and was judged; the others follow it.
            _, place, inverse = np.unique(window_hashes(seq.codes, width)[starts], return_index=True, return_inverse=True)
            head = place[inverse]
            copies = np.flatnonzero(head != np.arange(len(head)))
            words = _numbers(seq)
            for j in range(width):
                equal = words[starts[copies] + j] == words[starts[head[copies]] + j]
                head[copies[~equal]] = copies[~equal]
                copies = copies[equal]
            hit = told[starts] | told[starts[head]] | (owner > owner[head])
            edges = np.zeros(n + 1, np.int64)
            edges[starts[hit]] += 1
            edges[starts[hit] + width] -= 1
            gone = np.cumsum(edges[:-1]) > 0
        rows, at = [], 0
        for i, t, size in zip(ids, texts, seq.sizes.tolist(), strict=True):
            own = gone[at : at + size]
            words, spans = t.split(), []
            if own.any():
                words = compress(words, (~own).tolist())
                turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
            rows.append((i, size, b" ".join(words).decode("utf-8"), spans))
            at += size
        release_memory()
        return pd.DataFrame(rows, columns=[doc_id, "n_words", "kept", "spans"])

    schema = f"`{doc_id}` long, n_words long, kept string, spans array<struct<start:long,end:long>>"
    return find_repeats(blocked(docs, doc_id, text, blocks), buckets, width, k, _sequences, send, compare, finish, schema)
