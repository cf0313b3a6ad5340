"""Suffix-array dedup: removal of bytes covered by long repeats, by longest-previous-factor arrays.

A byte goes if a suffix that starts at most ``width`` - 1 bytes before it has a longest previous (or next) factor of
``width`` bytes. Only suffixes whose first ``width`` bytes hold a repeated anchor can have one (see ``repeats``); they
are dealt to buckets by the anchor, with the bytes that follow. There they are put in suffix order, and the nearest
smaller (larger) places on both sides in that order give the previous (next) factors. Suffix order is that of 64-bit
fingerprints of the suffixes' anchors and of their first ``width`` bytes, not of the bytes: suffixes that share
``width`` bytes are neighbours in either, and only that length is asked for (128 bits tell different ones apart).

``keep="none"`` removes the bytes of every copy, ``keep="first"`` those of copies with an earlier match only (documents
in the order of their ids, null first). Lengths are judged on the input. Null texts are empty; texts under ``width``
bytes lose nothing. Rows that share an id are separate documents, in the order of their texts. Ids are read as longs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import release_memory
from tessera.llm.repeats import Sequences, blocked, by_bucket, counts_for, find_repeats, hashes_at, numeric, pack, ranges, unpack, window_hashes

K = 64
CONTEXT, ALL = 0, 1
#: Bytes of suffixes that are ordered at once.
PART_BYTES = 1_500_000


def _sequences(texts: list[bytes]) -> Sequences:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return Sequences(data, np.array([len(t) for t in texts], np.int64))


def shared_with_smaller(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What each suffix shares with the nearest one before it in suffix order that has a smaller place; 0 without one.

    ``common`` is what each shares with the one just before. Candidates jump along the candidates of larger places, for
    all suffixes at once, so the steps grow with the logarithm of a run's length.
    """
    before, out = np.arange(len(places)) - 1, common.copy()
    if len(out):
        out[0] = 0
    open_ = np.flatnonzero(out > 0)
    while len(open_ := open_[places[before[open_]] > places[open_]]):
        via = before[open_]
        out[open_], before[open_] = np.minimum(out[open_], out[via]), before[via]
        open_ = open_[out[open_] > 0]
    return out


def longest_previous_factors(levels: list[tuple[np.ndarray, int]], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factors of suffixes, in the lengths of ``levels``.

    ``levels`` are fingerprints of the suffixes' beginnings with their lengths, rising; ``order`` is their place in the
    corpus. Suffix order sorts by the levels, then place. A suffix's previous factor is the longer of what it shares with
    the nearest suffixes before and behind it in that order whose place is smaller; its next factor, larger.
    """
    read = np.lexsort([*reversed(order)])
    places = np.lexsort([key[read] for key, _ in reversed(levels)])  # stable: the places of the corpus, in suffix order
    at = read[places]
    common, same = np.zeros(len(at), np.int64), np.ones(max(0, len(at) - 1), bool)
    for key, length in levels:
        same &= key[at[1:]] == key[at[:-1]]
        common[1:][same] = length
    behind = np.append(common[1:], 0)[::-1]
    previous, following = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    previous[at] = np.maximum(shared_with_smaller(places, common), shared_with_smaller(places[::-1], behind)[::-1])
    following[at] = np.maximum(shared_with_smaller(-places, common), shared_with_smaller(-places[::-1], behind)[::-1])
    return previous, following


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 200, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans): what is left of each document, and the removed runs (start, end) in bytes."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep: {keep}")
    k = min(K, width)
    blocks, buckets = counts_for(docs, text)

    def send(block: int, ids: np.ndarray, seq: Sequences, runs: tuple) -> list[tuple[int, int, bytes]]:
        hashes, first, last = runs
        if not len(hashes):
            return []
        # Runs with equal bytes: one is compared with other blocks, the rest are known to repeat.
        # (Less than ``width`` windows have one anchor: the first and the last of them cover the run.)
        whole = np.stack([hashes, hashes_at(seq.codes, first, width), hashes_at(seq.codes, last, width), (last - first).astype(np.uint64)], 1)
        _, place, inverse, counts = np.unique(whole, axis=0, return_index=True, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        known = counts[inverse] > 1
        if keep == "first":
            known &= place[inverse] != np.arange(len(hashes))
        out = []
        if known.any():
            n = last[known] - first[known] + 1
            out.append((-1 - block, ALL, pack(np.full(1, block), first[known], n, np.zeros(0, np.uint8))))
        place = np.sort(place)
        if keep == "none":
            settled = known[place]
        else:
            settled = np.zeros(len(place), bool)
        ends = np.cumsum(seq.sizes)
        begins, doc = ends - seq.sizes, np.searchsorted(ends, first[place], "right")
        document, offset = numeric(ids)[doc], first[place] - begins[doc]
        for b, at in by_bucket((hashes[place] % np.uint64(buckets)).astype(np.int64)):
            i = place[at]
            n = last[i] - first[i] + 1
            data = seq.codes[ranges(first[i], n + width - 1)]
            out.append((b, CONTEXT, pack(hashes[i], first[i], n.astype(np.int32), document[at], offset[at], settled[at].astype(np.uint8), data.tobytes())))
        return out

    def compare(blobs: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        out = [(block, ALL, blob) for block, kind, blob in blobs if kind == ALL]
        parts = [(block, *unpack(blob, np.uint64, np.int64, np.int32, np.int64, np.int64, np.uint8, None)) for block, kind, blob in blobs if kind == CONTEXT]
        if not parts:
            return out
        hashes, n, document, offset, settled = (np.concatenate([p[i] for p in parts]) for i in (1, 3, 4, 5, 6))
        data = np.frombuffer(b"".join(p[7] for p in parts), np.uint8)
        n = n.astype(np.int64)
        size = n + width - 1
        begins, places = np.cumsum(size) - size, np.cumsum(n) - n
        hit = np.zeros(int(n.sum()), bool)
        # Only suffixes with one anchor are compared, so a large bucket is done in parts.
        splits = -(-len(data) // PART_BYTES)
        part = (hashes // np.uint64(buckets)) % np.uint64(splits)
        for j in range(splits):
            i = np.flatnonzero(part == j)
            if not len(i):
                continue
            local = np.cumsum(size[i]) - size[i]
            at = ranges(local, n[i])  # window starts in the part's data
            marks = window_hashes(data[ranges(begins[i], size[i])], width)[at]
            inside = at - np.repeat(local, n[i])
            levels = [(np.repeat(hashes[i], n[i]), k), (marks, width)]
            previous, following = longest_previous_factors(levels, [np.repeat(document[i], n[i]), np.repeat(offset[i], n[i]) + inside])
            copy = previous if keep == "first" else np.maximum(previous, following)
            hit[ranges(places[i], n[i])] = (copy >= width) | (np.repeat(settled[i], n[i]).astype(bool) & (keep == "none"))
        done = 0
        for block, _, first, count, *_ in parts:
            count = count.astype(np.int64)
            bits = hit[done : done + int(count.sum())]
            done += len(bits)
            if bits.any():
                out.append((block, CONTEXT, pack(np.full(1, block), first, count, np.packbits(bits))))
        return out

    def finish(ids: np.ndarray, texts: list[bytes], seq: Sequences, replies: list[tuple[int, bytes]]) -> pd.DataFrame:
        starts = []
        for kind, blob in replies:
            _, first, count, bits = unpack(blob, np.int64, np.int64, np.int64, np.uint8)
            at = ranges(first, count)
            starts.append(at[np.unpackbits(bits, count=len(at)).astype(bool)] if kind == CONTEXT else at)
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        edges = np.bincount(at, minlength=len(seq.codes) + 1) - np.bincount(at + width, minlength=len(seq.codes) + 1)
        gone = np.cumsum(edges[:-1]) > 0
        rows, at = [], 0
        for i, t in zip(ids, texts, strict=True):
            own = gone[at : at + len(t)]
            kept, spans = t, []
            if own.any():
                kept = seq.codes[at : at + len(t)][~own].tobytes()
                turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
            rows.append((i, len(t), kept, spans))
            at += len(t)
        release_memory()
        return pd.DataFrame(rows, columns=[doc_id, "n_bytes", "kept", "spans"])

    return find_repeats(
        blocked(docs, doc_id, text, blocks), buckets, width, k, _sequences, send, compare, finish, f"`{doc_id}` long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    )
