"""Periodic runs of words by the suffix-tree method for tandem repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``least`` and ``times`` * q words that no neighbouring word extends keeping period q.

Each document has a suffix tree of its words, here as suffix order with common prefix lengths: an inner node of depth d is
an interval of suffixes that share d words. Documents of a batch are sorted together with the document as first key, so
nodes never span two. A tandem repeat of root length d at place i is branching if the word after its first half differs
from the one after its second; then d is the depth of the deepest node over i and i + d. So for each node, the leaves below
all its children but the largest (the smaller halves: n log n in all) are asked whether the leaf d places behind or
ahead lies below the node too, and the words after differ. Each run holds exactly one branching repeat of its period, at
its right end. Rotated to the left, that is, extended by the words that repeat before it, it gives the maximal run;
repeats of multiples of a period give the same stretch again and are merged into the one of the smallest period.

All steps are array operations over batches. Prefix doubling keeps, for each length 1, 2, 4, ..., classes of equal
windows only of places where they repeat; these give common prefixes and extensions as well. Memory grows with the longest text,
by some 200 bytes a word. Words are compared themselves, not by hashes.

Null texts and texts without words have no run and an empty collapse. Rows are judged alone, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, release_memory
from tessera.llm.repeats import ranges
from tessera.llm.substring_dedup import Numbers

#: Bytes of text that are laid out at once; a longer text makes a batch of its own.
BATCH_BYTES = 2_000_000


class Suffixes:
    """The suffixes of several documents in order, documents apart.

    ``order`` has the places, ``rank`` the inverse, ``common`` what each shares with the one before (0 for the first of a
    document). ``levels`` has, from length 1 upwards, (length, slots whose suffix shares that length with the one
    before, places whose window of that length repeats in the document, the windows' classes).
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        n = len(codes)
        ends = np.cumsum(sizes)
        self.codes, self.end_of, self.begin_of = codes, np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(keys, kind="stable")
        self.rank = np.empty(n + 1, np.int64)
        self.rank[n] = -1
        slots, keys, length = np.arange(n), keys[self.order], 1
        while len(slots):
            slots = self._refine(slots, keys)
            if not len(slots):
                break
            at = self.order[slots]
            classes = self.rank[at]
            inner = slots[1:][(classes[1:] == classes[:-1])]
            self.levels.append((length, inner, at, classes))
            behind = at + length
            inside = behind < self.end_of[at]
            follows = np.where(inside, self.rank[np.where(inside, behind, n)], -1)
            keys = classes * (n + 1) + follows + 1
            new = np.argsort(keys, kind="stable")
            self.order[slots] = at[new]
            keys = keys[new]
            length *= 2
        self.common = self._common()

    def _refine(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give the suffixes in ``slots`` the slot of the first with an equal key as rank; returns the slots of ties."""
        head = np.ones(len(slots), bool)
        head[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(slots)))
        self.rank[self.order[slots]] = np.repeat(slots[first], size)
        return slots[np.repeat(size > 1, size)]

    def classes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From the longest length down: length, inner slots, and the class of each place's window (below 0: it repeats nowhere)."""
        for length, inner, at, classes in reversed(self.levels):
            dense = np.full(len(self.codes) + 1, -1, np.int64)
            dense[at] = classes
            yield length, inner, dense

    def _common(self) -> np.ndarray:
        common = np.zeros(len(self.codes), np.int64)
        for length, inner, dense in self.classes():
            a = dense[self.order[inner - 1] + common[inner]]
            b = dense[self.order[inner] + common[inner]]
            common[inner] += np.where((a == b) & (a >= 0), length, 0)
        return common

    def extend_left(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``place`` equal those before ``place + period``, in the same document."""
        out, least = np.zeros(len(place), np.int64), self.begin_of[place]
        for length, _, dense in self.classes():
            x = place - out - length
            fits = np.flatnonzero(x >= least)
            a, b = dense[x[fits]], dense[x[fits] + period[fits]]
            out[fits] += np.where((a == b) & (a >= 0), length, 0)
        return out


def nearest_below(common: np.ndarray, slots: np.ndarray, step: int) -> np.ndarray:
    """For each slot the nearest one (step -1: before, 1: behind) with a smaller value; jumps along those of larger values."""
    near = np.arange(len(common)) + step
    open_ = slots
    while len(open_ := open_[common[near[open_]] >= common[open_]]):
        near[open_] = near[near[open_]]
    return near[slots]


def smaller_halves(common: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(slots, depth, first, end): the leaves below all children but the largest of each inner node, with the node."""
    slots = np.flatnonzero(common > 0)
    if not len(slots):
        return
    walled = np.append(common, -1)  # the last slot's neighbour; slot 0 has no common prefix
    first, end, depth = nearest_below(walled, slots, -1), nearest_below(walled, slots, 1), common[slots]
    by_node = np.argsort(first * (int(depth.max()) + 1) + depth, kind="stable")
    slots, first, end, depth = slots[by_node], first[by_node], end[by_node], depth[by_node]
    new = np.ones(len(slots), bool)
    new[1:] = (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(new)
    splits = np.diff(np.append(heads, len(slots)))
    # A node's children begin at its first slot and at each split.
    begins = np.insert(slots, heads, first[heads])
    node = np.repeat(np.arange(len(heads)), splits + 1)
    last = np.append(node[1:] != node[:-1], True)
    ends = np.append(begins[1:], 0)
    ends[last] = end[heads]
    size = ends - begins
    edge = np.cumsum(splits + 1) - (splits + 1)
    largest = np.flatnonzero(size == np.repeat(np.maximum.reduceat(size, edge), splits + 1))
    small = np.ones(len(begins), bool)
    small[largest[np.unique(node[largest], return_index=True)[1]]] = False
    begins, size, node = begins[small], size[small], heads[node[small]]
    yield ranges(begins, size), np.repeat(depth[node], size), np.repeat(first[node], size), np.repeat(end[node], size)


def branching_repeats(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, root length) of the branching tandem repeats."""
    places, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n, codes = len(suffixes.codes), np.append(suffixes.codes, -1)
    for slots, depth, first, end in smaller_halves(suffixes.common):
        leaf = suffixes.order[slots]
        for start in (leaf, leaf - depth):
            other = np.where(start == leaf, leaf + depth, start)
            rank = suffixes.rank[np.where((other >= 0) & (other < n), other, n)]
            hit = np.flatnonzero((rank >= first) & (rank < end))
            at, root = start[hit], depth[hit]
            behind = at + 2 * root
            ended = behind >= suffixes.end_of[at]
            branches = ended | (codes[at + root] != codes[np.where(ended, n, behind)])
            places.append(at[branches])
            roots.append(root[branches])
    place, root = np.concatenate(places), np.concatenate(roots)
    _, once = np.unique(place * (n + 1) + root, return_index=True)
    return place[once], root[once]


def maximal_runs(codes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of documents laid end to end, by start, then period."""
    suffixes = Suffixes(codes, sizes)
    place, period = branching_repeats(suffixes)
    end = place + 2 * period
    start = place - suffixes.extend_left(place, period) if len(place) else place
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort([period, end, start])
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort([period, start])
    return start[by], end[by], period[by]


def collapse(texts: list[str | None], least: int, times: int) -> list[tuple[int, list[dict], str]]:
    """Number of words, runs and collapsed text of each text."""
    words = [(t or "").encode("utf-8").split() for t in texts]
    number = Numbers()
    codes = np.fromiter((number[w] for own in words for w in own), np.int64)
    sizes = np.array([len(own) for own in words], np.int64)
    start, end, period = maximal_runs(codes, sizes, least, times)
    turns = np.zeros(len(codes) + 1, np.int64)
    np.add.at(turns, start + period, 1)
    np.add.at(turns, end, -1)
    kept = np.cumsum(turns[:-1]) == 0
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(start, np.append(begins, len(codes)))
    out = []
    for i, own in enumerate(words):
        found = slice(cuts[i], cuts[i + 1])
        runs = [{"start": int(s - begins[i]), "length": int(e - s), "period": int(q)} for s, e, q in zip(start[found], end[found], period[found], strict=True)]
        stay = compress(own, kept[begins[i] : begins[i] + sizes[i]].tolist()) if runs else own
        out.append((len(own), runs, b" ".join(stay).decode("utf-8")))
    return out


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs (start, length, period) by start, then period; of each run's words the collapsed text keeps the first period.

    A word goes if any run contains it after that run's first ``period`` words; those that stay are joined by one space.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in bounded(batch.column(0), batch.column(1), BATCH_BYTES):
                words, runs, collapsed = zip(*collapse(texts, least, times), strict=True)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])
        release_memory()

    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    judged = docs.select(F.col(doc_id), F.col(text)).mapInArrow(judge, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return judged.withColumnRenamed("id", doc_id)
