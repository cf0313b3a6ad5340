"""Ranked lexical search by sort-based accumulation.

All documents are ranked for each item of a query set. Terms are runs of ASCII letters and digits and of characters from
U+0080 on, A-Z lower-cased. With N documents that have a term, L terms in them (repeats count), n terms of a document, df
documents with a term and tf its occurrences in the document, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1)));
a document's score is the sum over the item's distinct terms of w * ((10^9 * tf) div (1000 * tf + 8 * m)), where m = 100 -
``LENGTH`` + ((``LENGTH`` * n * N) div L). Only w takes doubles.

Documents stay where the scan puts them: a task owns all keys (item, document) of its range of rows. For a bounded part of
them it lays the matched (item, document, impact) entries end to end, sorts the packed keys by radix (16 bits a pass), and adds the impacts
of each key with ``reduceat``. A heap of k for each item takes what beats its worst member; others are dropped before the
heap by comparing arrays. Tasks send k rows an item, which are ranked in groups of ``GROUPED`` tasks, then over all.

Items are dealt to slices of ``SLICE_BYTES`` bytes by a hash of their row; each slice is two passes over the documents: counts
of its terms, then scores. Its terms, with weights, go to all tasks.

Null texts have no terms. An item without terms in any document has no rows. Rows are judged each for itself: repeated
items get a ranking each, repeated documents a rank each. Equal scores rank by ascending document id, null last. Ids are
read as longs; item ids keep their type.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, materialize, release_memory
from tessera.llm.repeats import ranges
from tessera.llm.substring_dedup import Numbers

#: Weight of a document's length, in hundredths.
LENGTH = 90
#: Bytes of items whose terms go to all tasks at once, and of documents that are laid out at once.
SLICE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: Entries that are sorted at once; those of one document may be more.
ENTRIES = 2_000_000
#: Tasks whose best rows are ranked together first.
GROUPED = 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20

TERM, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    text, start = text or b"", 0
    while start < len(text):
        gap = GAP.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[start:end].lower())  # of bytes, lower() only changes A-Z
        start = end


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, by 16 bits a pass."""
    order, top = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), int(keys.max(initial=0))
    for shift in range(16, top.bit_length(), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(values[order], heads)


class Items:
    """A slice of the items: numbers of their distinct terms, and for each term the items that have it."""

    def __init__(self, texts: list[bytes | None]) -> None:
        number = Numbers()
        own = [sorted({number[t] for part in terms(text) for t in part}) for text in texts]
        self.number = dict(number)
        term = np.fromiter((t for o in own for t in o), np.int64)
        item = np.repeat(np.arange(len(own)), [len(o) for o in own]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.items, self.n_items = item[order], len(texts)
        self.count = np.bincount(term, minlength=len(number)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def postings(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """(document, term, tf) of the texts' terms that items have, by document; and the terms of each text."""
        found, size, n = [], [], []
        for text in texts:
            total = known = 0
            for part in terms(text):
                hit = [self.number[t] for t in part if t in self.number]
                found += hit
                total += len(part)
                known += len(hit)
            size.append(known)
            n.append(total)
        width = max(1, len(self.number))
        keys = np.repeat(np.arange(len(texts), dtype=np.int64), size) * width + np.array(found, np.int64)
        pair, tf = summed(keys, np.ones(len(keys), np.int64))
        return pair // width, pair % width, tf, np.array(n, np.int64)


class Best:
    """The k best documents of each item so far, as heaps of (score, has an id, -id)."""

    def __init__(self, items: int, k: int) -> None:
        self.heaps: list[list] = [[] for _ in range(items)]
        self.k, self.bar = k, np.ones(items, np.int64)

    def add(self, item: np.ndarray, ids: np.ndarray, known: np.ndarray, score: np.ndarray) -> None:
        """Rows by item; ``ids`` count where ``known``."""
        stay = score >= self.bar[item]
        item, ids, known, score = item[stay], ids[stay], known[stay], score[stay]
        order = np.lexsort([ids, ~known, -score, item])
        head = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]])) if len(order) else order
        place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        for i in order[place < self.k].tolist():
            heap, row = self.heaps[item[i]], (int(score[i]), bool(known[i]), -int(ids[i]))
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            else:
                heapq.heappushpop(heap, row)
            if len(heap) == self.k:
                self.bar[item[i]] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(i, -neg if known else None, score) for i, heap in enumerate(self.heaps) for score, known, neg in heap]


def accumulate(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, ids: pa.Array, texts: list[bytes | None], best: Best) -> None:
    """Score a batch of documents against all items of a slice."""
    doc, term, tf, n = items.postings(texts)
    long = np.array([100 - LENGTH + (LENGTH * x * n_docs) // max(1, n_terms) for x in n.tolist()], np.int64)
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * long[doc]))
    known = ~np.asarray(ids.is_null())
    number = np.asarray(ids.fill_null(0)).astype(np.int64)
    entries = items.count[term]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))  # postings of each document
    upto = np.concatenate([[0], np.cumsum(entries)])[cut]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + ENTRIES, "right")) - 1)
        part = slice(cut[a], cut[b])
        each = entries[part]
        width = b - a
        item = items.items[ranges(items.first[term[part]], each)]
        keys, score = summed(item * width + np.repeat(doc[part] - a, each), np.repeat(impact[part], each))
        own = keys % width + a
        best.add(keys // width, number[own], known[own], score)
        a = b


def _rank_slice(docs: DataFrame, texts: list[bytes | None], numbers: list[int], k: int) -> DataFrame:
    """(item, part, doc, score): k rows an item and task at most."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Items(texts))  # of SLICE_BYTES, or one item

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        df, with_terms, all_terms = np.zeros(len(items.number), np.int64), 0, 0
        for batch in batches:
            for _, part in bounded(batch.column(0), batch.column(1), BATCH_BYTES):
                _, term, _, n = items.postings(part)
                df += np.bincount(term, minlength=len(df))
                with_terms += int((n > 0).sum())
                all_terms += int(n.sum())
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *hit.tolist()], pa.int64()), pa.array([with_terms, all_terms, *df[hit].tolist()], pa.int64())], ["term", "n"])

    counted = {r["term"]: r["n"] for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the slice
    n_docs, n_terms = counted.get(-1, 0), counted.get(-2, 0)
    terms_of = range(len(shared.value.number))
    weight = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1))) for t in terms_of], np.int64))
    mine = spark.sparkContext.broadcast(np.array(numbers, np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items = shared.value
        best = Best(items.n_items, k)
        for batch in batches:
            for ids, part in bounded(batch.column(0), batch.column(1), BATCH_BYTES):
                accumulate(items, weight.value, n_docs, n_terms, ids, part, best)
        rows = best.rows()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"item": int(mine.value[i]), "part": task, "doc": d, "score": s} for i, d, s in rows], pa.schema([("item", pa.int64()), ("part", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())]))
        release_memory()

    return docs.mapInArrow(score, "item long, part long, doc long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ranked from 1."""
    queries = materialize(items.select(F.col(item_id).alias("__id"), F.col(item_text).cast("binary").alias("__text"), F.monotonically_increasing_id().alias("__item")))
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    slices = -(-(queries.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // SLICE_BYTES) or 1
    found = []
    for s in range(slices):
        own: pd.DataFrame = queries.where(F.pmod(F.xxhash64("__item"), F.lit(slices)) == s).select("__item", "__text").toPandas()  # about SLICE_BYTES
        found.append(_rank_slice(corpus, list(own["__text"]), own["__item"].tolist(), k))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    among = Window.partitionBy("item", "group").orderBy(*order)
    first = reduce(DataFrame.unionByName, found).withColumn("group", F.expr(f"part div {GROUPED}")).withColumn("rank", F.row_number().over(among)).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = last.join(queries.select(F.col("__item").alias("item"), "__id"), "item")
    return named.select(F.col("__id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
