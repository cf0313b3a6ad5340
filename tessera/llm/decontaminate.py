"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items (short) are sought inside documents (long). An item's words are the maximal runs of letters and digits of its
lower-cased text; its set holds its distinct shingles of ``width`` words. A document contains an item when it has at
least ``threshold`` of the item's set.

Items are partitioned by set size (powers of two). Each partition has one sketch length, computed from its upper size
bound u as u - ceil(threshold * u) + 1: of any so many members of a set, a document that contains the item has one.
The sketch of an item is that many of its smallest shingle hashes (bottom-k MinHash), so probing the documents' shingle
hashes with the sketches loses nothing, whatever the ratio of sizes. Documents that hit a sketch are verified with the
shingles themselves: of their shingles those whose hash an item has are compared as texts, and counted.

Null or empty texts and texts under ``width`` words have no shingles: as documents they contain nothing, as items they
are never reported. Repeated rows are verified one by one and reported once for each (doc_id, item_id) and outcome.
Null ids are ids, but documents with a null id are told apart by their text, so that one leak doesn't remove the others.
Items that share an id are sought one by one. ``decontaminate`` drops every row of an id of which one row leaks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small

#: Rows of the items' sketches or shingles (some hundred bytes each at most) that are broadcast at once.
PROBE_ROWS = 1 << 18
WORD_BREAK = r"[^\p{L}\p{N}]+"


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def _hash(first: Column, words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(first, *(F.get(words, at + i) for i in range(1, width)))


def _probes(texts: DataFrame, kept: list[str], width: int) -> DataFrame:
    """A row for each run of ``width`` words of the column __text: ``kept``, the words, where the run starts, and its hash."""
    # The array of words stays a variable of the generated loop: no row is copied for a probe.
    return (
        texts.select(*kept, word_array(F.col("__text")).alias("__words"))
        .select(*kept, "__words", F.posexplode("__words").alias("__at", "__first"))
        .where(F.col("__at") <= F.size("__words") - width)
        .select(*kept, "__words", "__at", _hash(F.col("__first"), F.col("__words"), F.col("__at"), width).alias("__h"))
    )


def _shingle(width: int) -> Column:
    return F.expr(f"array_join(slice(__words, __at + 1, {width}), ' ')")


def item_shingles(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item_id, __h, __shingle, __n): the distinct shingles of each item, with their number."""
    each = _probes(items.select(F.col(item_id), F.col(text).alias("__text")), [item_id], width)
    # Rows with one id but several texts are several items.
    each = each.select(item_id, F.xxhash64("__words").alias("__version"), "__h", _shingle(width).alias("__shingle")).distinct()
    sizes = each.groupBy(item_id, "__version").agg(F.count("*").alias("__n"))
    same = F.col("__i").eqNullSafe(F.col(item_id)) & (F.col("__v") == F.col("__version"))
    return each.join(sizes.select(F.col(item_id).alias("__i"), F.col("__version").alias("__v"), "__n"), same).drop("__i", "__v")


def sketches(shingles: DataFrame, item_id: str, threshold: float) -> DataFrame:
    """(__h, item_id, __version): the bottom hashes of each item, their number set by the item's size partition."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("__n"))) + 1) - 1
    length = upper - F.ceil(upper * F.lit(threshold)) + 1
    rank = F.row_number().over(Window.partitionBy(item_id, "__version").orderBy("__h", "__shingle"))
    return shingles.withColumn("__rank", rank).where(F.col("__rank") <= length).select("__h", item_id, "__version").distinct()


def _unnamed(doc_id: Column, text: Column) -> Column:
    """A hash of the text where the id is null."""
    return F.when(doc_id.isNull(), F.md5(text))


def _in_slices(probes: DataFrame, table: DataFrame, rows: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The join of probes with a table by __h, broadcast in slices of at most PROBE_ROWS rows: the shingles of the corpus never travel."""
    n = max(1, -(-rows // PROBE_ROWS))
    parts = [join(probes, F.broadcast(table.where(F.pmod("__h", F.lit(n)) == k) if n > 1 else table)) for k in range(n)]
    return reduce(DataFrame.unionByName, parts)


def find_contained(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every contained item."""
    return _contained(docs, items, doc_id=doc_id, item_id=item_id, **options).drop("__null").distinct()


def _contained(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """The same, with the text's hash of documents without an id."""
    # As a struct, a null id is a value that sets hold and joins find.
    named = items.select(F.struct(F.col(item_id).alias("id")).alias("__item"), F.col(item_text).alias("__text"))
    shingles = materialize(item_shingles(named, "__item", "__text", width))
    sketch = materialize(sketches(shingles, "__item", threshold))
    own = docs.select(F.col(doc_id).alias("__doc"), _unnamed(F.col(doc_id), F.col(text)).alias("__null"), F.col(text).alias("__text"))

    met = _in_slices(_probes(own, ["__doc", "__null"], width), sketch, sketch.count(), lambda p, t: p.join(t, "__h").select("__doc", "__null", "__item", "__version"))
    hits = materialize(met.distinct())
    # Only the hit documents are read again, and their shingles compared with those of the items.
    asked = materialize(hits.select(F.col("__doc").alias("__d"), F.col("__null").alias("__u")).distinct())
    again = own.join(small(asked, asked.count()), F.col("__doc").eqNullSafe(F.col("__d")) & F.col("__null").eqNullSafe(F.col("__u")), "left_semi")
    row = again.withColumn("__row", F.xxhash64("__text"))
    exact = lambda p, t: p.join(t, "__h").where(_shingle(width) == F.col("__shingle")).select("__doc", "__null", "__row", "__item", "__version", "__n", "__shingle")
    shared = _in_slices(_probes(row, ["__doc", "__null", "__row"], width), shingles, shingles.count(), exact).distinct()
    counted = shared.groupBy("__doc", "__null", "__row", "__item", "__version", "__n").agg(F.count("*").alias("n_shared"))
    verified = counted.where(F.col("n_shared") >= F.col("__n") * F.lit(threshold))
    return verified.select(
        F.col("__doc").alias(doc_id),
        "__null",
        F.col("__item.id").alias(item_id),
        F.col("__n").cast("long").alias("n_item_shingles"),
        F.col("n_shared").cast("long").alias("n_shared"),
        F.round(F.col("n_shared") / F.col("__n"), 9).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their columns."""
    key, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    leaked = materialize(_contained(docs, items, **options).select(F.col(key).alias("__leaked"), "__null").distinct())
    same = docs[key].eqNullSafe(F.col("__leaked")) & _unnamed(docs[key], docs[text]).eqNullSafe(F.col("__null"))
    return docs.join(small(leaked, leaked.count()), same, "left_anti")
