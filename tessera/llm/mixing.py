"""Mixing sources to target weights.

A document's size is its number of words. Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and
share ``share`` times all words; no target exceeds ``most`` times its source's size, what is above goes to the others
by weight until none is above. A source's rate is its target over its size. Each document is taken floor(rate) times,
plus once more if a uniform number hashed from the seed and its id is below the fraction.

Null or empty texts have size 0. A source without words has target and rate 0. Rows that share an id are hashed alike;
rows without an id by their text, so that a source of them comes near its target too.
The hot source costs nothing extra: sums are combined before the shuffle, and rates return by broadcast (or, beyond
``BROADCAST_ROWS`` sources, by a join that Spark splits where skewed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, hash_bits, materialize, ordered_index, small

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def source_targets(sized: DataFrame, *, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(__source, source_size, target) for each source; ``sized`` has the columns ``source`` and size."""
    sums = sized.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"))
    ranked = ordered_index(sums, [F.col("__source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("__source", "source_size", weight.cast("long").alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0  # words for each unit of weight
    while True:
        full = F.col("weight") * F.lit(unit) >= F.col("source_size") * F.lit(most)
        row = table.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            break
        raised = (share * total - most * (row[0] or 0)) / row[1]
        if raised <= unit:
            break
        unit = raised
    target = F.least(F.col("weight") * F.lit(unit), F.col("source_size") * F.lit(most))
    return table.select("__source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with __size, __source_size, __target, __rate and __copies."""
    sized = docs.withColumn("__size", word_count(F.col(text)))
    targets = materialize(source_targets(sized.select(source, F.col("__size").alias("size")), source=source, share=share, most=most))
    table = targets.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    joined = sized.join(small(table, targets.count()), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(most))).otherwise(F.lit(0.0))
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    uniform = hash_bits(key, f"{seed}:", 13) / F.lit(float(1 << 52))
    return joined.withColumn("__rate", rate).withColumn("__copies", (F.floor("__rate") + (uniform < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long"))


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies of each row; columns of those names are replaced."""
    names = ("size", "source_size", "target", "rate", "copies")
    planned = _planned(docs, **options)
    return planned.select(*(c for c in docs.columns if c not in names), *(F.col(f"__{c}").alias(c) for c in names))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    planned = _planned(docs, **options)
    return planned.withColumn("__copy", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies").cast("int"))))).select(*docs.columns)
