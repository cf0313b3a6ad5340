"""Ordered steps over long sequences in chunks: neighbours, running totals, runs, exact medians and separated groups.

A sequence is cut into chunks of sample numbers; no task sorts more than a chunk. What a chunk needs of the others is held by
their edge rows or by one total: those few rows, one or two a chunk, are put in order over a whole sequence, apart from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000
#: Accuracy of the sketch that brackets a median.
ACCURACY = 10_000


def chunk_of(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk))


def _split(table: DataFrame, keys: list[str], order: str, chunk: int) -> DataFrame:
    """The rows as (keys, __chunk, __halo = 0, __o, __row)."""
    return table.select(*keys, chunk_of(order, chunk).alias("__chunk"), F.lit(0).alias("__halo"), F.col(order).alias("__o"), F.struct(*table.columns).alias("__row"))


def edge_window(keys: list[str], edge: Column, chunk: str, order: str):
    """The window in which the edge rows of a key's chunks meet; other rows stay with their chunk."""
    return Window.partitionBy(*keys, F.when(edge, F.lit(-1)).otherwise(F.pmod(F.col(chunk), F.lit(1 << 40)))).orderBy(order)


def neighbours(table: DataFrame, keys: list[str], columns: list[str], *, order: str = "sample", chunk: int = CHUNK) -> DataFrame:
    """``table`` with ``<column>__before`` and ``<column>__after``: the values in the row before and behind by ``order``; null at the ends.

    Order numbers may have gaps, and chunks may be empty. Rows that share one are neighbours in any order. The table
    is read once: within chunks each row sees its neighbours; then the first and last rows of chunks see each other.
    """
    local = Window.partitionBy(*keys, "__chunk").orderBy("__o")
    place = table.withColumns({"__chunk": chunk_of(order, chunk), "__o": F.col(order), "__v": F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))})
    inner = place.withColumns({"__a": F.lag("__v").over(local), "__b": F.lead("__v").over(local)})
    first, last = F.col("__a").isNull(), F.col("__b").isNull()
    across = edge_window(keys, first | last, "__chunk", "__o")
    outer = inner.withColumns({"__c": F.lag("__v").over(across), "__d": F.lead("__v").over(across)})
    before, after = F.when(first, F.col("__c")).otherwise(F.col("__a")), F.when(last, F.col("__d")).otherwise(F.col("__b"))
    beside = [side.getField(f"v{i}").alias(f"{c}__{name}") for i, c in enumerate(columns) for side, name in ((before, "before"), (after, "after"))]
    return outer.select(*table.columns, *beside)


def running_total(table: DataFrame, keys: list[str], value: Column, name: str, *, order: str = "sample", chunk: int = CHUNK) -> DataFrame:
    """``table`` with the sum of ``value`` over the rows up to and with each one by ``order``."""
    rows = _split(table.withColumn("__v", value), keys, order, chunk).withColumn("__v", F.col("__row.__v"))
    sums = rows.groupBy(*keys, "__chunk").agg(F.sum("__v").alias("__v"))
    before = F.sum("__v").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("__o", "__row")]
    offsets = sums.select(*keys, "__chunk", F.lit(-1).alias("__halo"), *blank, before.alias("__v")).where("__v IS NOT NULL")
    local = Window.partitionBy(*keys, "__chunk").orderBy("__halo", "__o").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.unionByName(offsets).withColumn("__total", F.sum("__v").over(local))
    return held.where("__halo = 0").select(*(F.col("__row").getField(c).alias(c) for c in table.columns if c != name), F.col("__total").alias(name))


def marked_runs(labels: DataFrame, keys: list[str], *, state: str, order: str = "sample", name: str = "run_id", chunk: int = CHUNK) -> DataFrame:
    """``labels`` with the number (from 0) of the maximal run of equal states that each row is in; null is a state."""
    beside = neighbours(labels.withColumn("__here", F.lit(True)), keys, [state, "__here"], order=order, chunk=chunk)
    new = F.col("__here__before").isNotNull() & ~F.col(state).eqNullSafe(F.col(f"{state}__before"))
    turned = beside.withColumn("__new", new.cast("long")).select(*labels.columns, "__new")
    return running_total(turned, keys, F.col("__new"), name, order=order, chunk=chunk).drop("__new")


def exact_median(table: DataFrame, keys: list[str], value: str, name: str, default: float | None = None) -> DataFrame:
    """The median of the values (nulls left out) of each key, the mean of the middle two of an even number; ``default`` without values.

    A mergeable sketch brackets the middle ranks (its ranks are off by ``1 / ACCURACY`` at most, the bracket is ten times
    wider); below the bracket rows are only counted, inside it equal values are, and those few are put in order.
    """
    held = table.select(*keys, F.col(value).cast("double").alias("__x"))
    aside = 10 / ACCURACY
    bracket = F.percentile_approx("__x", [0.5 - aside, 0.5 + aside], ACCURACY)
    sketch = held.groupBy(*keys).agg(bracket.alias("__b"), F.count("__x").alias("__total")).select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__b", "__total")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    both = (held.join(sketch, on) if on else held.crossJoin(F.broadcast(sketch))).where("__x IS NULL OR __x <= __b[1]")
    # Nulls first, counted as none; then all below the bracket; then its values.
    kind = F.expr("CASE WHEN __x IS NULL THEN 0 WHEN __x < __b[0] THEN 1 ELSE 2 END").alias("__kind")
    counted = both.groupBy(*keys, kind, F.expr("if(__x < __b[0], NULL, __x)").alias("__v")).agg(F.count("__x").alias("__n"), F.first("__total").alias("__total"))
    counted = counted.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__kind", "__v")))
    ranks = [F.max(F.expr(f"if({r} < __upto AND {r} >= __upto - __n, __v, NULL)")) for r in ("(__total - 1) div 2", "__total div 2")]
    return counted.groupBy(*keys).agg(F.coalesce((ranks[0] + ranks[1]) / 2, F.lit(default)).alias(name))


def separated(table: DataFrame, keys: list[str], *, gap: int, order: str = "sample", name: str = "group_id", chunk: int = CHUNK) -> DataFrame:
    """``table`` with the number (from 0) of the group that each row is in; a group ends where the next row is ``gap`` or more further on."""
    beside = neighbours(table, keys, [order], order=order, chunk=chunk)
    new = F.coalesce((F.col(order) - F.col(f"{order}__before") >= gap).cast("long"), F.lit(0))
    turned = beside.withColumn("__new", new).select(*table.columns, "__new")
    return running_total(turned, keys, F.col("__new"), name, order=order, chunk=chunk).drop("__new")
