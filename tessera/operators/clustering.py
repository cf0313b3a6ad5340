"""Clusters of unit patterns regardless of sign, over all patients at once.

The templates (a few rows) go to all tasks; each returns, for every template, the sum of its patterns turned to the
template's sign and their number, and Spark adds these. No task holds more than a batch of patterns. Draws are by row number in
the order of keys and samples, from the same stream as ``kernels.polarity_clusters``, whose result on one group this equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import vectors as V
from tessera.operators.chunks import CHUNK, running_total


def numbered(table: DataFrame, keys: list[str], *, order: str = "sample", name: str = "row", chunk: int = CHUNK) -> DataFrame:
    """``table`` with its row number (from 0) by keys, then ``order``; only counts, a row for each key, are put in order as a whole."""
    sizes = table.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(k).alias(f"__k_{k}") for k in keys), before.alias("__before"))
    own = running_total(table, keys, F.lit(1).cast("long"), "__own", order=order, chunk=chunk)
    placed = own.join(offsets, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return placed.select(*table.columns, (F.col("__before") + F.col("__own") - 1).alias(name))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _step(patterns: DataFrame, templates: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some starts (start, template, channel): turned sums, sizes, and how many patterns chose differently before."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, k, width = templates.shape
        sums, sizes, changed = np.zeros(templates.shape), np.zeros((starts, k), np.int64), np.zeros(starts, np.int64)
        for batch in batches:
            matrix = _matrix(batch)
            for s in range(starts):
                product = matrix @ templates[s].T
                chosen = np.abs(product).argmax(axis=1)
                sign = np.where(product[np.arange(len(matrix)), chosen] < 0, -1.0, 1.0)
                np.add.at(sums[s], chosen, matrix * sign[:, None])
                sizes[s] += np.bincount(chosen, minlength=k)
                was = np.abs(matrix @ before[s].T).argmax(axis=1) if before is not None else 0
                changed[s] += int((chosen != was).sum())
        values = np.concatenate([sums, sizes[:, :, None], np.repeat(changed[:, None, None], k, 1)], axis=2).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    found = patterns.mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # as many as the templates have values
    flat = np.zeros(templates.size // templates.shape[2] * (templates.shape[2] + 2))
    for row in found:
        flat[row["at"]] = row["value"]
    table = flat.reshape(*templates.shape[:2], -1)
    return table[:, :, :-2], np.rint(table[:, :, -2]).astype(np.int64), np.rint(table[:, 0, -1]).astype(np.int64)


def polarity_templates(patterns: DataFrame, k: int, seeds: list[int], keys: list[str], *, order: str = "sample", pattern: str = "pattern", rounds: int = 50, chunk: int = CHUNK) -> list[np.ndarray]:
    """Templates of each seeded start, in lexicographic order; all starts move in one pass over the patterns."""
    rows = numbered(patterns.select(*keys, order, F.col(pattern).cast("array<double>").alias("__p")), keys, order=order, chunk=chunk).select("__p", "row").persist()
    try:
        n = rows.count()
        if not n:
            return [np.zeros((0, 0)) for _ in seeds]
        k = max(1, min(k, n))
        if k == 1:
            one = np.array([[r["v"] for r in rows.select(F.posexplode("__p").alias("c", "x")).groupBy("c").agg(F.avg("x").alias("v")).orderBy("c").collect()]])
            return [K.unit_rows(one) for _ in seeds]
        streams = [np.random.default_rng(seed) for seed in seeds]

        def fetch(numbers: np.ndarray) -> np.ndarray:
            asked = sorted({int(i) for i in numbers.ravel()})
            held = {r["row"]: r["__p"] for r in rows.where(F.col("row").isin(asked)).collect()}  # a row for each template at most
            return np.array([held[int(i)] for i in numbers.ravel()], float).reshape(*numbers.shape, -1)

        templates, before = fetch(np.array([rng.choice(n, size=k, replace=False) for rng in streams])), None
        open_ = list(range(len(seeds)))
        for _ in range(rounds):
            sums, sizes, changed = _step(rows.select("__p"), templates[open_], None if before is None else before[open_])
            settled = []
            moved_all = templates.copy()
            for j, s in enumerate(open_):
                moved = K.unit_rows(sums[j] / np.maximum(sizes[j], 1)[:, None])
                for empty in np.flatnonzero(sizes[j] == 0):
                    moved[empty] = fetch(np.array([streams[s].integers(0, n)]))[0]
                if not changed[j] and np.allclose(moved, templates[s]):
                    settled.append(s)
                moved_all[s] = moved
            before, templates = templates, moved_all
            open_ = [s for s in open_ if s not in settled]
            if not open_:
                break
        return [t[K.lexicographic(t)] for t in templates]
    finally:
        rows.unpersist()


def mean_fits(patterns: DataFrame, templates: list[np.ndarray], *, pattern: str = "pattern") -> np.ndarray:
    """For each set of templates the mean over the patterns of the highest absolute product."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(templates)), 0
        for batch in batches:
            matrix = _matrix(batch)
            sums += [np.abs(matrix @ t.T).max(axis=1).sum() for t in templates]
            n += len(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(templates))), pa.array(sums), pa.array([n] * len(templates), pa.int64())], ["at", "value", "n"])

    found = patterns.select(F.col(pattern).cast("array<double>")).mapInArrow(part, "at long, value double, n long").groupBy("at").agg(F.sum("value") / F.sum("n")).collect()
    return np.array([value for _, value in sorted(map(tuple, found))])


def similarities(patterns: DataFrame, templates: np.ndarray, *, pattern: str = "pattern", name: str = "similarities") -> DataFrame:
    """``patterns`` with the absolute product with each template; the templates are constants of the projection."""
    each = [F.abs(V.dot(F.col(pattern), F.array(*(F.lit(float(x)) for x in row)))) for row in templates]
    return patterns.withColumn(name, F.array(*each) if each else F.array().cast("array<double>"))


def archetypes(patterns: DataFrame, k: int, seed: int, keys: list[str], *, state: str = "field_state", pattern: str = "pattern") -> DataFrame:
    """keys, state, assigned_archetype, assignment_similarity, archetype: a subject's patterns are assigned to different archetypes.

    Archetypes are the means of the patterns assigned to a template of all subjects (the template itself if none is). Only
    a subject's few patterns meet in one group.
    """
    templates = polarity_templates(patterns, k, [seed], keys, order=state, pattern=pattern)[0]
    scored = similarities(patterns.select(*keys, state, F.col(pattern).cast("array<double>").alias("__p")), templates, pattern="__p", name="__s")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.select(state, "__p").schema)

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(state)
        own = K.unique_assignment(np.stack(part["__s"].to_numpy()))
        return pd.DataFrame({state: part[state].to_numpy(), "__p": part["__p"].to_numpy(), "assigned_archetype": own})

    assigned = K.grouped(scored, keys, f"{kind}, assigned_archetype long", assign)
    means = assigned.select("assigned_archetype", F.posexplode("__p").alias("__c", "__x")).groupBy("assigned_archetype", "__c").agg(F.avg("__x").alias("__x"))
    made = means.groupBy("assigned_archetype").agg(F.array_sort(F.collect_list(F.struct("__c", "__x"))).alias("__m")).select("assigned_archetype", V.unit_pattern(F.transform("__m", lambda m: m["__x"])).alias("archetype"))
    both = assigned.join(made, "assigned_archetype")
    return both.select(*keys, state, "assigned_archetype", F.abs(V.dot(F.col("__p"), F.col("archetype"))).alias("assignment_similarity"), "archetype")
