"""Smoothing of short runs and spacing of peaks, on tables of runs and of peaks instead of samples.

A run that is long enough never changes its label, so what lies between two long runs is smoothed by itself; peaks whose
neighbours are a whole distance away are kept or dropped by themselves. Spark finds runs, maxima and these independent stretches
(see ``chunks``); the sequential rule then runs in many tasks, each over the runs or peaks of some stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators.chunks import CHUNK, marked_runs, neighbours, running_total, separated
from tessera.operators.sequence import runs

#: Stretches between long runs, or groups of peaks, that one task's group holds.
STRETCHES = 1024


def smoothed_run_labels(sizes: np.ndarray, labels: np.ndarray, sums: np.ndarray, least: int) -> np.ndarray:
    """New labels of runs: those shorter than ``least`` take a neighbour's until none is left that has a neighbour.

    ``sums`` has each run's summed score of each label. Between equal labels a run takes theirs, else the neighbour's
    with the higher score over the run (the earlier on ties). Joined runs add their sizes and sums.
    """
    out = np.array(labels)
    if least <= 1:
        return out
    waiting = [(i, i + 1, int(s), int(n), sums[i]) for i, (s, n) in enumerate(zip(labels, sizes, strict=True))][::-1]
    settled: list[tuple] = []

    def joined(a: tuple, b: tuple) -> tuple:
        return (a[0], b[1], a[2], a[3] + b[3], a[4] + b[4])

    while waiting:
        run = waiting.pop()
        if settled and settled[-1][2] == run[2]:
            run = joined(settled.pop(), run)
        if run[3] >= least or not (settled or waiting):
            settled.append(run)
            continue
        beside = [side[-1][2] for side in (settled, waiting) if side]
        taken = beside[int(np.argmax([run[4][s] for s in beside]))]
        run = (*run[:2], taken, *run[3:])
        if settled and settled[-1][2] == taken:
            run = joined(settled.pop(), run)
        if waiting and waiting[-1][2] == taken:
            run = joined(run, waiting.pop())
        waiting.append(run)
    for a, b, label, *_ in settled:
        out[a:b] = label
    return out


def smooth_labels(samples: DataFrame, keys: list[str], *, label: str, scores: str, n_labels: int, least: int, order: str = "sample", chunk: int = CHUNK) -> DataFrame:
    """``samples`` with smoothed labels in place of ``label``, which counts from 0; ``scores`` is an array of ``n_labels`` numbers at most."""
    marked = marked_runs(samples, keys, state=label, order=order, name="__run", chunk=chunk)
    each = [F.coalesce(F.sum(F.get(scores, F.lit(i))), F.lit(0.0)) for i in range(n_labels)]
    table = marked.groupBy(*keys, "__run").agg(F.first(label).cast("long").alias("__label"), F.count("*").alias("__n"), F.array(*each).alias("__sums"))
    long = F.col("__n") >= least
    cut = running_total(table, keys, long.cast("long"), "__stretch", order="__run", chunk=chunk)
    # The long run that begins a group also ends the one before.
    group = F.floor(F.col("__stretch") / STRETCHES)
    ends = F.when(long & (F.col("__stretch") % STRETCHES == 0), F.array(group, group - 1)).otherwise(F.array(group))
    dealt = cut.withColumn("__own", group).withColumn("__group", F.explode(ends))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__run")
        new = smoothed_run_labels(part["__n"].to_numpy(), part["__label"].to_numpy(), np.stack(part["__sums"].to_numpy()), least)
        own = (part["__own"] == part["__group"]).to_numpy()
        return pd.DataFrame({"__run": part["__run"].to_numpy()[own], "__new": new[own]})

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*keys).schema)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = kernel(part)
        for i, (name, value) in enumerate(zip(keys, key, strict=False)):
            out.insert(i, name, value)
        return out

    found = dealt.groupBy(*keys, "__group").applyInPandas(run, f"{head}{', ' if head else ''}__run long, __new long")
    found = found.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__run").alias("__r"), "__new")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    kind = samples.schema[label].dataType
    back = marked.join(found, [*on, F.col("__run") == F.col("__r")])
    return back.select(*(F.col("__new").cast(kind).alias(label) if c == label else F.col(c) for c in samples.columns))


def spaced_maxima(trace: DataFrame, keys: list[str], *, value: str, distance: int, order: str = "sample", chunk: int = CHUNK) -> DataFrame:
    """keys, peak_id (0-based), order, value: local maxima (the middle of plateaus) at least ``distance`` apart; the highest are kept first, the later on ties.

    ``order`` must be dense within a key.
    """
    flat = runs(trace, keys, state=value, order=order, time=order, chunk=chunk)
    level = neighbours(flat, keys, [value], order="run_id", chunk=chunk)
    top = level.where((F.col(value) > F.col(f"{value}__before")) & (F.col(value) > F.col(f"{value}__after")))
    peaks = top.select(*keys, (F.col("start_sample") + F.expr("(n_samples - 1) div 2")).alias(order), value)
    grouped = separated(peaks, keys, gap=distance, order=order, name="__stretch", chunk=chunk).withColumn("__group", F.floor(F.col("__stretch") / STRETCHES))
    head = [f for f in grouped.schema if f.name in keys]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        out = part.loc[K.spaced(part[value].to_numpy(), part[order].to_numpy(), distance), [order, value]].reset_index(drop=True)
        for i, (name, given) in enumerate(zip(keys, key, strict=False)):
            out.insert(i, name, given)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*head, grouped.schema[order], grouped.schema[value]])
    kept = grouped.groupBy(*keys, "__group").applyInPandas(run, schema)
    return running_total(kept, keys, F.lit(1).cast("long"), "peak_id", order=order, chunk=chunk).select(*keys, (F.col("peak_id") - 1).alias("peak_id"), order, value)
