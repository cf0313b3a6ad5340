"""Topographies of samples and templates, their labelling by fixed templates, and their alignment with archetypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import vectors as V
from tessera.operators.asof import asof_nearest
from tessera.operators.clustering import mean_fits, polarity_templates


def topography(signals: DataFrame, keys: list[str], *, order: str = "sample") -> DataFrame:
    """keys, sample, map: the oriented unit pattern of each sample's channels in their order."""
    arrays = V.to_arrays(signals, keys, channel="channel")
    return arrays.select(*keys, order, V.oriented(V.unit_pattern(F.col("pattern"))).alias("map"))


def template_table(templates: DataFrame, *, state: str = "microstate", template: str = "template") -> DataFrame:
    """Templates as oriented unit patterns."""
    return templates.withColumn(template, V.oriented(V.unit_pattern(F.col(template)))).select(state, template)


def confidence(samples: DataFrame, templates: np.ndarray, *, pattern: str = "pattern") -> DataFrame:
    """``samples`` with scores: the absolute correlation with each template (0 against a constant one).

    The templates (a few rows) are constants of the projection, so nothing is shuffled.
    """
    centred = templates - templates.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(centred, axis=1, keepdims=True)
    unit = centred / np.where(norm == 0, 1.0, norm)
    scores = V.let(V.unit_pattern(F.col(pattern)), lambda p: F.array(*(F.abs(V.dot(p, F.array(*(F.lit(float(x)) for x in row)))) for row in unit)))
    return samples.withColumn("scores", scores)


def label_fixed(samples: DataFrame, templates: np.ndarray, keys: list[str], *, least: int, order: str = "sample", pattern: str = "pattern", time: str = "time_sec") -> DataFrame:
    """keys, sample, time, microstate, corr: the best template of each sample, after runs shorter than ``least`` were smoothed."""
    scored = confidence(samples, templates, pattern=pattern).select(*keys, order, time, "scores")
    return smoothed_labels(scored, keys, least=least, order=order, time=time)


def smoothed_labels(scored: DataFrame, keys: list[str], *, least: int, order: str = "sample", time: str = "time_sec") -> DataFrame:
    """Labels from a column of scores; smoothing reads the scores of one recording in order (``smoothing.smooth_labels`` reads runs of any length)."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        scores = np.stack(part["scores"].to_numpy())
        labels = K.smooth_runs(scores.argmax(axis=1), scores, least)
        return pd.DataFrame({order: part[order].to_numpy(), time: part[time].to_numpy(), "microstate": labels, "corr": scores[np.arange(len(labels)), labels]})

    return K.grouped(scored, keys, f"{order} long, {time} double, microstate long, corr double", kernel)


def sampled_peaks(peaks: DataFrame, keys: list[str], *, most: int, seed: int, order: str = "sample") -> DataFrame:
    """At most ``most`` peaks of each key, chosen by a seeded hash: the sampling step before a fit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, order), order))
    return peaks.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def group_model(patterns: DataFrame, k: int, *, seed: int, restarts: int = 8, pattern: str = "pattern", keys: tuple[str, ...] = ("patient_id",), order: str = "sample") -> DataFrame:
    """microstate, template: polarity-invariant templates of pooled peaks; the best of some seeded starts, fitted side by side."""
    unit = patterns.select(*keys, order, V.unit_pattern(F.col(pattern).cast("array<double>")).alias("pattern"))
    tries = polarity_templates(unit, k, [seed + i for i in range(restarts)], list(keys), order=order)
    best = tries[int(np.argmax(mean_fits(unit, tries)))] if tries[0].size else tries[0]
    return patterns.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(best)], "microstate long, template array<double>")  # k rows


def align_archetypes(topographies: DataFrame, labels: DataFrame, field_labels: DataFrame, assignments: DataFrame, keys: list[str], *, tolerance: float, state: str = "field_state") -> DataFrame:
    """Labels with the nearest topography and the nearest field label that has an archetype; others drop out."""
    assigned = field_labels.join(assignments, [*keys, state])
    mapped = asof_nearest(labels, topographies, keys, tolerance=tolerance)
    return asof_nearest(mapped, assigned, keys, tolerance=tolerance)


def thin_plate_grid(positions: np.ndarray, values: np.ndarray, cells: int = 96, low: float = -1.0, high: float = 1.0) -> np.ndarray:
    """Values of sensors on a grid by thin-plate splines with a linear part; a few dozen sensors."""

    def radial(d2: np.ndarray) -> np.ndarray:
        return np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1.0)), 0.0)

    square = lambda a, b: ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    n = len(positions)
    linear = np.column_stack([np.ones(n), positions])
    system = np.block([[radial(square(positions, positions)), linear], [linear.T, np.zeros((3, 3))]])
    weights = np.linalg.lstsq(system, np.concatenate([values, np.zeros(3)]), rcond=None)[0]
    axis = np.linspace(low, high, cells)
    grid = np.stack(np.meshgrid(axis, axis), -1).reshape(-1, 2)
    return (radial(square(grid, positions)) @ weights[:n] + np.column_stack([np.ones(len(grid)), grid]) @ weights[n:]).reshape(cells, cells)
