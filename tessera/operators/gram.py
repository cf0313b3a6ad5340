"""Connectivity of all pairs of series from sums over chunks of samples.

A task turns the rows of one key and chunk into a matrix of samples by series and returns one row for each pair of
series with sums over the chunk; Spark adds them. Nothing is joined: a sample costs its series, not its pairs. Pairs count
the samples that both have (nulls are absent). A sample has a series once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunks import chunk_of
from tessera.operators.kernels import analytic, grouped

#: Samples of a chunk.
CHUNK_SAMPLES = 8192


def _chunked(signals: DataFrame, keys: list[str], series: str, order: str, values: list[str], schema: str, measure: Callable[..., dict[str, np.ndarray]], chunk: int) -> DataFrame:
    """keys, a, b and the columns of ``measure`` for each chunk; ``measure`` takes a matrix (samples by series, NaN: absent) for each value."""
    kind = signals.schema[series].dataType.simpleString()

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        at, row = np.unique(part[order].to_numpy(), return_inverse=True)
        names, column = np.unique(part[series].to_numpy(), return_inverse=True)
        matrices = []
        for v in values:
            matrix = np.full((len(at), len(names)), np.nan)
            matrix[row, column] = part[v].to_numpy(float)
            matrices.append(matrix)
        a, b = np.triu_indices(len(names), 1)
        found = {name: table[a, b] for name, table in measure(*matrices).items()}
        return pd.DataFrame({"__a": names[a], "__b": names[b], **found}).loc[lambda r: r["n"] > 0]

    dealt = signals.select(*keys, chunk_of(order, chunk).alias("__chunk"), order, series, *values).where(F.col(series).isNotNull())
    return grouped(dealt, [*keys, "__chunk"], f"__a {kind}, __b {kind}, {schema}", kernel).drop("__chunk")


def _moments(matrix: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of each pair's common samples, deviations from the chunk's means apart from the means."""
    held = ~np.isnan(matrix)
    mask, x = held.astype(float), np.where(held, matrix, 0.0)
    shift = x.sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
    centred = np.where(held, matrix - shift, 0.0)
    n, sx = mask.T @ mask, centred.T @ mask  # sx[a, b]: of a where b is
    sxx = (centred**2).T @ mask
    mean = np.divide(sx, n, out=np.zeros_like(sx), where=n > 0)
    low, high = np.where(held, matrix, np.inf).min(axis=0), np.where(held, matrix, -np.inf).max(axis=0)
    flat = low == high
    sxx_c = np.where(flat[:, None], 0.0, sxx - n * mean**2)
    sxy_c = np.where(flat[:, None] | flat[None, :], 0.0, centred.T @ centred - n * mean * mean.T)
    own = np.where(flat[:, None], np.where(held.any(axis=0), low, 0.0)[:, None], mean + shift[:, None])
    return {"n": n.astype(np.int64), "mx": own, "my": own.T, "cxy": sxy_c, "cxx": sxx_c, "cyy": sxx_c.T}


def pair_moments(signals: DataFrame, keys: list[str], *, series: str = "region", order: str = "sample", value: str = "value", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """keys, region_a, region_b, n and the mean and centred sums of each pair: mx, my, cxy, cxx, cyy."""
    each = _chunked(signals, keys, series, order, [value], "n long, mx double, my double, cxy double, cxx double, cyy double", _moments, chunk)
    return merged(each.withColumnsRenamed({"__a": "region_a", "__b": "region_b"}), [*keys, "region_a", "region_b"])


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of the union of disjoint samples from the moments of each: deviations of the means are taken about their mean."""
    w = Window.partitionBy(*by)
    n = F.col("n")
    # Equal means have no deviation, whatever their weighted mean rounds to: a constant side stays one.
    about = lambda m: F.when(F.min(m).over(w) == F.max(m).over(w), 0.0).otherwise(F.col(m) - F.sum(n * F.col(m)).over(w) / F.sum(n).over(w))
    dx, dy = F.col("__dx"), F.col("__dy")
    placed = parts.withColumns({"__dx": about("mx"), "__dy": about("my")})
    total = lambda c, a, b: F.sum(F.col(c) + n * a * b).alias(c)
    mean = lambda m: (F.sum(n * F.col(m)) / F.sum(n)).alias(m)
    return placed.groupBy(*by).agg(F.sum(n).alias("n"), mean("mx"), mean("my"), total("cxy", dx, dy), total("cxx", dx, dx), total("cyy", dy, dy))


def absolute_correlation() -> Column:
    """From a row of moments; null where a side is constant."""
    return F.when((F.col("cxx") > 0) & (F.col("cyy") > 0), F.abs(F.col("cxy")) / F.sqrt(F.col("cxx") * F.col("cyy")))


def connectivity(signals: DataFrame, keys: list[str], *, series: str = "region", order: str = "sample", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Absolute correlation of each pair of series; pairs with a constant side drop out."""
    found = pair_moments(signals, keys, series=series, order=order, chunk=chunk).withColumn("connectivity", absolute_correlation())
    return found.where("connectivity IS NOT NULL").select(*keys, "region_a", "region_b", F.col("n").alias("n_samples"), "connectivity")


def connectivity_on_off(signals: DataFrame, keys: list[str], *, state: str, min_samples: int = 2, series: str = "region", order: str = "sample", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Connectivity within each state against outside it, where both have enough samples."""
    by = [*keys, "region_a", "region_b"]
    inside = pair_moments(signals, [*keys, state], series=series, order=order, chunk=chunk)
    # A state's outside is the union of all other states: a row of each state goes to every other one that the pair has.
    states = F.collect_set(F.struct(F.col(state).alias("s"))).over(Window.partitionBy(*by))
    spread = inside.withColumn("__states", states).withColumn("__to", F.explode("__states")).where(~F.col("__to.s").eqNullSafe(F.col(state)))
    outside = merged(spread.select(*by, F.col("__to.s").alias("__state"), "n", "mx", "my", "cxy", "cxx", "cyy"), [*by, "__state"])
    a = inside.select(*by, state, F.col("n").alias("n_state_samples"), absolute_correlation().alias("state_connectivity"))
    b = outside.select(*(F.col(c).alias(f"__{c}") for c in by), "__state", F.col("n").alias("n_nonstate_samples"), absolute_correlation().alias("off_connectivity"))
    both = a.join(b, [*(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.col(state).eqNullSafe(F.col("__state"))])
    kept = both.where((F.col("n_state_samples") >= min_samples) & (F.col("n_nonstate_samples") >= min_samples)).dropna(subset=["state_connectivity", "off_connectivity"])
    return kept.select(*by, state, "state_connectivity", "off_connectivity", (F.col("state_connectivity") - F.col("off_connectivity")).alias("effect_mean_diff"), "n_state_samples", "n_nonstate_samples")


def analytic_signals(signals: DataFrame, keys: list[str], *, series: str = "channel", order: str = "sample", value: str = "value") -> DataFrame:
    """keys, series, order, re, im: the analytic signal of each series; one transform a series, whose samples one task holds."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        z = analytic(part[value].to_numpy(float))
        return pd.DataFrame({order: part[order].to_numpy(), "re": z.real, "im": z.imag})

    kind = signals.schema[order].dataType.simpleString()
    return grouped(signals.select(*keys, series, order, value), [*keys, series], f"{order} {kind}, re double, im double", kernel)


def _phases(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of unit phase differences, and of the imaginary cross-spectrum and its size."""
    z = re + 1j * im
    held = ~np.isnan(z)
    z = np.where(held, z, 0)
    size = np.abs(z)
    unit = np.where(held, np.divide(z, size, out=np.ones_like(z), where=size > 0), 0)
    turn = unit.T @ np.conj(unit)
    cross = (z.T @ np.conj(z)).imag
    total = np.empty_like(cross)
    for a in range(z.shape[1]):
        total[a] = np.abs((z[:, a : a + 1] * np.conj(z)).imag).sum(axis=0)
    mask = held.astype(float)
    return {"n": (mask.T @ mask).astype(np.int64), "pr": turn.real, "pi": turn.imag, "s": cross, "t": total}


def phase_connectivity(signals: DataFrame, keys: list[str], *, series: str = "channel", order: str = "sample", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """region_a, region_b, n_samples, plv (length of the mean phase difference) and wpli (0 without imaginary cross-spectrum) of each pair of series."""
    z = analytic_signals(signals, keys, series=series, order=order)
    each = _chunked(z, keys, series, order, ["re", "im"], "n long, pr double, pi double, s double, t double", _phases, chunk)
    total = each.groupBy(*keys, F.col("__a").alias("region_a"), F.col("__b").alias("region_b")).agg(*(F.sum(c).alias(c) for c in ("n", "pr", "pi", "s", "t")))
    plv = F.sqrt(F.col("pr") ** 2 + F.col("pi") ** 2) / F.col("n")
    return total.select(*keys, "region_a", "region_b", F.col("n").alias("n_samples"), plv.alias("plv"), F.when(F.col("t") > 0, F.abs("s") / F.col("t")).otherwise(F.lit(0.0)).alias("wpli"))


def component_scores(patterns: DataFrame, keys: list[str], n: int, *, order: str = "sample", pattern: str = "pattern", chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """keys, order, scores: ``kernels.principal_components`` of all patterns of a key, from sums over chunks and a projection."""
    from tessera.operators.vectors import dot  # which imports this module

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(part[pattern].to_numpy()).astype(float)
        mean = matrix.mean(axis=0)
        centred = matrix - mean
        return pd.DataFrame({"n": [len(matrix)], "mean": [mean], "product": [(centred.T @ centred).ravel()]})

    def axes(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__chunk")
        size, means = part["n"].to_numpy(), np.stack(part["mean"].to_numpy())
        mean = size @ means / size.sum()
        apart = means - mean
        covariance = (np.stack(part["product"].to_numpy()).sum(axis=0).reshape(len(mean), -1) + (apart * size[:, None]).T @ apart) / size.sum()
        spread = np.sqrt(covariance.diagonal())
        spread = np.where(spread > 1e-12 * np.abs(mean), spread, np.inf)  # a constant channel has no part
        _, v = np.linalg.eigh(covariance / np.outer(spread, spread))
        v = v.T[::-1][: min(n, size.sum())]
        sign = np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)
        return pd.DataFrame({"__mean": [mean], "__axes": [list(v * sign[:, None] / spread)]})

    parts = grouped(patterns.select(*keys, chunk_of(order, chunk).alias("__chunk"), pattern), [*keys, "__chunk"], "n long, mean array<double>, product array<double>", sums)
    found = grouped(parts, keys, "__mean array<double>, __axes array<array<double>>", axes)
    found = found.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__mean", "__axes")
    joined = patterns.join(found, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    centred = F.zip_with(pattern, "__mean", lambda x, m: x - m)
    return joined.select(*keys, order, centred.alias("__c"), "__axes").select(*keys, order, F.transform("__axes", lambda a: dot(a, F.col("__c"))).alias("scores"))
