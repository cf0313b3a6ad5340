"""Numeric kernels for the few inherently sequential or iterative steps, and their grouped application.

Each kernel takes and returns numpy arrays of one group (a patient, a segment, a key). Groups are bounded by the data
model: peak vectors are sampled to a fixed number before clustering, effects are one value for each subject.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grouped(table: DataFrame, keys: list[str], schema: str, kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Apply a kernel to each group; ``schema`` lists the result's columns after the keys."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = kernel(rows)
        for i, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, name, value)
        return out

    return table.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def spaced_peaks(trace: np.ndarray, distance: int) -> np.ndarray:
    """Indexes of local maxima (the middle of plateaus), at least ``distance`` apart: the highest are kept first."""
    x = np.asarray(trace, float)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    level, stop = x[edge], np.append(edge[1:], len(x)) - 1
    inner = np.arange(1, len(edge) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    peaks = (edge[top] + stop[top]) // 2
    return peaks[spaced(x[peaks], peaks, distance)]


def spaced(height: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Which of some peaks in order stay if none may be nearer than ``distance`` to a higher one that stays (the later of equal ones counts as higher)."""
    keep = np.ones(len(at), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            lo, hi = np.searchsorted(at, (at[i] - distance + 1, at[i] + distance))
            keep[lo:hi] = False
            keep[i] = True
    return keep


def smooth_runs(labels: np.ndarray, scores: np.ndarray, least: int) -> np.ndarray:
    """Replace runs shorter than ``least`` by a neighbouring label until none is left that has a neighbour.

    Between equal labels a run takes theirs, else the neighbour's with the higher mean score over the run (the earlier
    on ties). One pass with a stack does it: all runs on the stack are long enough, so the next short run is always the
    first one, and what it becomes can only lengthen its neighbours.
    """
    labels = np.asarray(labels)
    if not len(labels) or least <= 1:
        return labels.copy()
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
    cut = np.flatnonzero(np.diff(labels)) + 1
    todo = [[a, b, int(labels[a])] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(labels)], strict=True)][::-1]
    done: list[list[int]] = []
    while todo:
        a, b, own = todo.pop()
        if done and done[-1][2] == own:
            a = done.pop()[0]
        if b - a >= least or not (done or todo):
            done.append([a, b, own])
            continue
        near = [run[2] for run in ([done[-1]] if done else []) + ([todo[-1]] if todo else [])]
        mean = [sums[b, s] - sums[a, s] for s in near]
        new = near[int(np.argmax(mean))]
        if todo and todo[-1][2] == new:
            todo[-1][0] = a
        if done and done[-1][2] == new:
            start = done.pop()[0]
            if todo and todo[-1][2] == new:
                todo[-1][0] = start
            else:
                todo.append([start, b, new])
    out = np.empty_like(labels)
    for a, b, s in done:
        out[a:b] = s
    return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows less their mean, over their norm; rows without spread become 0."""
    centred = matrix - matrix.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(centred, axis=1, keepdims=True)
    return np.divide(centred, norm, out=np.zeros_like(centred), where=norm > 0)


def lexicographic(rows: np.ndarray) -> np.ndarray:
    """Order of rows by first column, then second, and so on."""
    return np.lexsort(rows.T[::-1])


def polarity_clusters(patterns: np.ndarray, k: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of unit patterns regardless of sign: (templates, labels, similarity).

    Start: k distinct patterns drawn by the seed. Each round assigns by the largest absolute product, flips members to
    their template's sign and renormalises the mean; an empty cluster takes a drawn pattern. Templates are numbered in
    lexicographic order, so labels don't depend on the start's order.
    """
    n = len(patterns)
    k = max(1, min(k, n))
    if k == 1:
        template = unit_rows(patterns.mean(axis=0, keepdims=True))
        return template, np.zeros(n, int), np.abs(patterns @ template.T)[:, 0]
    rng = np.random.default_rng(seed)
    templates = patterns[rng.choice(n, size=k, replace=False)]
    labels = np.zeros(n, int)
    for _ in range(rounds):
        product = patterns @ templates.T
        chosen = np.abs(product).argmax(axis=1)
        sign = np.where(product[np.arange(n), chosen] < 0, -1.0, 1.0)
        total = np.zeros_like(templates)
        np.add.at(total, chosen, patterns * sign[:, None])
        size = np.bincount(chosen, minlength=k)
        moved = unit_rows(total / np.maximum(size, 1)[:, None])
        for empty in np.flatnonzero(size == 0):
            moved[empty] = patterns[int(rng.integers(0, n))]
        settled = np.array_equal(chosen, labels) and np.allclose(moved, templates)
        templates, labels = moved, chosen
        if settled:
            break
    order = lexicographic(templates)
    rank = np.empty(k, int)
    rank[order] = np.arange(k)
    labels, templates = rank[labels], templates[order]
    return templates, labels, np.abs(patterns @ templates.T)[np.arange(n), labels]


def unique_assignment(similarity: np.ndarray, exhaustive: int = 8) -> np.ndarray:
    """A different column for each row with the largest total (first found on ties); greedy beyond ``exhaustive`` columns."""
    rows, cols = similarity.shape
    if not rows:
        return np.zeros(0, int)
    if rows <= cols <= exhaustive:
        choices = np.array(list(permutations(range(cols), rows)))
        return choices[similarity[np.arange(rows), choices].sum(axis=1).argmax()]
    out, free = np.full(rows, -1), np.ones(cols, bool)
    for r in np.argsort(-similarity.max(axis=1), kind="stable"):
        c = np.where(free, similarity[r], -np.inf).argmax() if free.any() else int(similarity[r].argmax())
        out[r] = c
        free[c] = False
    return out


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean similarity of two template sets under the best assignment of the smaller into the larger."""
    if not len(a) or not len(b):
        return float("nan")
    table = np.abs(a @ b.T)
    table = table if len(a) <= len(b) else table.T
    return float(table[np.arange(len(table)), unique_assignment(table)].mean())


def split_half(patterns: np.ndarray, k: int, seed: int) -> float:
    """Similarity of the templates of two random halves; NaN with under two patterns for each half."""
    if len(patterns) < 4:
        return float("nan")
    order = np.random.default_rng(seed).permutation(len(patterns))
    half = len(order) // 2
    a, b = (polarity_clusters(patterns[np.sort(part)], k, seed + i + 1)[0] for i, part in enumerate((order[:half], order[half:])))
    return set_similarity(a, b)


def principal_components(matrix: np.ndarray, n: int) -> np.ndarray:
    """Scores of the first components of the z-scored matrix; each component's largest loading is positive."""
    spread = matrix.std(axis=0)
    z = (matrix - matrix.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    n = min(n, len(s))
    sign = np.where(v[np.arange(n), np.abs(v[:n]).argmax(axis=1)] < 0, -1.0, 1.0)
    return u[:, :n] * s[:n] * sign


def euclidean_clusters(data: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Labels of k-means with a seeded start, numbered in lexicographic order of the centres."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(data)))
    centres = data[rng.choice(len(data), size=k, replace=False)].astype(float)
    labels = np.full(len(data), -1)
    for _ in range(rounds):
        new = ((data[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if np.array_equal(new, labels):
            break
        labels = new
        for c in range(k):
            centres[c] = data[labels == c].mean(axis=0) if (labels == c).any() else data[int(rng.integers(0, len(data)))]
    rank = np.empty(k, int)
    rank[lexicographic(centres)] = np.arange(k)
    return rank[labels]


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the last axis: negative frequencies removed, positive ones doubled."""
    n = x.shape[-1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * weight, axis=-1)


def phase_locking(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the mean phase difference of two analytic signals."""
    return float(np.abs(np.exp(1j * (np.angle(a) - np.angle(b))).mean()))


def weighted_phase_lag(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted phase-lag index; 0 without imaginary cross-spectrum."""
    cross = np.imag(a * np.conj(b))
    size = np.abs(cross).mean()
    return float(abs(cross.mean()) / size) if size > 0 else 0.0


def band_limit(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Zero-phase band-pass along the last axis by cutting the spectrum."""
    freq = np.fft.rfftfreq(x.shape[-1], 1 / rate)
    return np.fft.irfft(np.fft.rfft(x, axis=-1) * ((freq >= low) & (freq <= high)), n=x.shape[-1], axis=-1)


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """n samples over the same time, by cutting or filling the spectrum."""
    spectrum = np.fft.rfft(x, axis=-1)
    width = n // 2 + 1
    out = np.zeros((*x.shape[:-1], width), complex)
    both = min(width, spectrum.shape[-1])
    out[..., :both] = spectrum[..., :both]
    return np.fft.irfft(out, n=n, axis=-1) * (n / x.shape[-1])


def sign_flip_p(values: np.ndarray, seed: int, flips: int = 2048) -> float:
    """Two-sided p of the mean under random signs, (count + 1) / (flips + 1); 1 without values. NaN values don't count."""
    values = np.asarray(values, float)
    values = values[~np.isnan(values)]
    if not len(values):
        return 1.0
    rng = np.random.default_rng(seed)
    null = np.array([abs(np.mean(values * rng.choice((-1.0, 1.0), size=len(values)))) for _ in range(flips)])
    return float((np.sum(null >= abs(values.mean())) + 1) / (flips + 1))


def within_f(matrix: np.ndarray) -> float:
    """Repeated-measures F of complete rows (subjects) by columns (states)."""
    n, k = matrix.shape
    if n < 2 or k < 2:
        return 0.0
    rows, cols, grand = matrix.mean(axis=1, keepdims=True), matrix.mean(axis=0, keepdims=True), matrix.mean()
    between = n * ((cols - grand) ** 2).sum() / (k - 1)
    error = ((matrix - rows - cols + grand) ** 2).sum() / ((n - 1) * (k - 1))
    return float(between / error) if error else (0.0 if not between else float("inf"))


def within_permutation_p(matrix: np.ndarray, seed: int, rounds: int = 2048) -> float:
    """p of the F statistic when states are shuffled within each subject."""
    if matrix.shape[0] < 2 or matrix.shape[1] < 2:
        return 1.0
    rng, observed = np.random.default_rng(seed), within_f(matrix)
    hits = sum(within_f(rng.permuted(matrix, axis=1)) >= observed for _ in range(rounds))
    return (hits + 1) / (rounds + 1)


def t_two_sided(t: float, df: int) -> float:
    """Probability of a |t| at least that large: the regularised incomplete beta function by its continued fraction."""
    if df < 1 or not np.isfinite(t):
        return float("nan") if df < 1 or np.isnan(t) else 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = (b, a, 1 - x) if swap else (a, b, x)
    front = exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * log(y) + q * log(1 - y)) / p if y > 0 else 0.0
    c, d, value = 1.0, 1 / max(1 - (p + q) * y / (p + 1), 1e-300), 0.0
    value = d
    for m in range(1, 400):
        up = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / (1 + up * d), 1 + up / c
        value *= d * c
        down = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / (1 + down * d), 1 + down / c
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * value if swap else front * value


def permutation_null(similarity: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """(state, archetype, likeness, number) of every assignment of states to different archetypes but the observed one."""
    rows, number = [], 0
    for perm in permutations(range(similarity.shape[1]), similarity.shape[0]):
        if perm != tuple(observed):
            rows += [(i, j, similarity[i, j], number) for i, j in enumerate(perm)]
            number += 1
    return np.array(rows).reshape(-1, 4)


def bootstrap_interval(values: np.ndarray, seed: int, rounds: int = 5000, level: float = 0.95) -> tuple[float, float, float]:
    """Mean and percentile interval of resampled means."""
    values = np.asarray(values, float)
    values = values[np.isfinite(values)]
    if not len(values):
        return (float("nan"),) * 3
    rng = np.random.default_rng(seed)
    means = np.concatenate([values[rng.integers(0, len(values), (500, len(values)))].mean(axis=1) for _ in range(-(-rounds // 500))])[:rounds]
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(values.mean()), float(low), float(high)


def information(counts: np.ndarray) -> float:
    """Normalised mutual information of a table of joint counts (0 where an entropy is 0)."""
    counts = counts[counts.any(axis=1)][:, counts.any(axis=0)]
    if counts.sum() < 2:
        return 0.0
    table = counts / counts.sum()
    px, py = table.sum(axis=1), table.sum(axis=0)
    h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    hx, hy = h(px), h(py)
    return float((hx + hy - h(table.ravel())) / np.sqrt(hx * hy)) if hx > 0 and hy > 0 else 0.0


def crossed(x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray:
    """Joint counts of codes below n and m."""
    return np.bincount(x * m + y, minlength=n * m).reshape(n, m)


def mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised mutual information of two label arrays (0 where an entropy is 0)."""
    if len(a) != len(b) or len(a) < 2:
        return 0.0
    (u, x), (v, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    return information(crossed(x, y, len(u), len(v)))


def transform_length(n: int) -> int:
    """n if it has small factors only, else the least 2^a, 5 * 2^a / 4 or 3 * 2^a / 2 that holds two lengths."""
    rest = n
    for p in (2, 3, 5, 7, 11):
        while rest % p == 0 and rest > 1:
            rest //= p
    if rest <= 1:
        return n
    top = 1 << (2 * n - 1).bit_length()
    return next(size for size in (top * 5 // 8, top * 3 // 4, top) if size >= 2 * n)


def shifted_products(x: list[np.ndarray], y: list[np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """(shift, x, y): sums over i of x[i] * y[(i + shift) mod length], by circular cross-correlation.

    The transforms cost O(length * log(length)) for each pair of arrays, whatever the number of shifts. An awkward
    length is padded; then a sum has two parts, before and behind the end.
    """
    n = len(x[0])
    size, at = transform_length(n), np.asarray(shifts) % n
    ahead, behind = [np.conj(np.fft.rfft(u, size)) for u in x], [np.fft.rfft(v, size) for v in y]
    out = np.empty((len(at), len(x), len(y)))
    for i, u in enumerate(ahead):
        for j, v in enumerate(behind):
            sums = np.fft.irfft(u * v, n=size)
            out[:, i, j] = sums[at] if size == n else sums[at] + np.where(at, sums[at - n], 0.0)
    return out


def shifted_counts(x: np.ndarray, y: np.ndarray, n: int, m: int, shifts: np.ndarray) -> np.ndarray:
    """(shift, code, code): joint counts of x[i] and y[(i + shift) mod length]."""
    found = shifted_products([(x == u).astype(float) for u in range(n)], [(y == v).astype(float) for v in range(m)], shifts)
    return np.rint(found).astype(np.int64)


def shifted_information(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """``mutual_information`` of a and b rolled by each shift."""
    (u, x), (v, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    return np.array([information(t) for t in shifted_counts(x, y, len(u), len(v), -np.asarray(shifts))])


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's r; 0 with fewer than three pairs or where a side is constant."""
    return float(shifted_correlation(a, b, np.zeros(1, np.int64))[0])


def shifted_correlation(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """``correlation`` of a and b rolled by each shift, from one circular cross-correlation."""
    shifts = np.asarray(shifts)
    if len(a) < 3 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return np.zeros(len(shifts))
    x, y = a - a.mean(), b - b.mean()
    scale = np.sqrt((x**2).sum() * (y**2).sum())
    if len(shifts) == 1:
        return np.array([(x * np.roll(y, int(shifts[0]))).sum() / scale])
    return shifted_products([x], [y], -shifts)[:, 0, 0] / scale


#: What gives a measure at many shifts at once.
BY_SHIFT = {mutual_information: shifted_information, correlation: shifted_correlation}


def shifted_coupling(a: np.ndarray, b: np.ndarray, lags: list[int], surrogates: int, seed: int, measure=mutual_information) -> pd.DataFrame:
    """Observed measure at each lag against circular shifts of b, drawn in order of ascending lags from one stream."""
    rng, rows = np.random.default_rng(seed), []
    for lag in sorted(set(lags)):
        x, y = (a[: len(a) - lag], b[lag:]) if lag >= 0 else (a[-lag:], b[:lag])
        if len(x) < 2:
            continue
        shifts = rng.integers(1, max(2, len(y)), size=max(1, surrogates))
        observed, *null = BY_SHIFT[measure](x, y, np.append(0, shifts))
        null = np.array(null)
        rows.append((lag, len(x), observed, null.mean(), observed - null.mean(), (np.sum(null >= observed) + 1) / (len(null) + 1)))
    return pd.DataFrame(rows, columns=["lag_samples", "n_samples", "observed_coupling", "null_mean_coupling", "effect_mean_diff", "p_perm"])


def arithmetic_shifts(n: int, count: int) -> np.ndarray:
    """Shifts between 1 and n - 1 without a random stream."""
    return 1 + (np.arange(1, count + 1) * 7919) % max(1, n - 1)


def shifted_lag_grid(a: np.ndarray, b: np.ndarray, lags: list[int], shifts: np.ndarray, digits: int = 9) -> pd.DataFrame:
    """Mutual information at each lag, where all of b is shifted around its end before lagging; values are compared rounded.

    A lag of a shifted sequence is one more circular shift, less the pairs that wrap around the ends.
    """
    rows, n = [], len(a)
    (u, x), (v, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    lags = [lag for lag in sorted(set(lags)) if abs(lag) < n]
    moved = np.array([[lag - k for k in (0, *shifts.tolist())] for lag in lags], np.int64).reshape(len(lags), -1)
    counts = shifted_counts(x, y, len(u), len(v), moved.ravel()).reshape(*moved.shape, len(u), len(v)) if len(lags) else moved
    for lag, by, tables in zip(lags, moved, counts, strict=True):
        wrapped = np.arange(n - lag, n) if lag >= 0 else np.arange(-lag)
        values = [information(t - crossed(x[wrapped], y[(wrapped + s) % n], len(u), len(v))) for t, s in zip(tables, by.tolist(), strict=True)]
        observed, *null = (round(value, digits) for value in values)
        null = np.array(null)
        rows.append((lag, observed, null.mean(), observed - null.mean(), (np.sum(null >= observed) + 1) / (len(null) + 1)))
    return pd.DataFrame(rows, columns=["lag_samples", "observed_coupling", "null_mean_coupling", "effect_mean_diff", "p_perm"])


def shifted_response_rates(events: pd.DataFrame, times: np.ndarray, labels: np.ndarray, window: float, surrogates: int, seed: int) -> pd.DataFrame:
    """Share of events (event_sec, from_state, to_state) with a label switch in [event, event + window), against circular shifts of the labels.

    A row for each kind of event and response: any switch (response_state -1), and switches to each state that the
    labels switch to. A shift without a switch of the kind counts as a rate of 0.
    """
    kinds, group = np.unique(events[["from_state", "to_state"]].to_numpy().reshape(-1, 2), axis=0, return_inverse=True)
    group, start = group.ravel(), events["event_sec"].to_numpy(float)
    size = np.bincount(group, minlength=len(kinds))

    n = len(labels)
    turned = np.append(labels[:1] != labels[-1:], labels[1:] != labels[:-1])  # around the end
    asked = np.unique(labels[1:][turned[1:]]).tolist()
    kinds_of = [turned] + [turned & (labels == d) for d in asked]
    upto = [np.concatenate([[0], np.cumsum(np.concatenate([t, t]))]) for t in kinds_of]
    # Switches in [low, high) of the shifted labels; the first label has none before it.
    low, high = np.maximum(np.searchsorted(times, start), 1), np.searchsorted(times, start + window)
    high = np.maximum(high, low)

    def rates(shift: int) -> np.ndarray:
        back = shift % n if n else 0
        hits = [u[high - back + n] > u[low - back + n] for u in upto]
        return np.array([np.bincount(group, weights=hit, minlength=len(kinds)) / size for hit in hits])

    rows, observed = [], rates(0)
    shifts = np.random.default_rng(seed).integers(1, max(2, n), size=max(1, surrogates))
    null = np.array([rates(int(k)) for k in shifts])
    for j, d in enumerate((-1, *asked)):
        for i, (a, b) in enumerate(kinds):
            obs, each = observed[j, i], null[:, j, i]
            rows.append((a, b, "any-switch" if j == 0 else "destination-state", d, size[i], obs, each.mean(), obs - each.mean(), (np.sum(each >= obs) + 1) / (len(each) + 1)))
    return pd.DataFrame(rows, columns=["from_state", "to_state", "response_kind", "response_state", "n_events", "observed_coupling", "null_mean_coupling", "effect_mean_diff", "p_perm"])


def shifted_trajectory(trace: np.ndarray, at: np.ndarray, before: int, after: int, surrogates: int, seed: int) -> pd.DataFrame:
    """Mean of a trace at each offset from events, against circular shifts of the trace; two-sided about the shifts' mean.

    The trace's sums over all events at every distance are one circular cross-correlation; events whose offset falls
    off an end are taken off again.
    """
    rng, rows, n = np.random.default_rng(seed), [], len(trace)
    centre = trace.mean() if n else 0.0
    sums = shifted_products([np.bincount(at, minlength=n).astype(float)], [trace - centre], np.arange(n))[:, 0, 0] if n else trace
    for offset in range(-before, after + 1):
        inside = (at + offset >= 0) & (at + offset < n)
        held, off = at[inside] + offset, at[~inside]
        if not len(held):
            continue
        observed = trace[held].mean()
        shifts = rng.integers(1, max(2, n), size=max(1, surrogates))
        total = sums[(offset - shifts) % n] - (trace[(off[:, None] + offset - shifts) % n] - centre).sum(axis=0)
        null = total / len(held) + centre
        extreme = np.abs(null - null.mean()) >= abs(observed - null.mean())
        rows.append((offset, len(held), observed, null.mean(), observed - null.mean(), (extreme.sum() + 1) / (len(null) + 1)))
    return pd.DataFrame(rows, columns=["offset_samples", "n_events", "observed_coupling", "null_mean_coupling", "effect_mean_diff", "p_perm"])


def pair_connectivity(matrix: np.ndarray, method: str) -> np.ndarray:
    """Connectivity of each pair of columns (corr: absolute correlation, plv, wpli); NaN where it isn't defined."""
    n = matrix.shape[1]
    out = np.full((n, n), np.nan)
    z = analytic(matrix.T) if method in ("plv", "wpli") else matrix.T - matrix.mean(axis=0)[:, None]
    flat = matrix.std(axis=0) == 0
    for a in range(n):
        for b in range(a + 1, n):
            if method == "plv":
                out[a, b] = phase_locking(z[a], z[b])
            elif method == "wpli":
                out[a, b] = weighted_phase_lag(z[a], z[b]) if np.imag(z[a] * np.conj(z[b])).any() else np.nan
            elif not (flat[a] or flat[b]):
                out[a, b] = abs((z[a] * z[b]).sum()) / np.sqrt((z[a] ** 2).sum() * (z[b] ** 2).sum())
    return out


def group_archetypes(patterns: np.ndarray, owners: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Archetypes of all subjects' patterns, each subject's patterns assigned to different ones: (archetypes, assigned, similarity)."""
    archetypes = polarity_clusters(patterns, k, seed)[0]
    table = np.abs(patterns @ archetypes.T)
    assigned = np.zeros(len(patterns), int)
    for owner in np.unique(owners):
        at = np.flatnonzero(owners == owner)
        assigned[at] = unique_assignment(table[at])
    means = np.stack([patterns[assigned == c].mean(axis=0) if (assigned == c).any() else archetypes[c] for c in range(len(archetypes))])
    means = unit_rows(means)
    return means, assigned, np.abs((patterns * means[assigned]).sum(axis=1))
