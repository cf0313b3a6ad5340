"""Coupling of two sequences of a key against circular shifts: by lag, after events, around peaks, and at equal power."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.operators.asof import asof_nearest
from tessera.operators.chunks import chunk_of

#: Samples of a chunk of state codes.
CODES = 1 << 18
_NULL = "observed_coupling double, null_mean_coupling double, effect_mean_diff double, p_perm double"


correlation = K.correlation


def lagged(pairs: DataFrame, keys: list[str], a: str, b: str, *, lags: list[int], surrogates: int, seed: int, measure: Callable[[np.ndarray, np.ndarray], float] = K.mutual_information, order: str = "sample") -> DataFrame:
    """The measure at each lag against shifts of the second sequence: lag_samples, n_samples, observed, null mean, effect, p."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return K.shifted_coupling(part[a].to_numpy(), part[b].to_numpy(), lags, surrogates, seed, measure)

    return K.grouped(pairs.select(*keys, order, a, b), keys, f"lag_samples long, n_samples long, {_NULL}", kernel)


def shifted_information(pairs: DataFrame, keys: list[str], a: str, b: str, *, surrogates: int, seed: int, order: str = "sample", chunk: int = CODES) -> DataFrame:
    """``lagged`` at lag 0 by mutual information, for sequences too long for one task; order numbers don't repeat within a key.

    Chunks of samples become codes of a byte or two. Each chunk of the first sequence meets those of the second that some
    shift brings beside it; their joint counts add up over all chunks, so a task holds two chunks of codes.
    """
    at = [*keys, "__chunk"]

    def code(part: pd.DataFrame) -> pd.DataFrame:
        by = np.argsort(part[order].to_numpy(), kind="stable")
        out: dict[str, list] = {"n": [len(part)]}
        for name, column in (("a", a), ("b", b)):
            values, codes = np.unique(part[column].to_numpy(float)[by], return_inverse=True)
            out |= {f"{name}_values": [values], f"{name}_codes": [codes.astype(np.min_scalar_type(len(values))).tobytes()]}
        return pd.DataFrame(out)

    def moved(n: int) -> np.ndarray:
        return np.append(0, np.random.default_rng(seed).integers(1, max(2, n), size=max(1, surrogates)))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        """The chunks of the second sequence that meet each chunk of the first."""
        part = part.sort_values("__chunk")
        chunks, size = part["__chunk"].to_numpy(), part["n"].to_numpy()
        edge = np.append(0, np.cumsum(size))
        n, rows = int(edge[-1]), []
        shifts = moved(n)
        for i in range(len(chunks) if n > 1 else 0):
            low = (edge[i] - shifts) % n
            first, last = np.searchsorted(edge, low, "right") - 1, np.searchsorted(edge, low + size[i], "left") - 1
            # Behind the end the second sequence goes on with its start.
            again = np.searchsorted(edge, low + size[i] - n, "left")
            met = np.zeros(len(chunks) + 1, np.int64)
            np.add.at(met, first, 1)
            np.add.at(met, np.minimum(last, len(chunks) - 1) + 1, -1)
            np.add.at(met, 0, int((again > 0).sum()))
            np.add.at(met, again[again > 0], -1)
            rows += [(chunks[i], chunks[j], edge[i], edge[j], n) for j in np.flatnonzero(np.cumsum(met[:-1]))]
        return pd.DataFrame(rows, columns=["i", "j", "a_start", "b_start", "total"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        """Joint counts of two chunks at each shift."""
        (x, u, start), (y, v, other) = (
            (np.frombuffer(r["codes"], np.min_scalar_type(len(r["values"]))), np.asarray(r["values"]), r["start"]) for _, r in part.sort_values("second").iterrows()
        )
        n, width, out = int(part["total"].iloc[0]), len(v), []
        cells = x.astype(np.min_scalar_type(len(u) * width)) * np.array(width, np.min_scalar_type(len(u) * width))
        for k, shift in enumerate(moved(n).tolist()):
            table = np.zeros(len(u) * width, np.int64)
            for turn in (0, n):
                # Sample p of the first meets sample p - shift + turn of the second.
                by = shift - turn
                low, high = max(start, other + by), min(start + len(x), other + len(y) + by)
                if low < high:
                    table += np.bincount(cells[low - start : high - start] + y[low - by - other : high - by - other], minlength=len(table))
            hit = np.flatnonzero(table)
            out.append(pd.DataFrame({"k": k, "x": u[hit // width], "y": v[hit % width], "c": table[hit], "n": n}))
        return pd.concat(out)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        (u, x), (v, y) = np.unique(part["x"].to_numpy(), return_inverse=True), np.unique(part["y"].to_numpy(), return_inverse=True)
        tables = np.zeros((int(part["k"].max()) + 1, len(u), len(v)), np.int64)
        tables[part["k"].to_numpy(), x, y] = part["c"].to_numpy()
        observed, *null = map(K.information, tables)
        null = np.array(null)
        return pd.DataFrame([(0, part["n"].iloc[0], observed, null.mean(), observed - null.mean(), (np.sum(null >= observed) + 1) / (len(null) + 1))], columns=["lag_samples", "n_samples", "observed_coupling", "null_mean_coupling", "effect_mean_diff", "p_perm"])

    coded = K.grouped(pairs.select(*keys, chunk_of(order, chunk).alias("__chunk"), order, a, b), at, "n long, a_values array<double>, a_codes binary, b_values array<double>, b_codes binary", code)
    met = K.grouped(coded.select(*at, "n"), keys, "i long, j long, a_start long, b_start long, total long", meet)
    met = met.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "i", "j", "a_start", "b_start", "total")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    sides = [
        coded.select(*at, F.col(f"{name}_values").alias("values"), F.col(f"{name}_codes").alias("codes")).join(met, [*same, F.col("__chunk") == F.col(chunks)]).select(*keys, "i", "j", F.lit(name == "b").alias("second"), F.col(f"{name}_start").alias("start"), "total", "values", "codes")
        for name, chunks in (("a", "i"), ("b", "j"))
    ]
    counts = K.grouped(sides[0].unionByName(sides[1]), [*keys, "i", "j"], "k long, x double, y double, c long, n long", count)
    totals = counts.groupBy(*keys, "k", "x", "y").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    return K.grouped(totals, keys, f"lag_samples long, n_samples long, {_NULL}", compare)


def response_rates(events: DataFrame, responses: DataFrame, keys: list[str], *, event_state: str, state: str, window: float, surrogates: int, seed: int) -> DataFrame:
    """How often the second sequence switches (or goes to a state) within a window after each transition of the first."""
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    moves = S.transitions(events, keys, state=event_state)
    both = moves.select(*keys, F.col("event_sec").alias("time_sec"), "from_state", "to_state", *none("sample", "state")).unionByName(
        responses.select(*keys, "time_sec", *none("from_state", "to_state"), "sample", F.col(state).cast("long").alias("state"))
    )

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        asked, trace = part[part["state"].isna()], part[part["state"].notna()].sort_values("sample")
        asked = asked.rename(columns={"time_sec": "event_sec"}).astype({"from_state": "int64", "to_state": "int64"})
        return K.shifted_response_rates(asked, trace["time_sec"].to_numpy(float), trace["state"].to_numpy().astype(int), window, surrogates, seed)

    return K.grouped(both, keys, f"from_state long, to_state long, response_kind string, response_state long, n_events long, {_NULL}", kernel)


def peak_trajectory(trace: DataFrame, keys: list[str], *, value: str, peaks_of: str, before: int, after: int, surrogates: int, seed: int) -> DataFrame:
    """Mean of one trace at each offset from the peaks of another, with two-sided p against shifts."""
    peaks = S.local_maxima(trace, keys, value=peaks_of).select(*keys, "sample", F.lit(True).alias("__peak"))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample")
        return K.shifted_trajectory(part[value].to_numpy(float), np.flatnonzero(part["__peak"].notna().to_numpy()), before, after, surrogates, seed)

    joined = trace.select(*keys, "sample", value).join(peaks, [*keys, "sample"], "left")
    return K.grouped(joined, keys, f"offset_samples long, n_events long, {_NULL}", kernel)


def controlled_effects(aligned: DataFrame, keys: list[str], *, events: str, y: str, x: str = "gfp", samples: int = 5, tolerance: float = 0.004, moves: DataFrame | None = None) -> DataFrame:
    """``y`` from the transitions of a state on against before, at equal ``x``; ``aligned`` has a row for each sample.

    Events are those of ``moves`` (event_sec, from_state, to_state), or of the aligned state itself; each is at its
    nearest sample, which must be ``tolerance`` seconds away at most (half a sampling period and 2 ms at 250 Hz).
    """
    found = S.transitions(aligned, keys, state=events) if moves is None else moves
    asked = found.select(*keys, F.col("event_sec").alias("time_sec"), "from_state", "to_state")
    at = asof_nearest(asked, aligned.select(*keys, "time_sec", "sample"), keys, tolerance=tolerance).drop("time_sec")
    around = S.around_events(at, aligned.select(*keys, "sample", F.col(y).alias("y"), F.col(x).alias("x")), keys, before=samples, after=samples - 1)
    return C.event_adjusted_effect(around, [*keys, "from_state", "to_state"], y="y", x="x")
