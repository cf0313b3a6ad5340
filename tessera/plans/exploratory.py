"""Exploratory analyses by name: from label, power and network tables of all patients to subject and group tables.

Tables: ``labels`` (patient_id, sample, time_sec, microstate, corr), ``power`` (patient_id, sample, time_sec, gfp),
``field_labels`` (patient_id, sample, time_sec, field_state), ``global_trace`` (patient_id, sample, time_sec,
global_value), ``templates`` (patient_id, field_state, pattern), ``mapping`` (patient_id, channel, region),
``topography`` (patient_id, sample, channel, value), ``assignments`` (patient_id, field_state, assigned_archetype),
``eeg_templates`` (microstate, template).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.parameters import RunConfig
from tessera.operators import coupling as U
from tessera.operators import kernels as K
from tessera.operators import regions as R
from tessera.operators import reports as O
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.operators import topography as T
from tessera.operators import vectors as V
from tessera.operators.asof import asof_nearest
from tessera.operators.clustering import archetypes as clustered
from tessera.plans.workflows import KEY, aligned_coupling, group_statistics, state_coupling

Tables = dict[str, DataFrame]
#: Lags of the fine grid in samples, seconds after an event, samples around events and peaks, and shifts.
LAGS, WINDOW_SEC, AROUND, SURROGATES = tuple(range(-10, 11)), 0.25, 62, 128

ANALYSES: dict[str, Callable[[Tables, RunConfig], Tables]] = {}


def _analysis(name: str):
    def add(run: Callable[[Tables, RunConfig], Tables]):
        ANALYSES[name] = run
        return run

    return add


def _near(left: DataFrame, right: DataFrame, config: RunConfig) -> DataFrame:
    return asof_nearest(left, right, KEY, tolerance=config.tolerance_ms / 1000)


def _aligned(t: Tables, config: RunConfig) -> DataFrame:
    """Labels with power and field state, and whether each of the two sequences just switched."""
    both = _near(t["labels"].select(*KEY, "sample", "time_sec", "microstate"), t["power"].select(*KEY, "time_sec", "gfp"), config)
    both = _near(both, t["field_labels"].select(*KEY, "time_sec", "field_state"), config)
    both = S.switch_indicator(both, KEY, state="field_state", name="field_switch")
    return S.switch_indicator(both, KEY, state="microstate", name="label_switch")


@_analysis("field-state-coupling")
def field_state_coupling(t: Tables, config: RunConfig) -> Tables:
    effects = state_coupling(t["labels"], t["field_labels"], config)
    return {"subject": effects, "group": group_statistics(effects, ["lag_samples"], config)}


@_analysis("fine-lag-field-state-coupling")
def fine_lag_coupling(t: Tables, config: RunConfig) -> Tables:
    effects = state_coupling(t["labels"], t["field_labels"], config, lags=LAGS)
    group = O.with_means(group_statistics(effects, ["lag_samples"], config), effects, ["lag_samples"], _COUPLING)
    return {"subject": effects, "peaks": C.lag_peak(effects, KEY, lag="lag_samples", effect="effect_mean_diff"), "group": group}


@_analysis("field-state-to-eeg-switching")
def field_to_label_switching(t: Tables, config: RunConfig) -> Tables:
    rates = U.response_rates(t["field_labels"], t["labels"], KEY, event_state="field_state", state="microstate", window=WINDOW_SEC, surrogates=SURROGATES, seed=config.seed)
    return {"subject": rates, "group": group_statistics(rates, ["from_state", "to_state", "response_kind", "response_state"], config)}


@_analysis("transition-response")
def label_to_field_switching(t: Tables, config: RunConfig) -> Tables:
    rates = U.response_rates(t["labels"], t["field_labels"], KEY, event_state="microstate", state="field_state", window=WINDOW_SEC, surrogates=SURROGATES, seed=config.seed)
    return {"subject": rates, "group": group_statistics(rates, ["from_state", "to_state", "response_kind", "response_state"], config)}


@_analysis("gfp-controlled-field-state-to-eeg-switching")
def controlled_label_switching(t: Tables, config: RunConfig) -> Tables:
    effects = U.controlled_effects(_aligned(t, config), KEY, events="field_state", y="label_switch", samples=AROUND)
    return {"subject": effects, "group": group_statistics(effects, ["from_state", "to_state"], config)}


@_analysis("gfp-controlled-transition")
def controlled_transition(t: Tables, config: RunConfig) -> Tables:
    aligned = _near(_aligned(t, config), t["global_trace"].select(*KEY, "time_sec", "global_value"), config)
    effects = U.controlled_effects(aligned, KEY, events="microstate", y="global_value", samples=AROUND)
    return {"subject": effects, "group": group_statistics(effects, ["from_state", "to_state"], config)}


@_analysis("gfp-controlled-microstate")
def controlled_profile(t: Tables, config: RunConfig) -> Tables:
    aligned = _near(_aligned(t, config), t["global_trace"].select(*KEY, "time_sec", "global_value"), config)
    means = C.adjusted_means(aligned, KEY, group="microstate", y="global_value", x="gfp")
    value = next(c for c in means.columns if c.startswith("adjusted"))
    rows = means.withColumn("family", F.lit("global"))
    states = [r[0] for r in rows.select("microstate").distinct().orderBy("microstate").collect()]  # a few states
    made = {"seed": config.seed, "min_subjects": config.min_subjects, "subject": "patient_id", "state": "microstate", "value": value}
    return {"subject": means, "omnibus": C.omnibus(rows, ["family"], states=states, **made), "posthoc": C.posthoc(rows, ["family"], **made)}


@_analysis("gfp-global-coupling")
def global_coupling(t: Tables, config: RunConfig) -> Tables:
    pairs = _near(t["power"].select(*KEY, "sample", "time_sec", "gfp"), t["global_trace"].select(*KEY, "time_sec", "global_value"), config)
    effects = U.lagged(pairs, KEY, "gfp", "global_value", lags=list(LAGS), surrogates=SURROGATES, seed=config.seed, measure=U.correlation)
    return {"subject": effects, "group": group_statistics(effects, ["lag_samples"], config)}


@_analysis("peak-gfp-global-coupling")
def peak_global_coupling(t: Tables, config: RunConfig) -> Tables:
    pairs = _near(t["power"].select(*KEY, "sample", "time_sec", "gfp"), t["global_trace"].select(*KEY, "time_sec", "global_value"), config)
    effects = U.peak_trajectory(pairs, KEY, value="global_value", peaks_of="gfp", before=2 * AROUND, after=2 * AROUND, surrogates=SURROGATES, seed=config.seed)
    return {"subject": effects, "group": group_statistics(effects, ["offset_samples"], config)}


@_analysis("field-state-archetypes")
def archetypes(t: Tables, config: RunConfig) -> Tables:
    """Templates by region as oriented unit patterns, clustered over all patients."""
    long = t["templates"].select(*KEY, F.col("field_state").alias("sample"), F.posexplode("pattern").alias("channel", "value")).withColumn("channel", F.col("channel").cast("long"))
    units = R.region_signals(long, t["mapping"], KEY)
    regions = units.select("region").distinct()
    grid = long.select(*KEY, "sample").distinct().crossJoin(F.broadcast(regions)).join(units, [*KEY, "sample", "region"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    projected = V.to_arrays(grid, KEY, channel="region").withColumn("pattern", V.oriented(V.unit_pattern(F.col("pattern")))).withColumnRenamed("sample", "field_state")
    found = clustered(projected, config.field.n_states, config.seed, KEY)
    support = found.groupBy("assigned_archetype").agg(F.countDistinct("patient_id").alias("n_subjects"), F.avg("assignment_similarity").alias("mean_similarity"), F.first("archetype").alias("archetype"))
    return {"projections": projected, "assignments": found.drop("archetype"), "archetypes": support.where(F.col("n_subjects") >= config.min_subjects)}


_RESPONSE = ["from_state", "to_state", "response_kind", "response_state"]
_COUPLING = {"observed_coupling": "mean_observed_coupling", "null_mean_coupling": "mean_null_mean_coupling"}


def template_similarity(maps: DataFrame, templates: DataFrame) -> DataFrame:
    """Absolute correlation of each conditioned map with each label template (a few rows, constants of the projection)."""
    rows = sorted((int(r["microstate"]), r["template"]) for r in templates.select("microstate", "template").collect())  # a row for each state
    scored = T.confidence(maps, np.array([t for _, t in rows], float), pattern="map")
    pair = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k, _ in rows)).alias("microstate"), F.col("scores").alias("similarity"))).alias("__p")
    return scored.select(*KEY, "assigned_archetype", "n_samples", pair).select(*KEY, "assigned_archetype", "n_samples", F.col("__p.microstate").cast("long").alias("microstate"), "__p.similarity")


@_analysis("archetype-conditioned-eeg-topography")
def conditioned_topography(t: Tables, config: RunConfig) -> Tables:
    """Labels and topographies under each archetype: maps, likeness to the label templates, preference, lags and switches, by subject and group.

    Archetypes of fewer than ``min_subjects`` subjects are left out. ``eeg_templates``: microstate, template.
    """
    supported = t["assignments"].groupBy("assigned_archetype").agg(F.countDistinct("patient_id").alias("__n")).where(F.col("__n") >= config.min_subjects).select("assigned_archetype")
    assignments = t["assignments"].join(supported, "assigned_archetype", "left_semi")
    maps = T.topography(t["topography"], KEY).join(t["labels"].select(*KEY, "sample", "time_sec"), [*KEY, "sample"]).drop("sample")
    aligned = T.align_archetypes(t["labels"], maps, t["field_labels"].select(*KEY, "time_sec", "field_state"), assignments, KEY, tolerance=config.tolerance_ms / 1000)
    long = aligned.select(*KEY, "sample", "assigned_archetype", F.posexplode("map").alias("channel", "value"))
    by, group = [*KEY, "assigned_archetype"], ["assigned_archetype", "microstate"]
    subject_maps = V.mean_pattern(long, by)
    likeness = template_similarity(subject_maps, t["eeg_templates"])
    known = likeness.groupBy(*group).agg(F.countDistinct("patient_id").alias("n_subjects"), F.avg("similarity").alias("mean_similarity"), F.median("similarity").alias("median_similarity"), F.min("similarity").alias("min_similarity"))
    preference = C.preference(aligned, KEY, given="assigned_archetype", state="microstate")
    shares = {"conditional_probability": "mean_conditional_probability", "baseline_probability": "mean_baseline_probability", "joint_samples": "mean_joint_samples", "n_samples": "mean_state_samples"}
    period = S.sample_period(aligned, KEY)
    lagged = aligned_coupling(aligned, period, config, state="assigned_archetype", lags=LAGS, surrogates=SURROGATES)
    peaks = C.lag_peak(lagged, KEY, lag="lag_samples", effect="effect_mean_diff").join(period, KEY)
    ms = lambda c: F.rint(F.col(c) * F.col("sample_period_sec") * 1000)
    peaks = peaks.select(*KEY, "peak_lag_samples", ms("peak_lag_samples").alias("peak_lag_ms"), F.col("peak_effect").alias("peak_effect_mean_diff"), ms("peak_width_samples").alias("peak_width_ms"), "n_lags")
    kinds = peaks.unpivot(KEY, ["peak_lag_ms", "peak_effect_mean_diff", "peak_width_ms"], "summary_kind", "summary_value")
    states = t["field_labels"].join(assignments, [*KEY, "field_state"]).select(*KEY, "sample", "time_sec", "assigned_archetype")
    switches = U.response_rates(states, t["labels"], KEY, event_state="assigned_archetype", state="microstate", window=WINDOW_SEC, surrogates=SURROGATES, seed=config.seed)
    return {
        "subject_maps": subject_maps,
        "group_maps": V.mean_pattern(long, ["assigned_archetype"], min_subjects=config.min_subjects),
        "subject_similarity": likeness,
        "group_similarity": known.where(F.col("n_subjects") >= config.min_subjects),
        "subject_preference": preference,
        "group_preference": O.with_means(group_statistics(preference, group, config), preference, group, shares),
        "subject_fine_lag": lagged,
        "group_fine_lag": O.with_means(group_statistics(lagged, ["lag_ms"], config), lagged, ["lag_ms"], _COUPLING),
        "subject_fine_lag_peaks": peaks,
        "group_fine_lag_peak_summary": group_statistics(kinds, ["summary_kind"], config, value="summary_value"),
        "subject_transition_effects": switches,
        "group_transition_effects": group_statistics(switches, _RESPONSE, config),
    }


@_analysis("field-state-model-order-evaluation")
def model_order(t: Tables, config: RunConfig) -> Tables:
    """Fit and split-half stability of 2 to 7 templates on each patient's patterns (``patterns``: patient_id, sample, pattern)."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        matrix = K.unit_rows(np.stack(part.sort_values("sample")["pattern"].to_numpy()).astype(float))
        rows, before = [], np.nan
        for i, k in enumerate(k for k in range(2, 8) if k <= len(matrix)):
            templates, own, _ = K.polarity_clusters(matrix, k, config.seed + 1000 * i)
            fit = float(np.abs(matrix @ templates.T).max(axis=1).mean())
            share = np.bincount(own, minlength=k) / len(own)
            some = share[share > 0]
            rows.append((k, fit, fit - before, K.split_half(matrix, k, config.seed + 1000 * i), float(share.min()), float(-(some * np.log(some)).sum() / np.log(k))))
            before = fit
        return pd.DataFrame(rows, columns=["n_states", "template_fit", "fit_gain_from_prev_k", "split_half_stability", "min_state_peak_fraction", "occupancy_entropy"])

    values = ["template_fit", "fit_gain_from_prev_k", "split_half_stability", "min_state_peak_fraction", "occupancy_entropy"]
    subject = K.grouped(t["patterns"], KEY, "n_states long, " + ", ".join(f"{v} double" for v in values), kernel)
    return {"subject": subject, "group": O.model_order_groups(subject, [], retained=config.field.n_states, values=values)}


def run(name: str, tables: Tables, config: RunConfig) -> Tables:
    """One analysis, or with ``all`` those whose tables are there; names of the results start with the analysis."""
    if name != "all" and name not in ANALYSES:
        raise ValueError(f"{name} is none of {sorted(ANALYSES)}")
    out: Tables = {}
    for each in ANALYSES if name == "all" else (name,):
        given = Needed(tables)
        try:
            made = ANALYSES[each](given, config)
        except MissingTable as missing:
            if name != "all":
                raise ValueError(f"{each} needs the table {missing}") from None
            continue
        out.update({f"{each}.{k}": v for k, v in made.items()})
    return out


class MissingTable(LookupError):
    """An analysis asked for a table that is not there."""


class Needed(dict):
    """Tables by name; only asking for one that is missing counts as such, not any other lookup that fails inside an analysis."""

    def __missing__(self, name: str) -> DataFrame:
        raise MissingTable(name)
