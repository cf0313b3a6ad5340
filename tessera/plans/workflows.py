"""Workflows: plans over all patients at once, from long signals and annotations to group tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.parameters import FieldKey, RunConfig
from tessera.operators import kernels as K
from tessera.operators import regions as R
from tessera.operators import sequence as S
from tessera.operators import stages as T
from tessera.operators import statistics as C
from tessera.operators import vectors as V
from tessera.operators.asof import asof_nearest
from tessera.operators.topography import label_fixed, topography
from tessera.sources import recordings
from tessera.sources.catalog import Catalog, manifest_row, supported, with_lineage

KEY = ["patient_id"]


def build_index(spark: SparkSession, root: str, annotations: DataFrame, channels: DataFrame, config: RunConfig, required: tuple[str, ...] = R.STANDARD) -> dict[str, DataFrame]:
    """Recording index with eligibility, segments of the analysis state, and the cohort decision."""
    status1, status2 = config.analysis_state.split("_", 1)
    index = recordings.eligibility(recordings.recording_index(spark, root, config.analysis_state))
    segments = T.state_segments(annotations, status1=status1, status2=status2)
    flags = index.select("patient_id", "state", *(c for c in index.columns if c.startswith("has_")))
    return {"recording_index": index, "segments": segments, "cohort": T.cohort(flags, segments, channels, required)}


def field_states(signals: DataFrame, config: RunConfig, *, peak_distance_ms: int = 10, most_peaks: int = 5000) -> dict[str, DataFrame]:
    """State sequence of each patient's channel vectors.

    Channels are normalised and each sample becomes a unit pattern and a power (DataFrame plans). Then, by patient:
    spaced power peaks, at most ``most_peaks`` of them by seeded choice, are clustered regardless of sign, every sample
    gets its most similar template, and short runs are smoothed.
    """
    key: FieldKey = config.field
    normal = V.normalise_channels(V.valid_channels(signals, KEY), KEY, strategy=key.normalization)
    power = V.field_power(normal, KEY, metric=key.peak_metric)
    patterns = V.to_arrays(normal, KEY).withColumn("pattern", V.unit_pattern(F.col("pattern")))
    times = signals.groupBy(*KEY, "sample").agg(F.min("time_sec").alias("time_sec"))
    samples = patterns.join(power.select(*KEY, "sample", "power"), [*KEY, "sample"]).join(times, [*KEY, "sample"])
    rate, k, seed = config.sample_rate, key.n_states, config.seed
    distance, least = max(1, round(peak_distance_ms / 1000 * rate)), max(1, round(key.min_duration_ms / 1000 * rate))

    def prepared(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows = rows.sort_values("sample")
        peaks = K.spaced_peaks(rows["power"].to_numpy(), distance)
        if len(peaks) > most_peaks:
            peaks = np.sort(np.random.default_rng(seed).choice(peaks, size=most_peaks, replace=False))
        return rows, np.stack(rows["pattern"].to_numpy()).astype(float), peaks

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of the labels, and of the templates (those without a sample): one clustering gives both."""
        rows, matrix, peaks = prepared(rows)
        names = ["sample", "time_sec", "field_state", "corr", "n_peak_maps", "pattern"]
        if not len(peaks):
            return pd.DataFrame([], columns=names)
        templates, own, _ = K.polarity_clusters(matrix[peaks], k, seed)
        likeness = np.abs(matrix @ templates.T)
        states = K.smooth_runs(likeness.argmax(axis=1), likeness, least)
        labels = pd.DataFrame({"sample": rows["sample"].to_numpy(), "time_sec": rows["time_sec"].to_numpy(), "field_state": states, "corr": likeness[np.arange(len(states)), states]})
        made = pd.DataFrame({"field_state": np.arange(len(templates)), "n_peak_maps": np.bincount(own, minlength=len(templates)), "pattern": list(templates)})
        both = pd.concat([labels, made], ignore_index=True).reindex(columns=names)
        return both.astype({"sample": "Int64", "n_peak_maps": "Int64"}).assign(pattern=both["pattern"].where(both["pattern"].notna(), None))

    found = K.grouped(samples, KEY, "sample long, time_sec double, field_state int, corr double, n_peak_maps long, pattern array<double>", fitted).persist()
    labels = found.where("sample IS NOT NULL").select(*KEY, "sample", "time_sec", "field_state", "corr")
    templates = found.where("sample IS NULL").select(*KEY, "field_state", "n_peak_maps", "pattern")
    return {
        "labels": key.add_to(labels),
        "templates": key.add_to(templates),
        "profiles": key.add_to(S.state_profile(labels, KEY, state="field_state")),
        "transitions": key.add_to(S.transition_profile(labels, KEY, state="field_state")),
    }


def label_recordings(signals: DataFrame, templates: np.ndarray, config: RunConfig) -> dict[str, DataFrame]:
    """Power, labels by fixed templates with their confidence, and the oriented topography of each sample."""
    least = max(1, round(config.field.min_duration_ms / 1000 * config.sample_rate))
    times = signals.groupBy(*KEY, "sample").agg(F.min("time_sec").alias("time_sec"), F.stddev_pop("value").alias("gfp"))
    rows = V.to_arrays(signals, KEY).join(times, [*KEY, "sample"])
    return {"power": times, "labels": label_fixed(rows, templates, KEY, least=least), "topography": topography(signals, KEY)}


def region_branch(signals: DataFrame, atlas: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """Channel mapping, region signals and their coverage: pairs of contacts in one region are averaged."""
    channels = signals.select(*KEY, F.col("channel").alias("bipolar_channel")).distinct()
    mapping = R.same_region_map(channels, atlas, KEY, parcellation=config.parcellation)
    valid = mapping.where("valid_same_region").select(*KEY, F.col("bipolar_channel").alias("channel"), "region")
    return {"mapping": mapping, "regions": R.region_signals(signals, valid, KEY), "coverage": R.region_coverage(valid, KEY)}


def state_coupling(labels: DataFrame, field_labels: DataFrame, config: RunConfig, *, lags: tuple[int, ...] = (0,), surrogates: int = 128) -> DataFrame:
    """Mutual information of two aligned sequences by patient and lag against circular shifts.

    A patient's seed is the run's seed plus its rank among the patients.
    """
    aligned = asof_nearest(labels.select(*KEY, "sample", "time_sec", "microstate"), field_labels.select(*KEY, "time_sec", "field_state"), KEY, tolerance=config.tolerance_ms / 1000)
    return aligned_coupling(aligned, S.sample_period(labels, KEY), config, lags=lags, surrogates=surrogates)


def aligned_coupling(aligned: DataFrame, period: DataFrame, config: RunConfig, *, state: str = "field_state", lags: tuple[int, ...] = (0,), surrogates: int = 128) -> DataFrame:
    """The coupling of two columns of an aligned table; ``period`` has each patient's sample period."""
    ranks = aligned.select(*KEY).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(*KEY)) - 1)  # a row for each patient

    def couple(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample")
        return K.shifted_coupling(rows["microstate"].to_numpy(), rows[state].to_numpy(), list(lags), surrogates, config.seed + int(rows["rank"].iloc[0]))

    schema = "lag_samples long, n_samples long, observed_coupling double, null_mean_coupling double, effect_mean_diff double, p_perm double"
    effects = K.grouped(aligned.select(*KEY, "sample", "microstate", state).join(ranks, KEY), KEY, schema, couple)
    return effects.join(period, KEY).withColumn("lag_ms", F.rint(F.col("lag_samples") * F.col("sample_period_sec") * 1000).cast("long")).drop("sample_period_sec")


def group_statistics(effects: DataFrame, keys: list[str], config: RunConfig, *, value: str = "effect_mean_diff") -> DataFrame:
    """Mean, median, sign-flip p and false-discovery-rate q by key, over keys with enough subjects.

    Seeds count all keys, also those that the support rule drops; q is computed on those that stay.
    """
    known = effects.where(F.col(value).isNotNull()).dropna(subset=keys)
    each = known.groupBy(*keys).agg(
        F.count("*").alias("n_subjects"), F.avg(value).alias("mean_effect"), F.median(value).alias("median_effect"), F.array_sort(F.collect_list(F.struct("patient_id", F.col(value).cast("double").alias("v")))).alias("__v")
    )  # a value for each subject
    ranked = each.withColumn("__rank", F.dense_rank().over(Window.orderBy(*keys)) - 1)  # a row for each key
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("__v", "__rank").schema)

    def flip(parts):
        for part in parts:
            p = [K.sign_flip_p(np.array([x["v"] for x in v], float), config.seed + int(r)) for v, r in zip(part["__v"], part["__rank"], strict=True)]
            yield part.drop(columns=["__v", "__rank"]).assign(p_perm=np.array(p, float))

    table = ranked.repartition(*keys).mapInPandas(flip, f"{head}, p_perm double").where(F.col("n_subjects") >= config.min_subjects)
    return C.benjamini_hochberg(table.withColumn("__all", F.lit(1)), ["__all"], tie=keys).drop("__all")  # a row for each key


def stage_analysis(labels: DataFrame, *, confidence: str = "corr") -> dict[str, DataFrame]:
    """State metrics and transitions of each stage segment, and their means by patient."""
    metrics = T.stage_metrics(labels, T.STAGE_IDS, confidence=confidence)
    moves = T.stage_transitions(labels, T.STAGE_IDS)
    values = ["occupancy", "mean_dwell_sec", "occurrence_per_min", "mean_confidence"]
    return {
        "stage_state_metrics": metrics,
        "stage_transitions": moves,
        "patient_state_metrics": T.patient_means(metrics, ["patient_id", "stage", "stage_order", "microstate"], values, recording="recording_state"),
        "patient_transitions": T.patient_means(moves, ["patient_id", "stage", "stage_order", "from_state", "to_state"], ["transition_probability"], recording="recording_state"),
    }


def export_tables(catalog: Catalog, tables: dict[str, DataFrame], config: RunConfig, *, family: str, branch: str, out: str, bundle: str = "main") -> DataFrame:
    """Write tables as CSV, group tables only with enough support, and return the manifest."""
    rows = None
    for name, df in tables.items():
        df = supported(df, config.min_subjects) if "n_subjects" in df.columns else df
        shown = with_lineage(df, family=family, branch=branch)
        flat = shown.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in shown.dtypes))
        recordings.write_report(flat, f"{out}/{bundle}_{name}")
        row = manifest_row(df, bundle=bundle, family=family, label=name, branch=branch, support="n_subjects")
        rows = row if rows is None else rows.unionByName(row)
    return rows
