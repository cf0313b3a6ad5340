"""Queries whose operators need grouped kernels; SQL can't express them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import coupling as U
from tessera.operators import gram as M
from tessera.operators import kernels as K
from tessera.operators import sequence as S
from tessera.operators import smoothing as Y
from tessera.operators import vectors as V
from tessera.operators.clustering import archetypes as clustered
from tessera.plans.registry import register
from tessera.plans.standins import SQL, aligned, effects, field, paired_labels, vectors
from tessera.plans.vector_queries import labelled_transitions, regions

KEY = ["patient_id"]


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows.sort_values("sample")["pattern"].to_numpy()).astype(float)


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return V.to_arrays(vectors(spark, d), KEY).withColumn("pattern", V.unit_pattern(F.col("pattern")))


@register("peaks_min_distance")
def peaks_min_distance(spark: SparkSession, d: str) -> DataFrame:
    return Y.spaced_maxima(field(spark, d).select("patient_id", "sample", "gfp"), KEY, value="gfp", distance=5)


@register("polarity_kmeans")
def polarity_kmeans(spark: SparkSession, d: str) -> DataFrame:
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        templates, labels, _ = K.polarity_clusters(_matrix(rows), 4, 42)
        return pd.DataFrame({"field_state": np.arange(len(templates)), "n_peak_maps": np.bincount(labels, minlength=len(templates)), "pattern": list(templates)})

    return K.grouped(_patterns(spark, d), KEY, "field_state long, n_peak_maps long, pattern array<double>", kernel)


@register("smooth_short_runs")
def smooth_short_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = field(spark, d).select("patient_id", "sample", F.col("field_state").cast("long").alias("field_state"), F.array(*(-F.abs(F.col("gfp") - F.lit(10.0 * i)) for i in range(4))).alias("scores"))
    return Y.smooth_labels(rows, KEY, label="field_state", scores="scores", n_labels=4, least=3).drop("scores")


@register("group_archetype_assignment")
def group_archetype_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Templates of each patient to group archetypes, clustered over all patients."""
    return clustered(polarity_kmeans(spark, d), 4, 42, KEY).drop("archetype")


@register("best_unique_assignment")
def best_unique_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Templates fitted to the earlier half of a patient's patterns to those fitted to the later half."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows)
        early, late = (K.polarity_clusters(part, 4, 42)[0] if len(part) else part for part in (m[: len(m) // 2], m[len(m) // 2 :]))
        chosen = K.unique_assignment(np.abs(early @ late.T))
        return pd.DataFrame({"row": np.arange(len(chosen)), "chosen": chosen})

    return K.grouped(_patterns(spark, d), KEY, "row long, chosen long", kernel)


@register("split_half_stability")
def split_half_stability(spark: SparkSession, d: str) -> DataFrame:
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k, K.split_half(_matrix(rows), k, 42 + k)) for k in range(2, 8)], columns=["n_states", "split_half_stability"])

    return K.grouped(_patterns(spark, d), KEY, "n_states long, split_half_stability double", kernel)


@register("model_order_subject")
def model_order_subject(spark: SparkSession, d: str) -> DataFrame:
    """Fit, occupancy range and entropy of each number of states."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        m, out = _matrix(rows), []
        for k in range(2, 8):
            _, labels, fit = K.polarity_clusters(m, k, 42 + 1000 * (k - 2))
            share = np.bincount(labels, minlength=k) / len(labels)
            p = share[share > 0]
            out.append((k, fit.mean(), np.median(fit), fit.min(), share.min(), share.max(), -(p * np.log(p)).sum() / np.log(k)))
        return pd.DataFrame(out, columns=["n_states", "mean_template_fit", "median_template_fit", "min_template_fit", "min_share", "max_share", "occupancy_entropy"])

    return K.grouped(_patterns(spark, d), KEY, "n_states long, mean_template_fit double, median_template_fit double, min_template_fit double, min_share double, max_share double, occupancy_entropy double", kernel)


@register("pca_kmeans_states")
def pca_kmeans_states(spark: SparkSession, d: str) -> DataFrame:
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample")
        scores = np.stack(rows["scores"].to_numpy())
        return pd.DataFrame({"sample": rows["sample"].to_numpy(), "seeg_state": K.euclidean_clusters(scores, 4, 42), "component_1": scores[:, 0]})

    return K.grouped(M.component_scores(_patterns(spark, d), KEY, 3), KEY, "sample long, seeg_state long, component_1 double", kernel)


#: The imaginary part of the analytic signal of each channel: a circular convolution with the transform's kernel.
_ANALYTIC = """, dims AS (SELECT patient_id, max(sample) + 1 AS n FROM vec GROUP BY 1),
ker AS (SELECT n, k, sum(CASE WHEN f = 0 THEN 1 WHEN 2 * f < n THEN 2 WHEN 2 * f = n THEN 1 ELSE 0 END * sin(2 * pi() * ((f * k) % n) / n)) / n AS g FROM (SELECT DISTINCT n FROM dims), range((SELECT max(n) FROM dims)) a(k), range((SELECT max(n) FROM dims)) b(f) WHERE k < n AND f < n GROUP BY 1, 2),
ana AS (SELECT v.patient_id, channel, (v.sample + k) % n AS sample, sum(value * g) AS im FROM vec v JOIN dims USING (patient_id) JOIN ker USING (n) GROUP BY 1, 2, 3),
hil AS (SELECT patient_id, channel, sample, value AS re, im, sqrt(value * value + im * im) AS size FROM vec JOIN ana USING (patient_id, channel, sample))
"""


@register("hilbert_envelope", SQL + _ANALYTIC + "SELECT patient_id, channel, sample, round(size, 6) AS envelope FROM hil")
def hilbert_envelope(spark: SparkSession, d: str) -> DataFrame:
    z = M.analytic_signals(vectors(spark, d), KEY)
    return z.select("patient_id", "channel", "sample", F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 6).alias("envelope"))


@register(
    "plv_wpli",
    SQL
    + _ANALYTIC
    + """SELECT a.patient_id, a.channel AS region_a, b.channel AS region_b, count(*) AS n_samples, round(sqrt(avg((a.re * b.re + a.im * b.im) / (a.size * b.size)) ** 2 + avg((a.im * b.re - a.re * b.im) / (a.size * b.size)) ** 2), 6) AS plv,
round(abs(avg(a.im * b.re - a.re * b.im)) / avg(abs(a.im * b.re - a.re * b.im)), 6) AS wpli FROM hil a JOIN hil b ON a.patient_id = b.patient_id AND a.sample = b.sample AND a.channel < b.channel GROUP BY 1, 2, 3""",
)
def plv_wpli(spark: SparkSession, d: str) -> DataFrame:
    found = M.phase_connectivity(vectors(spark, d), KEY)
    return found.select("patient_id", "region_a", "region_b", "n_samples", F.round("plv", 6).alias("plv"), F.round("wpli", 6).alias("wpli"))


@register("band_limited_resample")
def band_limited_resample(spark: SparkSession, d: str) -> DataFrame:
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x = K.band_limit(rows.sort_values("sample")["value"].to_numpy(float), 250.0, 1.0, 40.0)
        y = K.resample(x, max(1, len(x) // 2))
        return pd.DataFrame({"sample": np.arange(len(y)), "value": y})

    return K.grouped(vectors(spark, d), ["patient_id", "channel"], "sample long, value double", kernel)


@register("sign_flip_p")
def sign_flip_p(spark: SparkSession, d: str) -> DataFrame:
    """Group p-values; the seed of a key grows with its rank among all keys."""
    from pyspark.sql import Window

    rows = effects(spark, d)
    keys = rows.select("grp", "microstate").distinct().withColumn("ordinal", F.dense_rank().over(Window.orderBy("grp", "microstate")) - 1)  # a row for each key
    centred = rows.join(F.broadcast(keys), ["grp", "microstate"]).withColumn("value", F.col("value") - 50)

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("subject")
        return pd.DataFrame({"n_subjects": [len(part)], "p_perm": [K.sign_flip_p(part["value"].to_numpy(), 42 + int(part["ordinal"].iloc[0]))]})

    return K.grouped(centred, ["grp", "microstate"], "n_subjects long, p_perm double", kernel)


@register("within_subject_perm_p")
def within_subject_perm_p(spark: SparkSession, d: str) -> DataFrame:
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        m = part.pivot_table(index="subject", columns="microstate", values="value").dropna().to_numpy()
        return pd.DataFrame({"n_subjects": [len(m)], "statistic": [K.within_f(m)], "p_perm": [K.within_permutation_p(m, 42)]})

    return K.grouped(effects(spark, d), ["grp"], "n_subjects long, statistic double, p_perm double", kernel)


@register("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([K.bootstrap_interval(part.sort_values("subject")["value"].to_numpy(), 42)], columns=["mean", "ci_low", "ci_high"])

    return K.grouped(effects(spark, d), ["grp", "microstate"], "mean double, ci_low double, ci_high double", kernel)


@register("circular_shift_seeded")
def circular_shift_seeded(spark: SparkSession, d: str) -> DataFrame:
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample")
        return K.shifted_coupling(part["microstate"].to_numpy(), part["field_state"].to_numpy(), list(range(-10, 11)), 128, 42)

    schema = "lag_samples long, n_samples long, observed_coupling double, null_mean_coupling double, effect_mean_diff double, p_perm double"
    return K.grouped(aligned(spark, d).select("patient_id", "sample", "microstate", "field_state"), KEY, schema, kernel)


_NULL = "observed_coupling double, null_mean_coupling double, effect_mean_diff double, p_perm double"


def _response_rates(events: DataFrame, responses: DataFrame, state: str, window: float) -> DataFrame:
    event_state = next(c for c in ("microstate", "field_state") if c in events.columns)
    return U.response_rates(events, responses, KEY, event_state=event_state, state=state, window=window, surrogates=128, seed=42)


@register("response_rate_surrogates")
def response_rate_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """``window_response_rate`` and its rates by destination against 128 circular shifts."""
    return _response_rates(paired_labels(spark, d), field(spark, d), "field_state", 250.0)


@register("reverse_response_rate_surrogates")
def reverse_response_rate_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Label switches after transitions of the field state."""
    return _response_rates(field(spark, d), paired_labels(spark, d), "microstate", 250.0)


@register("destination_rate_surrogates")
def destination_rate_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """``destination_response_rate`` against 128 circular shifts."""
    return _response_rates(paired_labels(spark, d), field(spark, d), "field_state", 900.0).where("response_kind = 'destination-state'").drop("response_kind")


@register("peak_trajectory_surrogates")
def peak_trajectory_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """``peak_centered_trajectory`` against 128 circular shifts."""
    return U.peak_trajectory(aligned(spark, d), KEY, value="corr", peaks_of="gfp", before=5, after=5, surrogates=128, seed=42)


@register("event_locked_connectivity")
def event_locked_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Region connectivity in the 8 samples after against before the transitions of the labels."""
    signals = regions(spark, d).withColumn("time_sec", F.col("sample").cast("double"))
    return V.event_locked_connectivity(signals, labelled_transitions(spark, d), KEY, ["to_state"], window=8.0, min_samples=4)
