"""Segments, event stages, cohorts and stage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import runs, sample_period, transition_profile

# The stages of an event, in order.
STAGES = ("pre", "LVFA", "SZ", "post")
STAGE_IDS = ["patient_id", "seizure_id", "seizure_type", "recording_state", "stage", "stage_order", "segment_id"]
TOLERANCE = 1e-3


def _positive(c: Column) -> Column:
    return F.when(c >= 0, c)


def state_segments(annotations: DataFrame, *, status1: str, status2: str) -> DataFrame:
    """Segments of one state: a missing end or duration is completed; bounds are null where the segment isn't usable.

    ``annotations``: patient_id, status1, status2, start_sec, end_sec, duration_sec.
    """
    s, e, d = (_positive(F.col(c)) for c in ("start_sec", "end_sec", "duration_sec"))
    own = annotations.where((F.col("status1") == status1) & (F.col("status2") == status2))
    own = own.select("patient_id", s.alias("s"), F.coalesce(e, s + d).alias("e"), F.coalesce(d, e - s).alias("d"))
    usable = F.coalesce((F.col("s").isNotNull()) & (F.col("e") > F.col("s")) & (F.col("d") > 0), F.lit(False))
    keep = lambda c, n: F.when(usable, F.col(c)).alias(n)
    return own.select("patient_id", F.lit(f"{status1}_{status2}").alias("state"), keep("s", "start_sec"), keep("e", "end_sec"), keep("d", "duration_sec"), usable.alias("usable_segment"))


def stage_segments(annotations: DataFrame, *, tolerance: float = TOLERANCE) -> DataFrame:
    """Four ordered stage rows for each event, with the reasons that speak against them.

    ``annotations``: patient_id, status1 (starts with SZ), status2, and start, end and during of each stage. A stage must
    not begin before the latest end of the earlier ones; differences up to the tolerance are kept but told.
    """
    own = annotations.where(F.upper(F.trim("status1")).startswith("SZ"))
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(i).alias("stage_order"), *(F.col(f"{n}_{p}").cast("double").alias(c) for p, c in (("start", "s"), ("end", "e"), ("during", "d")))) for i, n in enumerate(STAGES)))
    flat = own.withColumn("__r", F.explode(rows)).select("patient_id", F.trim("status1").alias("seizure_id"), F.trim("status2").alias("seizure_type"), "__r.*")
    s, e, d = F.col("s"), F.col("e"), F.col("d")
    tol = F.lit(tolerance)
    missing = s.isNull() | e.isNull() | d.isNull()
    off = F.abs((e - s) - d)
    event = Window.partitionBy("patient_id", "seizure_id", "seizure_type").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    early = F.max("e").over(event) - s
    flat = flat.withColumns({"off": off, "early": early})
    reasons = F.filter(
        F.array(
            F.when(missing, F.lit("missing_stage_timing")),
            F.when(~missing & ((s < 0) | (e < 0) | (d < 0)), F.lit("negative_stage_timing")),
            F.when(~missing & ((e <= s) | (d <= 0)), F.lit("non_positive_duration")),
            F.when(~missing & (F.col("off") > 0) & (F.col("off") <= tol), F.lit("tolerated_duration_mismatch")),
            F.when(~missing & (F.col("off") > tol), F.lit("duration_mismatch")),
            F.when(~missing & (F.col("early") > tol), F.lit("stage_order_overlap")),
            F.when(~missing & (F.col("early") > 0) & (F.col("early") <= tol), F.lit("tolerated_stage_boundary_mismatch")),
        ),
        lambda r: r.isNotNull(),
    )
    bad = F.exists("reasons", lambda r: ~r.startswith("tolerated"))
    told = flat.withColumn("reasons", reasons)
    return told.select(
        "patient_id",
        "seizure_id",
        "seizure_type",
        F.concat_ws("_", "seizure_id", "seizure_type").alias("recording_state"),
        "stage",
        "stage_order",
        s.alias("start_sec"),
        e.alias("end_sec"),
        F.when(~missing, e - s).alias("duration_sec"),
        (~bad).alias("usable_segment"),
        F.when(F.size("reasons") == 0, "ok").otherwise(F.array_join("reasons", ";")).alias("qc_reason"),
        F.exists("reasons", lambda r: r.startswith("tolerated")).alias("timing_tolerance_applied"),
        F.concat_ws("_", "patient_id", "seizure_id", "seizure_type", "stage").alias("segment_id"),
    )


def cohort(recordings: DataFrame, segments: DataFrame, channels: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Include a recording, or the first reason against it: segment, assets, channels. A missing segment isn't usable.

    ``recordings``: patient_id, state, has_*; ``channels``: patient_id, channels ARRAY<STRING>.
    """
    assets = [c for c in recordings.columns if c.startswith("has_")]
    joined = recordings.join(segments.select("patient_id", "state", "usable_segment", "start_sec", "end_sec", "duration_sec"), ["patient_id", "state"], "left").join(channels, "patient_id", "left")
    lacking = F.array_except(F.array(*map(F.lit, required)), F.coalesce("channels", F.array().cast("array<string>")))
    complete = F.lit(True)
    for c in assets:
        complete &= F.coalesce(c, F.lit(False))
    reason = (
        F.when(~F.coalesce("usable_segment", F.lit(False)), F.concat(F.lit("invalid_"), F.lower("state"), F.lit("_segment")))
        .when(~complete, F.lit("missing_required_assets"))
        .when(F.size(lacking) > 0, F.lit(f"missing_standard{len(required)}_channels"))
    )
    return joined.select("patient_id", "state", reason.isNull().alias("include_main"), reason.alias("reason_excluded"), "start_sec", "end_sec", "duration_sec", (F.size(lacking) == 0).alias("covers_required"), lacking.alias("missing_channels"))


def stage_metrics(labels: DataFrame, ids: list[str], *, state: str = "microstate", confidence: str = "corr") -> DataFrame:
    """Occupancy, dwell, runs, occurrences a minute and mean confidence of each state of a segment.

    The duration is the time range, or samples times period if that is longer.
    """
    period = sample_period(labels, ids)
    extent = labels.groupBy(*ids).agg(F.count("*").alias("__total"), (F.max("time_sec") - F.min("time_sec")).alias("__range")).join(period, ids)
    counted = runs(labels, ids, state=state).groupBy(*ids, state).agg(F.sum("n_samples").alias("n_samples"), F.count("*").alias("n_runs"))
    sure = labels.groupBy(*ids, state).agg(F.avg(confidence).alias("mean_confidence"))
    duration = F.greatest("__range", F.col("__total") * F.col("sample_period_sec"))
    return counted.join(sure, [*ids, state]).join(extent, ids).select(
        *ids,
        state,
        (F.col("n_samples") / F.col("__total")).alias("occupancy"),
        (F.col("n_samples") / F.col("n_runs") * F.col("sample_period_sec")).alias("mean_dwell_sec"),
        "n_samples",
        "n_runs",
        F.try_divide(F.col("n_runs") * 60.0, duration).alias("occurrence_per_min"),
        "mean_confidence",
    )


def stage_transitions(labels: DataFrame, ids: list[str], *, state: str = "microstate") -> DataFrame:
    return transition_profile(labels, ids, state=state)


def joint_probabilities(pairs: DataFrame, ids: list[str], *, x: str, y: str) -> DataFrame:
    """Joint share of each pair of states and both conditional shares."""
    joint = pairs.groupBy(*ids, x, y).agg(F.count("*").alias("joint_samples"))
    by = lambda *c: F.sum("joint_samples").over(Window.partitionBy(*ids, *c))
    share = lambda *c: F.col("joint_samples") / by(*c)
    return joint.select(*ids, x, y, "joint_samples", share().alias("joint_probability"), share(x).alias(f"p_{y}_given_{x}"), share(y).alias(f"p_{x}_given_{y}"))


def distinct_recordings(segments: DataFrame) -> DataFrame:
    """The recordings that segments name, once each."""
    return segments.select("patient_id", "recording_state").distinct()


def quality_rows(segments: DataFrame) -> DataFrame:
    """Segments that can't be used, or with any remark."""
    return segments.where(~F.col("usable_segment") | (F.coalesce(F.col("qc_reason"), F.lit("ok")) != "ok"))


def denominators(segments: DataFrame, recordings: DataFrame, families: dict[str, str]) -> DataFrame:
    """Patients, recordings, segments and usable segments behind each metric family and stage.

    ``families`` names the eligibility column of each family; a segment counts for it if its recording is eligible.
    """
    joined = segments.join(recordings, ["patient_id", "recording_state"], "left")
    rows = F.filter(F.array(*(F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in families.items())), lambda f: f.isNotNull())
    flat = joined.withColumn("metric_family", F.explode(rows))
    usable = F.col("usable_segment")
    recording = F.concat_ws("|", "patient_id", "recording_state")
    return flat.groupBy("metric_family", "stage").agg(
        F.countDistinct("patient_id").alias("n_patients"),
        F.countDistinct(recording).alias("n_recordings"),
        F.count("*").alias("n_segments"),
        F.count_if(usable).alias("n_usable_segments"),
        F.countDistinct(F.when(usable, F.col("patient_id"))).alias("n_usable_patients"),
    )


def patient_means(table: DataFrame, keys: list[str], values: list[str], *, recording: str) -> DataFrame:
    """Mean over recordings of each value, with the number of recordings."""
    return table.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.countDistinct(recording).alias("n_recordings"))


def attach_assignments(labels: DataFrame, assignments: DataFrame, keys: list[str], *, state: str = "field_state") -> DataFrame:
    """Labels with their assigned archetype; without an assignment the state stands for itself, and that is told.

    Of several assignments of a state the first by archetype counts.
    """
    order = Window.partitionBy(*keys, state).orderBy("assigned_archetype")
    one = assignments.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return labels.join(one, [*keys, state], "left").withColumns({"is_fallback": F.col("assigned_archetype").isNull(), "assigned_archetype": F.coalesce("assigned_archetype", state)})


def weighted_loadings(metrics: DataFrame, loadings: DataFrame, *, on: str = "assigned_archetype") -> DataFrame:
    """Metric rows by the networks of their archetype's loadings (a map), weighted by occupancy."""
    flat = loadings.select(on, F.explode("loadings").alias("network", "loading_value")).where(F.col("loading_value").isNotNull())
    return metrics.join(flat, on).withColumn("weighted_loading", F.col("occupancy") * F.col("loading_value"))
