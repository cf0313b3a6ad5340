"""Event-stage workflow: index of usable stages, labels by fixed references, and the tables made from them.

Signals are long: the stage's ids (``stages.STAGE_IDS``), sample, time_sec, channel, value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.parameters import RunConfig
from tessera.operators import stages as T
from tessera.operators import topography as G
from tessera.operators import vectors as V
from tessera.operators.asof import asof_nearest
from tessera.operators.reports import check_sheet, tagged_union
from tessera.plans.workflows import export_tables
from tessera.sources import recordings
from tessera.sources.catalog import Catalog
from tessera.sources.workbook import write_workbook

IDS = T.STAGE_IDS
#: Eligibility behind each family of metrics.
FAMILIES = {"eeg_microstate": "eligible_paired_eeg_seeg", "seeg_field_state": "eligible_seeg_stage", "seeg_archetype": "eligible_seeg_stage", "relationship": "eligible_paired_eeg_seeg"}
_VALUES = ["occupancy", "mean_dwell_sec", "occurrence_per_min", "mean_confidence"]


def event_index(segments: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each (patient, recording) that segments name, with its assets, what it lacks and what it can be used for.

    ``files``: patient_id, recording_state, has_eeg, has_ref_seeg, has_bipolar, has_atlas; a recording without a row lacks all.
    """
    flags = ("has_eeg", "has_ref_seeg", "has_bipolar", "has_atlas")
    once = files.groupBy("patient_id", "recording_state").agg(*(F.bool_or(c).alias(c) for c in flags))
    named = T.distinct_recordings(segments).join(once, ["patient_id", "recording_state"], "left")
    return recordings.eligibility(named.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}))


def build_stage_index(annotations: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Stage segments, recordings, what speaks against some of either, and the denominators."""
    segments = T.stage_segments(annotations)
    index = event_index(segments, files)
    flags = index.select("patient_id", "recording_state", *sorted(set(FAMILIES.values())))
    return {
        "segments": segments,
        "recording_index": index,
        "segment_qc": T.quality_rows(segments),
        "eligibility_qc": index.where("NOT eligible_seeg_stage OR NOT eligible_paired_eeg_seeg"),
        "denominators": T.denominators(segments, flags, FAMILIES),
    }


def field_labels(signals: DataFrame, templates: DataFrame, assignments: DataFrame, config: RunConfig, ids: list[str] = IDS) -> DataFrame:
    """Labels by each patient's fixed templates, on the channels that both have and that vary, with their archetype.

    ``templates``: patient_id, channel, weights (a value for each state). Nothing is clustered again.
    """
    normal = V.normalise_channels(V.valid_channels(signals, ids), ids, strategy=config.field.normalization)
    shared = normal.join(templates, ["patient_id", "channel"])
    packed = shared.groupBy(*ids, "sample").agg(F.min("time_sec").alias("time_sec"), F.array_sort(F.collect_list(F.struct("channel", "value", "weights"))).alias("__c")).where(F.size("__c") >= 2)
    pattern = V.unit_pattern(F.transform("__c", lambda c: c["value"]))

    def score(p):
        of = lambda k: V.unit_pattern(F.transform("__c", lambda c: F.get(c["weights"], k)))
        return F.transform(F.sequence(F.lit(0), F.size(F.col("__c")[0]["weights"]) - 1), lambda k: F.abs(V.dot(p, of(k))))

    scored = packed.select(*ids, "sample", "time_sec", V.let(pattern, score).alias("scores"))
    least = max(1, round(config.field.min_duration_ms / 1000 * config.sample_rate))
    labels = G.smoothed_labels(scored, ids, least=least).withColumnRenamed("microstate", "field_state")
    return T.attach_assignments(labels, assignments, ["patient_id"])


def missing_labels(segments: DataFrame, labels: DataFrame, modality: str) -> DataFrame:
    """A row for each usable segment that gave no label; the others are processed all the same."""
    done = labels.select("segment_id").distinct()
    return segments.where("usable_segment").join(done, "segment_id", "left_anti").select("patient_id", "recording_state", "stage", "segment_id", F.lit(modality).alias("modality"), F.lit("no_labels").alias("reason"))


def run_stage_analysis(segments: DataFrame, eeg: DataFrame, seeg: DataFrame, eeg_templates: np.ndarray, field_templates: DataFrame, assignments: DataFrame, loadings: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """Labels, metrics, transitions, loadings, relationships, their means by patient, and the segments without labels.

    ``loadings``: assigned_archetype, loadings (network to value).
    """
    rate, ms = config.sample_rate, config.field.min_duration_ms
    power = eeg.groupBy(*IDS, "sample").agg(F.min("time_sec").alias("time_sec"), F.stddev_pop("value").alias("gfp"))
    arrays = V.to_arrays(eeg, IDS).join(power.drop("gfp"), [*IDS, "sample"])
    eeg_labels = G.label_fixed(arrays, eeg_templates, IDS, least=max(1, round(ms / 1000 * rate)))
    seeg_labels = field_labels(seeg, field_templates, assignments, config)
    paired = asof_nearest(eeg_labels.select(*IDS, "sample", "time_sec", "microstate"), seeg_labels.select(*IDS, "time_sec", "field_state", "assigned_archetype"), IDS, tolerance=config.tolerance_ms / 1000)
    eeg_metrics = T.stage_metrics(eeg_labels, IDS)
    archetype_metrics = T.stage_metrics(seeg_labels, IDS, state="assigned_archetype")
    relations = T.joint_probabilities(paired, IDS, x="microstate", y="assigned_archetype")
    by_power = eeg_labels.join(power.select(*IDS, "sample", "gfp"), [*IDS, "sample"], "left").groupBy(*IDS, "microstate")
    patients = lambda df, keys, values: T.patient_means(df, ["patient_id", "stage", "stage_order", *keys], values, recording="recording_state")
    return {
        "eeg_labels": eeg_labels,
        "eeg_gfp_trace": power,
        "seeg_labels": seeg_labels,
        "paired_labels": paired,
        "eeg_microstate_metrics": eeg_metrics,
        "eeg_microstate_transitions": T.stage_transitions(eeg_labels, IDS),
        "eeg_gfp_metrics": by_power.agg(F.avg("gfp").alias("mean_gfp"), F.median("gfp").alias("median_gfp"), F.max("gfp").alias("max_gfp")),
        "seeg_field_state_metrics": T.stage_metrics(seeg_labels, IDS, state="field_state"),
        "seeg_archetype_metrics": archetype_metrics,
        "seeg_archetype_transitions": T.stage_transitions(seeg_labels, IDS, state="assigned_archetype"),
        "seeg_loading_metrics": T.weighted_loadings(archetype_metrics, loadings),
        "relationship_metrics": relations,
        "patient_eeg_metrics": patients(eeg_metrics, ["microstate"], _VALUES),
        "patient_seeg_metrics": patients(archetype_metrics, ["assigned_archetype"], _VALUES),
        "patient_relationship_metrics": patients(relations, ["assigned_archetype", "microstate"], ["joint_probability", "p_assigned_archetype_given_microstate", "p_microstate_given_assigned_archetype"]),
        "processing_qc": tagged_union({"eeg": missing_labels(segments, eeg_labels, "eeg"), "seeg": missing_labels(segments, seeg_labels, "seeg")}, tag="branch").drop("branch"),
    }


def export_stage_tables(catalog: Catalog, tables: dict[str, DataFrame], config: RunConfig, *, out: str, workbooks: str | None = None) -> DataFrame:
    """CSV of every table, with ``workbooks`` (a local folder) also a workbook of those that fit a sheet, and the manifest."""
    manifest = export_tables(catalog, tables, config, family="seizure-stage", branch=config.analysis_state, out=out, bundle="seizure")
    if workbooks:
        for name, df in tables.items():
            try:
                check_sheet(df, name)
            except ValueError:
                continue  # its CSV holds it
            write_workbook(df.select(*(F.col(c) if "<" not in kind else F.to_json(c).alias(c) for c, kind in df.dtypes)), f"{workbooks}/{name}.xlsx", name)
    return manifest


def read_stage_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The Parquet tables of a folder that the workflow reads."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("eeg", "seeg", "field_templates", "assignments", "loadings", "eeg_templates")}
