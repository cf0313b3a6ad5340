"""The event-stage workflow on synthetic segments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.parameters import FieldKey, RunConfig
from tessera.operators import kernels as K
from tessera.operators import statistics as C
from tessera.operators.asof import next_event_within
from tessera.plans import seizure
from tessera.sources.catalog import Catalog
from tessera.sources.workbook import read_workbook

CONFIG = RunConfig(min_subjects=1, field=FieldKey(n_states=2, min_duration_ms=12))


def segment_rows(spark):
    rows = [("p", "s1", "focal", "SZ1", stage, i, f"p_SZ1_{stage}", i < 3, "ok" if i else "tolerated") for i, stage in enumerate(("pre", "LVFA", "SZ", "post"))]
    return spark.createDataFrame(rows, "patient_id string, seizure_id string, seizure_type string, recording_state string, stage string, stage_order int, segment_id string, usable_segment boolean, qc_reason string")


def stage_signals(spark, stages, maps):
    rng, rows = np.random.default_rng(2), []
    for i, stage in stages:
        for t in range(60):
            values = maps[(t // 10) % 2] * rng.normal(1, 0.2) * rng.choice([-1, 1]) + rng.normal(0, 0.02, maps.shape[1])
            rows += [("p", "s1", "focal", "SZ1", stage, i, f"p_SZ1_{stage}", t, t * 0.004, f"c{j}", float(v)) for j, v in enumerate(values)]
            rows.append(("p", "s1", "focal", "SZ1", stage, i, f"p_SZ1_{stage}", t, t * 0.004, "constant", 1.0))
    return spark.createDataFrame(rows, "patient_id string, seizure_id string, seizure_type string, recording_state string, stage string, stage_order int, segment_id string, sample long, time_sec double, channel string, value double")


def test_stage_analysis(spark, tmp_path):
    maps = np.array([[2, -1, -2, 1.0], [1, 2, -1, -2.0]])
    segments = segment_rows(spark)
    signals = stage_signals(spark, [(0, "pre"), (1, "LVFA")], maps)
    templates = spark.createDataFrame([("p", f"c{j}", maps[:, j].tolist()) for j in range(4)] + [("p", "elsewhere", [9.0, 9.0])], "patient_id string, channel string, weights array<double>")
    assignments = spark.createDataFrame([("p", 0, 5)], "patient_id string, field_state long, assigned_archetype long")
    loadings = spark.createDataFrame([(5, {"A": 0.5, "B": None})], "assigned_archetype long, loadings map<string,double>")
    eeg = signals.where("channel <> 'constant'")
    made = seizure.run_stage_analysis(segments, eeg, signals, maps, templates, assignments, loadings, CONFIG)
    assert len(made) == 16
    labels = made["seeg_labels"].toPandas()
    assert ((labels["sample"] // 10) % 2 == labels.field_state).mean() > 0.9
    assert set(labels[labels.field_state == 0].assigned_archetype) == {5} and set(labels[labels.field_state == 1].is_fallback) == {True}
    assert {(r.stage, r.modality) for r in made["processing_qc"].collect()} == {("SZ", "eeg"), ("SZ", "seeg")}
    shares = made["relationship_metrics"].groupBy("segment_id").agg(F.sum("joint_probability").alias("s")).collect()
    assert [round(r.s, 9) for r in shares] == [1.0, 1.0]
    assert {r.network for r in made["seeg_loading_metrics"].collect()} == {"A"}
    manifest = seizure.export_stage_tables(Catalog(spark, str(tmp_path)), {k: made[k] for k in ("eeg_microstate_metrics", "processing_qc")}, CONFIG, out=str(tmp_path / "csv"), workbooks=str(tmp_path))
    assert {r.label: r.row_count for r in manifest.collect()} == {"eeg_microstate_metrics": 4, "processing_qc": 2}
    assert read_workbook(spark, str(tmp_path / "processing_qc.xlsx")).count() == 2


def test_stage_index(spark):
    segments = segment_rows(spark).union(segment_rows(spark).withColumn("recording_state", F.lit("SZ2")))
    files = spark.createDataFrame([("p", "SZ1", True, True, False, True), ("p", "SZ1", False, True, True, True), ("q", "SZ9", True, True, True, True)], "patient_id string, recording_state string, has_eeg boolean, has_ref_seeg boolean, has_bipolar boolean, has_atlas boolean")
    got = {r.recording_state: r for r in seizure.event_index(segments, files).collect()}
    assert got["SZ1"].eligible_paired_eeg_seeg and got["SZ1"].missing_assets == "none" and not got["SZ2"].eligible_seeg_stage and len(got) == 2


def test_t_probabilities():
    for t, df, p in ((2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.706204736, 1, 0.05), (1.959963985, 10**7, 0.05), (-3.0, 4, 0.03994197)):
        assert math.isclose(K.t_two_sided(t, df), p, rel_tol=1e-5)


def test_permutation_null(spark):
    table = np.array([[0.9, 0.1, 0.2], [0.3, 0.8, 0.4]])
    rows = spark.createDataFrame([("a", i, i, table[i].tolist()) for i in range(2)], "patient_id string, field_state long, assigned_archetype long, likeness array<double>")
    long, summary = C.archetype_null(rows)
    assert long.where("source = 'null'").count() == 10 and long.where("source = 'observed'").count() == 2
    assert {(r.assigned_archetype, r.source): r.n_rows for r in summary.collect()}[(2, "null")] == 4


@pytest.mark.parametrize("window", [0.5, 3.0])
def test_next_events_across_buckets(spark, window):
    rng = np.random.default_rng(1)
    events, responses = np.sort(rng.uniform(-9000, 9000, 200)), np.sort(rng.uniform(-9000, 9000, 3000))
    left = spark.createDataFrame([("a", float(t)) for t in events], "k string, event_sec double")
    right = spark.createDataFrame([("a", float(t)) for t in responses], "k string, event_sec double")
    got = [r.responded for r in next_event_within(left, right, ["k"], window=window).orderBy("event_sec").collect()]
    assert got == [bool(((responses >= t) & (responses < t + window)).any()) for t in events]
