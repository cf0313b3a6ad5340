import json

import numpy as np

from tessera import cli
from tessera.functions.parameters import FieldKey, RunConfig
from tessera.plans import workflows
from tessera.sources.catalog import Catalog

CONFIG = RunConfig(min_subjects=2, field=FieldKey(n_states=2, min_duration_ms=8))


def signals(spark):
    rng, rows = np.random.default_rng(1), []
    maps = np.array([[2, -1, -2, 1], [1, 2, -1, -2]], float)
    for patient in ("a", "b", "c"):
        for i in range(200):
            value = maps[(i // 20) % 2] * (1 + np.sin(i)) * (-1) ** i + rng.normal(0, 0.05, 4)
            rows += [(patient, "IDE_A", "seeg", i, 0.004 * i, f"c{j}", float(v)) for j, v in enumerate(value)]
    return spark.createDataFrame(rows, "patient_id string, recording_state string, modality string, sample long, time_sec double, channel string, value double")


def test_field_states_and_coupling(spark, tmp_path):
    made = workflows.field_states(signals(spark), CONFIG)
    labels = made["labels"].toPandas().sort_values(["patient_id", "sample"])
    truth = (labels["sample"] // 20) % 2
    agree = (labels["field_state"] == truth).groupby(labels["patient_id"]).mean()
    assert ((agree > 0.9) | (agree < 0.1)).all()
    assert set(made["templates"].toPandas().groupby("patient_id").size()) == {2}
    eeg = made["labels"].select("patient_id", "sample", "time_sec", (1 - made["labels"].field_state).alias("microstate"))
    effects = workflows.state_coupling(eeg, made["labels"], CONFIG, lags=(-1, 0, 1), surrogates=16)
    best = effects.toPandas()
    assert np.allclose(best[best.lag_samples == 0].observed_coupling, 1) and set(best.lag_ms) == {-4, 0, 4}
    group = workflows.group_statistics(effects, ["lag_samples"], CONFIG)
    assert group.count() == 3 and group.where("q_fdr < p_perm").count() == 0
    manifest = workflows.export_tables(Catalog(spark, str(tmp_path)), {"group": group, "templates": made["templates"]}, CONFIG, family="f", branch="b", out=str(tmp_path))
    assert {r.label: r.row_count for r in manifest.collect()} == {"group": 3, "templates": 6}
    assert spark.read.csv(str(tmp_path / "main_group"), header=True).count() == 3


def test_stage_analysis(spark):
    rows = [(p, e, "CPS", f"{e}_CPS", s, o, f"{p}_{e}_{s}", i, 0.004 * i, i // 4 % 2, 0.5) for p in "ab" for e in ("SZ1", "SZ2") for o, s in enumerate(("pre", "SZ")) for i in range(16)]
    labels = spark.createDataFrame(rows, "patient_id string, seizure_id string, seizure_type string, recording_state string, stage string, stage_order int, segment_id string, sample long, time_sec double, microstate int, corr double")
    made = workflows.stage_analysis(labels)
    assert made["stage_state_metrics"].count() == 16 and made["patient_state_metrics"].where("n_recordings = 2 AND occupancy = 0.5").count() == 8


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "state_occupancy_dwell" in capsys.readouterr().out
    out, log = str(tmp_path / "out"), tmp_path / "log"
    assert cli.main(["--log", str(log), "run", "sample_period", "--input", "/root/testdata/sf0.001", "--output", out]) == 0
    assert spark.read.parquet(out).count() == 10 and json.loads(log.read_text())["status"] == "ok"
