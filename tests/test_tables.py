import duckdb
import pytest

import __spark_entry__ as entry
from tessera.functions.parameters import FieldKey, RunConfig, branch_name, choice, content_hash
from tessera.operators import regions, stages
from tessera.plans import registry
from tessera.sources import recordings
from tessera.sources.catalog import Catalog, manifest_row
from tessera.streaming.labeller import label_stream

SF = "/root/testdata/sf0.001"


def test_choices():
    assert choice("normalization", " Robust_ZScore ") == "robust-zscore"
    with pytest.raises(ValueError):
        choice("weighting", "other")
    assert branch_name("IDE A / 1-40 Hz") == "ide_a_1_40_hz"
    assert content_hash({"b": 1, "a": 2}) == content_hash({"a": 2, "b": 1})
    assert RunConfig(field=FieldKey(peak_metric="std")).key != RunConfig().key


def test_state_segments(spark):
    rows = [("1", "IDE", "A", 20.0, 200.0, 180.0), ("2", "IDE", "A", None, 200.0, 180.0), ("3", "IDE", "A", 5.0, None, 10.0), ("4", "IDE", "S", 10.0, 130.0, 120.0)]
    table = spark.createDataFrame(rows, "patient_id string, status1 string, status2 string, start_sec double, end_sec double, duration_sec double")
    found = {r.patient_id: r for r in stages.state_segments(table, status1="IDE", status2="A").collect()}
    assert found["1"].usable_segment and not found["2"].usable_segment and found["3"].end_sec == 15.0 and "4" not in found


def stage_table(spark, **change):
    base = {"pre": (0, 10), "LVFA": (10, 12), "SZ": (12, 32), "post": (32, 47)}
    row = {"patient_id": "523619", "status1": "SZ1", "status2": "CPS"}
    for name, (a, b) in base.items():
        row |= {f"{name}_start": float(a), f"{name}_end": float(b), f"{name}_during": float(b - a)}
    row |= change
    schema = ", ".join(f"{k} {'string' if isinstance(row[k], str) else 'double'}" for k in row)
    return stages.stage_segments(spark.createDataFrame([tuple(row.values())], schema)).orderBy("stage_order").toPandas()


def test_stages(spark):
    assert stage_table(spark).usable_segment.tolist() == [True] * 4
    assert stage_table(spark, pre_during=None).qc_reason[0] == "missing_stage_timing"
    assert "non_positive_duration" in stage_table(spark, SZ_end=11.0).qc_reason[2]
    slight = stage_table(spark, LVFA_start=10.0005, LVFA_during=1.9995)
    assert slight.usable_segment.all()


def test_same_region(spark):
    atlas = spark.createDataFrame([("A1", "Right Hippocampus", 0), ("A2", "Right Hippocampus", 1), ("A3", "Right Amygdala", 2), ("B1", "N/A", 3), ("B2", None, 4)], "contact string, label string, position int")
    pairs = spark.createDataFrame([("A1-A2",), ("A2-A3",), ("B1-B2",), ("C",)], "bipolar_channel string")
    found = {r.bipolar_channel: r for r in regions.same_region_map(pairs, atlas, []).collect()}
    assert [k for k, r in found.items() if r.valid_same_region] == ["A1-A2"] and "C" not in found
    nets = spark.createDataFrame([("ContB_Temp_1 R",), ("TempPar_2 R",)], "l string")
    assert [r[0] for r in nets.select(regions.clean_label(nets.l, "yeo17")).collect()] == ["ContB", "TempPar"]


def test_region_mean(spark):
    values = [(t, c, v) for c, vs in (("A1-A2", (1.0, 2.0, 3.0)), ("A2-A3", (2.0, 4.0, 6.0))) for t, v in enumerate(vs)]
    signals = spark.createDataFrame([("p", *r) for r in values], "patient_id string, sample int, channel string, value double")
    mapping = spark.createDataFrame([("p", "A1-A2", "H"), ("p", "A2-A3", "H")], "patient_id string, channel string, region string")
    assert [r.value for r in regions.region_signals(signals, mapping, ["patient_id"]).orderBy("sample").collect()] == [1.5, 3.0, 4.5]
    assert regions.region_coverage(mapping, ["patient_id"]).first().n_bipolar_channels == 2


def test_recording_catalog(spark, tmp_path):
    for name in ("a/ref/IDE_A_eeg.fif", "a/ref/IDE_A_seeg.fif", "a/ref/IDE_A_seeg-1.fif", "a/bipolar/IDE_A_seeg-1.fif", "a/MNI/Atlas.tsv", "b/ref/IDE_A_eeg.fif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("Channel\tAAL3\nA1\tx\n")
    found = {r.patient_id: r for r in recordings.eligibility(recordings.recording_index(spark, str(tmp_path), "IDE_A")).collect()}
    assert found["a"].eligible_paired_eeg_seeg and found["a"].seeg_ref_path.endswith("IDE_A_seeg.fif") and found["a"].missing_assets == "none"
    assert not found["b"].eligible_seeg_stage and found["b"].missing_assets == "ref_seeg;bipolar_seeg;atlas"
    assert recordings.read_atlas(spark, str(tmp_path / "a/MNI/Atlas.tsv")).first().patient_id == "a"


def test_catalog_reuses_tables(spark, tmp_path):
    catalog, made = Catalog(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert catalog.table("c", "stem", "Branch 1", "abc", make).count() == 3
    assert made == [1] and [b for b, _ in catalog.branches("c", "stem", "abc")] == ["branch_1"]
    assert manifest_row(spark.range(3), bundle="b", family="f", label="l", branch="x").first().row_count == 3


def test_streaming_labels_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, -1.0]) for i in range(10)], "i long, pattern array<double>")
    templates = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "state long, template array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = label_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), templates)
    query = stream.writeStream.format("memory").queryName("labelled").start()
    query.processAllAvailable()
    query.stop()
    assert all(r.state == r.i % 2 for r in spark.table("labelled").collect())


@pytest.mark.parametrize("name", ["state_occupancy_dwell", "transition_profile", "asof_nearest_tolerance", "nmi_zero_lag", "stage_state_metrics", "bh_fdr"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "part"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, SF).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(float, errors="ignore").itertuples(index=False, name=None)))
    assert rows(found) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
