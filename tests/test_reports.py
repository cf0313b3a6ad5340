"""Report tables, topographies, workbooks, parameter spellings and exploratory analyses on small tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import parameters as P
from tessera.operators import kernels as K
from tessera.operators import reports as O
from tessera.operators import stages
from tessera.operators import statistics as C
from tessera.operators import topography as T
from tessera.operators import vectors as V
from tessera.operators.regions import inventory, picked
from tessera.plans import exploratory, registry, table_queries, workflows
from tessera.sources.catalog import Catalog
from tessera.sources.workbook import read_workbook, write_workbook

SF = "/root/testdata/sf0.001"
SPELLINGS = {
    "peak_metric": {"rms": "rms", "RMS ": "rms", "std": "spatial-std", "spatial_std": "spatial-std", "spatial-stddev": "spatial-std"},
    "normalization": {"zscore": "zscore", "Z": "zscore", "robust": "robust-zscore", "robust_zscore": "robust-zscore", "mad-zscore": "robust-zscore"},
    "archetype_space": {"yeo17": "yeo17", "YEO-17": "yeo17", "aal": "aal3", "aal_3": "aal3", "aal3": "aal3"},
    "global_metric": {"rms": "rms", "envelope": "envelope-rms", "env_rms": "envelope-rms", "envelope-rms": "envelope-rms", "std": "spatial-std", "spatial-stddev": "spatial-std"},
    "weighting": {"equal": "equal", "sqrt": "sqrt-channel-count", "sqrt_channels": "sqrt-channel-count", "sqrt-channel-count": "sqrt-channel-count"},
    "connectivity": {"corr": "corr", "Pearson": "corr", "correlation": "corr", "plv": "plv", "phase_locking_value": "plv", "wpli": "wpli", "weighted_phase_lag_index": "wpli"},
    "backend": {"pca": "pca-kmeans", "pca_kmeans": "pca-kmeans"},
}


@pytest.mark.parametrize("kind", SPELLINGS)
def test_spellings(kind):
    assert {s: P.choice(kind, s) for s in SPELLINGS[kind]} == SPELLINGS[kind]
    with pytest.raises(ValueError, match=kind):
        P.choice(kind, "gfp")


def test_labels_and_shown_values(spark):
    assert P.metric_label("std", "sqrt") == "spatial-std__sqrt-channel-count"
    row = spark.createDataFrame([("A_12 L", "[1.5, x,3]", 0.0004, None)], "l string, c string, p double, n double")
    got = row.select(P.without_suffix(F.col("l")).alias("l"), P.coordinates(F.col("c")).alias("c"), P.shown_p(F.col("p")).alias("p"), P.shown_number(F.col("n")).alias("n")).first()
    assert (got.l, tuple(got.c), got.p, got.n) == ("A", (1.5, None, 3.0), "<0.001", "NA")


def test_shown_numbers_round_by_binary_value(spark):
    values = [0.0045, 0.0055, 0.0095, 0.0625, 1.0005, -0.0004, 1e22, float("inf"), float("nan"), None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", P.shown_number(F.col("v")).alias("shown"), P.shown_p(F.abs("v")).alias("p")).orderBy("i").collect()
    con = duckdb.connect()
    shown = [con.execute("select printf('%.3f', ?::double)", [v]).fetchone()[0] for v in values[:-1]]
    assert [r.shown for r in rows] == [*shown, "NA"]
    assert [r.p for r in rows[:3]] == ["0.004", "0.005", "0.009"]


NAMES = [n for n in registry.oracle_sql() if registry.queries()[n].__module__ == table_queries.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_table_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    found = registry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    shown = lambda v: f"{float(v):.4f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    assert sorted(tuple(map(shown, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(shown, r)) for r in rows)


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    table = spark.createDataFrame([("<a & b>", 1.5, 7, True), (None, None, None, False), (" x\n", float("nan"), -1, None)], "s string, d double, n long, b boolean").coalesce(1)
    write_workbook(table, path, "Report")
    assert [tuple(r) for r in read_workbook(spark, path, "Report").collect()] == [("<a & b>", "1.5", "7", "1"), (None, None, None, "0"), (" x\n", None, "-1", None)]
    with pytest.raises(ValueError, match="no sheet"):
        read_workbook(spark, path, "Other")
    with pytest.raises(ValueError, match="more rows"):
        O.check_sheet(spark.range(10), "t", most=10)


def test_sizes_and_support(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", float("nan")), (3, "a", 3.0), (4, "b", None)], "patient_id int, g string, loading double")
    got = {r.g: r for r in O.loading_support(rows, ["g"]).collect()}
    assert (got["a"].n_support, got["a"].mean_loading, got["b"].n_support, got["b"].mean_loading) == (2, 2.0, 0, None)
    groups = O.model_order_groups(rows.withColumn("n_states", F.lit(4)), ["g"], retained=4, values=["loading"])
    assert {(r.g, r.mean_loading, r.retained_main_text_default) for r in groups.collect()} == {("a", 2.0, True), ("b", None, True)}
    maps = spark.createDataFrame([(p, a, n, 0.5) for p, a, n in ((1, 0, 9), (2, 0, 5), (2, 1, 4), (3, 0, 6), (3, 1, 3))], "patient_id int, assigned_archetype int, n_samples long, assignment_similarity double")
    assert [r.patient_id for r in O.representatives(maps, 2).orderBy("representative_rank").collect()] == [2, 3]
    assert [r.patient_id for r in O.representatives(maps.where("assigned_archetype = 0 OR patient_id = 9"), 1).collect()] == [1]
    segments = spark.createDataFrame([("a", "SZ1", True, "ok"), ("a", "SZ1", True, "tolerated"), ("b", "SZ1", False, None)], "patient_id string, recording_state string, usable_segment boolean, qc_reason string")
    assert stages.distinct_recordings(segments).count() == 2 and stages.quality_rows(segments).count() == 2


def test_density_and_thin_plates(spark):
    points = [(0.1, 0.2), (0.5, 0.5), (0.5, 0.52), (0.9, 0.1)]
    got = np.zeros((11, 11))
    for r in O.density_grid(spark.createDataFrame(points, "x double, y double"), x="x", y="y", width=0.2, low=0.0, high=1.0, cells=11).collect():
        got[r.i, r.j] = r.density
    axis, near = np.linspace(0, 1, 11), np.rint(np.array(points) * 10) / 10
    want = sum(np.exp(-0.5 * ((axis[:, None] - x) ** 2 + (axis[None, :] - y) ** 2) / 0.04) for x, y in near)
    assert np.allclose(got, want / want.max())
    at = np.array([[-1, -1], [1, -1], [-1, 1], [1, 1], [0, 0]], float)
    grid = T.thin_plate_grid(at, np.array([1, 2, 3, 4, 9.0]), cells=3)
    assert np.allclose([grid[0, 0], grid[0, 2], grid[2, 0], grid[2, 2], grid[1, 1]], [1, 2, 3, 4, 9])


def signals(spark, patients=("a", "b"), n=300, channels=6):
    rng = np.random.default_rng(3)
    maps = rng.normal(size=(4, channels))
    rows = []
    for p in patients:
        states = np.repeat(rng.integers(0, 4, n // 10), 10)
        values = maps[states] * rng.normal(1, 0.3, (n, 1)) * rng.choice([-1, 1], (n, 1)) + rng.normal(0, 0.05, (n, channels))
        rows += [(p, s, s * 0.004, c, float(values[s, c])) for s in range(n) for c in range(channels)]
    return spark.createDataFrame(rows, "patient_id string, sample long, time_sec double, channel long, value double"), maps


def test_labels_by_templates_and_backfit(spark):
    table, maps = signals(spark)
    found = workflows.label_recordings(table, maps, P.RunConfig())
    got = found["labels"].toPandas().sort_values(["patient_id", "sample"])
    wide = table.toPandas().pivot(index=["patient_id", "sample"], columns="channel", values="value")
    centred = wide.to_numpy() - wide.to_numpy().mean(1, keepdims=True)
    scores = np.abs(K.unit_rows(centred) @ K.unit_rows(maps - maps.mean(1, keepdims=True)).T)
    least = round(30 / 1000 * 250)
    for p in ("a", "b"):
        own = wide.index.get_level_values(0) == p
        want = K.smooth_runs(scores[own].argmax(1), scores[own], least)
        assert got[got.patient_id == p].microstate.tolist() == want.tolist()
        assert np.allclose(got[got.patient_id == p]["corr"], scores[own][np.arange(own.sum()), want])
    templates = spark.createDataFrame([(i, K.unit_rows(maps - maps.mean(1, keepdims=True))[i].tolist()) for i in range(4)], "state int, template array<double>")
    patterns = V.to_arrays(table, ["patient_id"]).withColumn("pattern", V.unit_pattern(F.col("pattern")))
    best = V.backfit(patterns, templates, ["patient_id"]).toPandas().sort_values(["patient_id", "sample"])
    assert best.state.tolist() == scores.argmax(1).tolist() and np.allclose(best["corr"], scores.max(1))
    model = T.group_model(T.sampled_peaks(patterns, ["patient_id"], most=100, seed=1), 4, seed=1).toPandas()
    likeness = np.abs(K.unit_rows(np.stack(model.template)) @ K.unit_rows(maps - maps.mean(1, keepdims=True)).T)
    assert likeness.max(axis=0).min() > 0.9


def test_group_tests_equal_plain_versions(spark):
    rng = np.random.default_rng(5)
    rows = [("g", f"s{i:02d}", s, float(rng.normal(s * 0.3))) for i in range(9) for s in range(3)]
    table = spark.createDataFrame(rows, "grp string, subject string, microstate int, value double")
    matrix = np.array([r[3] for r in rows]).reshape(9, 3)
    one = C.omnibus(table, ["grp"], subject="subject", state="microstate", value="value", states=[0, 1, 2], seed=42, min_subjects=7).first()
    assert one.n_subjects == 9 and math.isclose(one.statistic, K.within_f(matrix)) and one.p_perm == K.within_permutation_p(matrix, 42) and math.isclose(one.mean_state_1, matrix[:, 1].mean())
    pairs = C.posthoc(table, ["grp"], subject="subject", state="microstate", value="value", seed=42, min_subjects=7).orderBy("state_a", "state_b").collect()
    for i, (r, (a, b)) in enumerate(zip(pairs, ((0, 1), (0, 2), (1, 2)), strict=True)):
        assert (r.state_a, r.state_b) == (a, b) and r.p_perm == K.sign_flip_p(matrix[:, b] - matrix[:, a], 42 + i) and r.q_fdr >= r.p_perm


def test_exploratory_analyses(spark):
    table, _ = signals(spark, patients=("a", "b", "c"))
    config = P.RunConfig(min_subjects=2)
    made = workflows.field_states(table, config)
    states = made["labels"].select("patient_id", "sample", "time_sec", "field_state", "corr").cache()
    labels = states.select("patient_id", "sample", "time_sec", ((F.col("field_state") + F.floor(F.col("sample") / 60)) % 4).cast("int").alias("microstate"), "corr")
    power = table.groupBy("patient_id", "sample").agg(F.min("time_sec").alias("time_sec"), F.stddev_pop("value").alias("gfp")).cache()
    tables = {
        "labels": labels, "power": power, "field_labels": states.drop("corr"), "global_trace": power.select("patient_id", "sample", "time_sec", F.abs(F.sin("gfp")).alias("global_value")),
        "templates": made["templates"].select("patient_id", "field_state", "pattern"), "mapping": table.select("patient_id", "channel").distinct().withColumn("region", F.concat(F.lit("r"), F.col("channel") % 3)),
        "topography": table, "assignments": states.select("patient_id", "field_state").distinct().withColumn("assigned_archetype", F.col("field_state")),
        "patterns": V.to_arrays(table.where("sample < 60"), ["patient_id"]),
        "eeg_templates": spark.createDataFrame([(i, np.roll([1.0, -1.0, 2.0] + [0.5] * (table.select("channel").distinct().count() - 3), i).tolist()) for i in range(4)], "microstate int, template array<double>"),
    }
    for name in sorted(set(exploratory.ANALYSES) - {"archetype-conditioned-eeg-topography"}):
        for part, df in exploratory.run(name, tables, config).items():
            # All groups come from one function; it is executed for some analyses, planned for all.
            assert df.columns if part.endswith(".group") and "coupling" not in part else df.limit(1).count() == 1, part
    topography = exploratory.run("archetype-conditioned-eeg-topography", tables, config)
    assert len(topography) == 12
    shared = {k.split(".")[1]: df.toPandas() for k, df in topography.items() if k.split(".")[1] in ("subject_similarity", "group_similarity", "subject_fine_lag", "subject_fine_lag_peaks")}
    columns = {k.split(".")[1]: set(df.columns) for k, df in topography.items()}
    likeness, maps = shared["subject_similarity"], topography["archetype-conditioned-eeg-topography.subject_maps"].toPandas().set_index(["patient_id", "assigned_archetype"])["map"]
    given = {r.microstate: r.template for r in tables["eeg_templates"].collect()}
    for r in likeness.itertuples():
        assert np.isclose(r.similarity, abs(np.corrcoef(maps[r.patient_id, r.assigned_archetype], given[r.microstate])[0, 1]))
    for (a, m), rows in likeness.groupby(["assigned_archetype", "microstate"]):
        one = shared["group_similarity"].query("assigned_archetype == @a and microstate == @m").iloc[0]
        assert one.n_subjects == len(rows) and np.isclose(one.median_similarity, rows.similarity.median()) and np.isclose(one.min_similarity, rows.similarity.min())
    curve = shared["subject_fine_lag"].set_index(["patient_id", "lag_samples"])["effect_mean_diff"]
    for r in shared["subject_fine_lag_peaks"].itertuples():
        assert curve[r.patient_id].idxmax() == r.peak_lag_samples and np.isclose(curve[r.patient_id].max(), r.peak_effect_mean_diff)
    assert {"mean_conditional_probability", "mean_state_samples", "q_fdr"} <= columns["group_preference"]
    assert {"summary_kind", "p_perm"} <= columns["group_fine_lag_peak_summary"] and {"mean_observed_coupling", "q_fdr"} <= columns["group_fine_lag"]
    assert set(n.split(".")[0] for n in exploratory.run("all", {"patterns": tables["patterns"]}, config)) == {"field-state-model-order-evaluation"}
    with pytest.raises(ValueError, match="needs the table"):
        exploratory.run("field-state-coupling", {}, config)
    with pytest.raises(ValueError, match="none of"):
        exploratory.run("other", tables, config)


def test_regions_inventory_and_latest(spark, tmp_path):
    rows = spark.createDataFrame([("a", "FP1"), ("a", "fz"), ("a", "X9")], "patient_id string, channel string")
    got = inventory(rows, ["patient_id"], required=("Fp1", "Fz", "Cz")).first()
    assert got.coverage.missing == ["Cz"] and got.coverage.extra == ["X9"] and not got.coverage.covers
    assert {(r.channel, r.channel_order) for r in picked(rows, ("Fz", "Fp1")).collect()} == {("Fz", 0), ("Fp1", 1)}
    atlas = spark.createDataFrame([("A1", "H", 0), ("A2", "H", 1), ("A3", "K", 2)], "contact string, label string, position int")
    table = spark.createDataFrame([("a", s, s * 0.1, c, float(s)) for s in range(3) for c in ("A1-A2", "A2-A3")], "patient_id string, sample long, time_sec double, channel string, value double")
    found = workflows.region_branch(table, atlas.withColumn("patient_id", F.lit("a")), P.RunConfig())
    assert [r.region for r in found["coverage"].collect()] == ["H"] and found["regions"].count() == 3
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.latest("c", "t") is None
    catalog.table("c", "t", "x", "k1", lambda: spark.range(1))
    assert catalog.latest("c", "t").endswith("t_x_k1")
