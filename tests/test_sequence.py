import numpy as np
import pandas as pd
import pytest

from tessera.operators import asof, sequence, statistics

KEY = ["patient_id"]
STATES = [0, 0, 1, 1, 2, 2, 3, 3, 0, 0, 1, 1, 2, 2, 3, 3]


def labels(spark, states=STATES, patient="a"):
    rows = [(patient, i, 0.004 * i, s, 0.9) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "patient_id string, sample long, time_sec double, microstate int, corr double")


def test_profile_of_two_sample_runs(spark):
    found = sequence.state_profile(labels(spark), KEY).toPandas()
    assert found.occupancy.tolist() == [0.25] * 4
    assert np.allclose(found.mean_dwell_sec, 0.008)
    assert found.n_runs.tolist() == [2] * 4


@pytest.mark.parametrize("chunk", [1, 3, 5, 1000])
def test_chunks_do_not_change_runs(spark, chunk):
    found = sequence.runs(labels(spark), KEY, chunk=chunk).orderBy("run_id").toPandas()
    assert found.microstate.tolist() == STATES[::2]
    assert found.start_sample.tolist() == list(range(0, 16, 2))
    assert found.n_samples.tolist() == [2] * 8


def test_transitions(spark):
    found = sequence.transition_profile(labels(spark), KEY).toPandas().sort_values("from_state")
    assert found.n_transitions.tolist() == [2, 2, 2, 1]
    assert found.transition_probability.tolist() == [1.0] * 4
    twelve = labels(spark, [0, 0, 1, 1, 2, 2, 1, 1, 0, 0, 2, 2])
    half = {(r.from_state, r.to_state): r.transition_probability for r in sequence.transition_profile(twelve, KEY).collect()}
    assert half == {(0, 1): 0.5, (0, 2): 0.5, (1, 2): 0.5, (1, 0): 0.5, (2, 1): 1.0}


def test_circular_shift_is_numpy_roll(spark):
    shifts = spark.createDataFrame([(k,) for k in (1, 5, 15)], "shift long")
    found = sequence.circular_shift(labels(spark), KEY, shifts, state="microstate").toPandas()
    for k, part in found.groupby("shift"):
        assert part.sort_values("sample").shifted.tolist() == np.roll(STATES, k).tolist()


def test_empty_labels(spark):
    empty = labels(spark).where("sample < 0")
    assert sequence.state_profile(empty, KEY).count() == 0
    assert sequence.windowed_states(empty, KEY, width=1.0).count() == 0


def test_nearest_prefers_the_last_earlier_row(spark):
    left = spark.createDataFrame([("a", 2.0)], "patient_id string, time_sec double")
    right = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", 3.0, 4)], "patient_id string, time_sec double, v int")
    found = asof.asof_nearest(left, right, KEY, tolerance=1.0)
    assert [r.v for r in found.collect()] == [2]
    assert asof.asof_nearest(left, right, KEY, tolerance=0.5).count() == 0
    assert [r.v for r in asof.asof_nearest(left, right, KEY, tolerance=0.5, how="left").collect()] == [None]


@pytest.mark.parametrize("bucket", [2, 4096])
def test_nearest_equals_pandas(spark, bucket):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"patient_id": "a", "time_sec": np.sort(rng.uniform(0, 100, 300).round(1))})
    right = pd.DataFrame({"patient_id": "a", "time_sec": np.unique(rng.uniform(0, 100, 150).round(1))})
    right["v"] = np.arange(len(right))
    left["i"] = np.arange(len(left))
    want = pd.merge_asof(left, right, on="time_sec", direction="nearest", tolerance=0.3)
    found = asof.asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), KEY, tolerance=0.3, how="left", bucket=bucket).toPandas().sort_values("i")
    assert found.v.fillna(-1).tolist() == want.v.fillna(-1).tolist()


def test_ancova_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=400), rng.integers(0, 4, 400)
    y = 0.7 * x + g + rng.normal(size=400)
    table = spark.createDataFrame(pd.DataFrame({"k": "a", "g": g, "x": x, "y": y}))
    found = statistics.adjusted_means(table, ["k"], group="g", y="y", x="x").toPandas().sort_values("g")
    design = np.column_stack([x - x.mean(), *(g == s for s in range(4))])
    beta = np.linalg.lstsq(design.astype(float), y, rcond=None)[0]
    assert np.allclose(found.beta, beta[0]) and np.allclose(found.adjusted_mean, beta[1:])


def test_benjamini_hochberg(spark):
    table = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.5, 0.04])], "f string, i int, p_perm double")
    found = statistics.benjamini_hochberg(table, ["f"]).toPandas().sort_values("i")
    assert np.allclose(found.q_fdr, [0.03, 0.048, 0.048, 0.03, 0.5, 0.048])


def test_constant_column_has_no_correlation(spark):
    table = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "k string, x double, y double")
    assert table.groupBy("k").agg(statistics.pearson("x", "y").alias("r")).first().r == 0.0


def test_plans_have_no_cross_product(spark):
    plan = asof.asof_nearest(labels(spark), labels(spark).select("patient_id", "time_sec", "corr"), KEY, tolerance=0.01)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
