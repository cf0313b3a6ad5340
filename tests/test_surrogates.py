import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.operators import vectors as V
from tessera.plans import registry
from tessera.plans.standins import aligned

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def test_rates_have_a_null(spark):
    null, keys = run(spark, "response_rate_surrogates"), ["patient_id", "from_state", "to_state"]
    both = null[null.response_kind == "any-switch"].merge(run(spark, "window_response_rate"), on=keys, suffixes=("", "_plain"))
    assert len(both) == (null.response_kind == "any-switch").sum() > 0
    assert np.allclose(both.observed_coupling, both.rate) and (both.n_events == both.n_events_plain).all()
    keys += ["response_state"]
    plain = run(spark, "destination_response_rate")
    both = run(spark, "destination_rate_surrogates").merge(plain, on=keys, suffixes=("", "_plain"))
    assert len(both) == len(plain) and np.allclose(both.observed_coupling, both.rate) and (both.n_events == both.n_events_plain).all()
    assert both.p_perm.between(1 / 129, 1).all()


def test_locked_switches_differ_from_shifts():
    labels = np.repeat(np.random.default_rng(3).integers(0, 4, 400), 7)
    times = np.arange(len(labels)) * 0.5
    at = np.flatnonzero(np.diff(labels)) + 1
    events = pd.DataFrame({"event_sec": times[at] - 0.25, "from_state": 0, "to_state": 1})
    found = K.shifted_response_rates(events, times, labels, 0.5, 128, 42)
    row = found[found.response_kind == "any-switch"].iloc[0]
    assert row.observed_coupling == 1 and row.null_mean_coupling < 0.5 and row.n_events == len(at)
    # by the definition, for each shift
    want = []
    for k in np.random.default_rng(42).integers(1, len(labels), size=128):
        rolled = np.roll(labels, int(k))
        hit = times[1:][rolled[1:] != rolled[:-1]]
        want.append(np.mean([((hit >= e) & (hit < e + 0.5)).any() for e in events.event_sec]))
    assert np.isclose(row.null_mean_coupling, np.mean(want)) and np.isclose(row.p_perm, (np.sum(np.array(want) >= 1) + 1) / 129)


def test_trajectory_has_a_null(spark):
    both = run(spark, "peak_trajectory_surrogates").merge(run(spark, "peak_centered_trajectory"), on=["patient_id", "offset_samples"], suffixes=("", "_plain"))
    assert len(both) and np.allclose(both.observed_coupling, both.mean_value) and (both.n_events == both.n_events_plain).all()
    trace = np.zeros(500)
    trace[::50] = 1
    found = K.shifted_trajectory(trace, np.arange(0, 500, 50), 2, 2, 128, 42).set_index("offset_samples")
    assert found.loc[0].observed_coupling == 1 and found.loc[0].p_perm < 0.1 and found.loc[-1].n_events == 9


@pytest.mark.parametrize("method", ["corr", "plv", "wpli"])
def test_event_locked_connectivity(spark, method):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(60, 3))
    values[30:38, 1] = values[30:38, 0]
    values[20:24, 2] = 0
    rows = [("p", float(i), f"r{j}", float(v)) for i, r in enumerate(values) for j, v in enumerate(r)]
    signals = spark.createDataFrame(rows, "patient_id string, time_sec double, region string, value double")
    events = spark.createDataFrame([("p", 1, 30.0), ("p", 1, 20.0), ("p", 2, 24.5), ("p", 1, 2.0)], "patient_id string, to_state long, event_sec double")
    found = V.event_locked_connectivity(signals, events, ["patient_id"], ["to_state"], window=8.0, min_samples=4, method=method).collect()
    want = {}
    for state, at in ((1, 30.0), (1, 20.0), (2, 24.5)):
        t = np.arange(60.0)
        post, pre = (K.pair_connectivity(values[m], method) for m in ((t >= at) & (t < at + 8), (t >= at - 8) & (t < at)))
        for a in range(3):
            for b in range(a + 1, 3):
                if not np.isnan(post[a, b] + pre[a, b]):
                    want.setdefault((state, f"r{a}", f"r{b}"), []).append(post[a, b] - pre[a, b])
    assert {(r.to_state, r.region_a, r.region_b): r.n_events for r in found} == {k: len(v) for k, v in want.items()}
    assert all(np.isclose(r.effect_mean_diff, np.mean(want[r.to_state, r.region_a, r.region_b])) for r in found)
    if method == "corr":
        assert np.isclose(K.pair_connectivity(values[30:38], "corr")[0, 2], abs(np.corrcoef(values[30:38].T)[0, 2]))


def test_event_locked_query(spark):
    found = run(spark, "event_locked_connectivity")
    assert len(found) and (found.n_state_samples <= 8).all() and (found.n_nonstate_samples >= 4).all()


def test_lag_grids_have_all_lags_and_shifts(spark):
    for name in ("nmi_lag_grid_arith_surrogates", "circular_shift_seeded"):
        found = run(spark, name)
        assert set(found.groupby("patient_id").lag_samples.agg(lambda s: tuple(sorted(s)))) == {tuple(range(-10, 11))}
        hits = found.p_perm * 129
        assert np.allclose(hits, hits.round(), atol=1e-6) and hits.min() < 129 / 9
    assert K.arithmetic_shifts(5000, 128).max() > 4000 and set(K.arithmetic_shifts(2, 9)) == {1}
    p = run(spark, "within_subject_perm_p").p_perm * 2049
    assert np.allclose(p, p.round(), atol=1e-6)


def test_lag_grid_equals_its_plan(spark):
    pairs = aligned(spark, SF).select("patient_id", "sample", "microstate", "field_state").where("patient_id = 'p1'")
    part = pairs.toPandas().sort_values("sample")
    shifts = K.arithmetic_shifts(len(part), 6)
    found = K.shifted_lag_grid(part.microstate.to_numpy(), part.field_state.to_numpy(), [-2, 0, 3], shifts).set_index("lag_samples")
    asked = spark.createDataFrame([(i, int(k)) for i, k in enumerate((0, *shifts))], "s long, shift long")
    rolled = S.circular_shift(pairs, ["patient_id"], asked, state="field_state").select("patient_id", "sample", "s", F.col("shifted").alias("field_state"))
    lagged = S.lag_pairs(pairs.select("patient_id", "sample", "microstate"), rolled, ["patient_id"], [-2, 0, 3])
    value = C.mutual_information(lagged, ["lag_samples", "s"], "microstate", "field_state").toPandas()
    for lag, rows in value.groupby("lag_samples"):
        obs, null = rows[rows.s == 0].nmi.iloc[0], rows[rows.s > 0].nmi
        assert np.isclose(found.loc[lag].observed_coupling, obs, atol=1e-8) and np.isclose(found.loc[lag].null_mean_coupling, null.mean(), atol=1e-8)
        assert np.isclose(found.loc[lag].p_perm, ((null.round(9) >= round(obs, 9)).sum() + 1) / 7)
