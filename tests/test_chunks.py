"""Steps over sequences in chunks, smoothing on runs, spaced peaks, sums of connectivity and nulls by transform, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import chunks as C
from tessera.operators import clustering as L
from tessera.operators import gram as G
from tessera.operators import kernels as K
from tessera.operators import sequence as S
from tessera.operators import smoothing as M

KEY = ["p"]
SIZES = (7, 64, 10**6)


@pytest.fixture(scope="module")
def sequence(spark):
    """Sequences with gaps, null states, a null key and a single row."""
    rng, rows = np.random.default_rng(0), []
    for p, n in (("a", 250), ("b", 250), (None, 90), ("one", 1)):
        jitter = 0.1 if p == "b" else 0.0
        for s in np.sort(rng.choice(900, n, replace=False)).tolist():
            rows.append((p, s, s * 0.25 + jitter * float(rng.random()), int(rng.integers(0, 3)) if rng.random() > 0.1 else None, float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "p string, sample long, time_sec double, state int, v double").repartition(3).cache()


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("chunk", SIZES)
def test_neighbours_and_totals(sequence, chunk):
    w = Window.partitionBy(*KEY).orderBy("sample")
    beside = C.neighbours(sequence, KEY, ["v"], chunk=chunk)
    assert beside.columns == [*sequence.columns, "v__before", "v__after"]
    assert rows(beside) == rows(sequence.withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w)}))
    assert rows(C.running_total(sequence, KEY, F.col("v"), "t", chunk=chunk)) == rows(sequence.withColumn("t", F.sum("v").over(w)))
    apart = F.coalesce((F.col("sample") - F.lag("sample").over(w) >= 6).cast("long"), F.lit(0))
    assert rows(C.separated(sequence, KEY, gap=6, chunk=chunk)) == rows(sequence.withColumn("n", apart).withColumn("group_id", F.sum("n").over(w)).drop("n"))


def slow_runs(table):
    out = []
    for p, part in table.sort_values("sample").groupby("p", dropna=False):
        previous = object()
        for s, t, state in zip(part["sample"].tolist(), part["time_sec"].tolist(), part["state"], strict=True):
            state = None if pd.isna(state) else int(state)
            if state == previous:
                out[-1] = (*out[-1][:4], out[-1][4] + 1, out[-1][5], t)
            else:
                number = out[-1][1] + 1 if out and previous in (None, 0, 1, 2) else 0
                out.append((None if pd.isna(p) else p, number, state, s, 1, t, t))
            previous = state
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", SIZES)
def test_runs_and_period(sequence, chunk):
    found = S.runs(sequence, KEY, state="state", chunk=chunk)
    assert rows(found) == slow_runs(sequence.toPandas())
    marked = C.marked_runs(sequence, KEY, state="state", chunk=chunk).groupBy(*KEY, "run_id").agg(F.min("sample").alias("s"), F.count("*").alias("n"))
    assert rows(marked) == rows(found.select(*KEY, "run_id", "start_sample", "n_samples"))
    period = {r["p"]: r["sample_period_sec"] for r in S.sample_period(sequence, KEY, chunk=chunk).collect()}
    for p, part in sequence.toPandas().sort_values("sample").groupby("p", dropna=False):
        steps = np.diff(part["time_sec"])
        assert np.isclose(period[None if pd.isna(p) else p], np.median(steps) if len(steps) else 0.0)


def test_a_task_sorts_a_chunk_or_edges(sequence):
    """The table is read once, and every window is partitioned by more than the key."""
    for table in (S.switch_indicator(sequence, KEY, state="state"), S.local_maxima(sequence, KEY, value="v"), C.neighbours(sequence, KEY, ["v"], chunk=50)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        windows = [line.split("], [")[1] for line in plan.splitlines() if "Window [" in line]
        assert len(windows) == 2 and all("," in part for part in windows)
        assert plan.count("InMemoryRelation") == 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.004, 0.004, 0.008, 1.0, 3600.0]), min_size=1, max_size=40))
def test_exact_median(spark, values):
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert np.isclose(C.exact_median(table, [], "x", "m").first()["m"], np.median(values))


def test_exact_median_of_many(spark):
    table = spark.range(60_001).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, 0.5).otherwise(F.rand(3) ** 9).alias("x")).cache()
    want = table.toPandas().groupby("k")["x"].median()
    assert all(r["m"] == want[r["k"]] for r in C.exact_median(table, ["k"], "x", "m").collect())


# ---- smoothing and peaks


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5), st.integers(0, 99))
def test_run_smoothing_equals_sample_smoothing(labels, least, seed):
    labels = np.array(labels)
    scores = np.random.default_rng(seed).integers(0, 50, (len(labels), 4)).astype(float)
    cut = np.append(0, np.flatnonzero(np.diff(labels)) + 1)
    size = np.diff(np.append(cut, len(labels)))
    new = M.smoothed_run_labels(size, labels[cut], np.add.reduceat(scores, cut, axis=0), least)
    assert np.repeat(new, size).tolist() == K.smooth_runs(labels, scores, least).tolist()


@pytest.mark.parametrize(("chunk", "stretches"), [(11, 3), (10**6, 1024)])
def test_smoothing_and_peaks_of_tables(spark, monkeypatch, chunk, stretches):
    monkeypatch.setattr(M, "STRETCHES", stretches)
    rng, table, smooth, peaks = np.random.default_rng(1), [], {}, {}
    for p, n in (("a", 300), (None, 120), ("flat", 30), ("one", 1)):
        labels = np.zeros(n, int) if p == "flat" else np.repeat(rng.integers(0, 4, n), rng.integers(1, 6, n))[:n]
        scores, trace = rng.random((n, 4)), np.round(rng.random(n) * 9)
        smooth[p] = K.smooth_runs(labels, scores, 3)
        at = K.spaced_peaks(trace, 5)
        peaks[p] = list(zip(range(len(at)), at.tolist(), trace[at].tolist(), strict=True))
        table += [(p, i, int(labels[i]), scores[i].tolist(), float(trace[i]), "other") for i in range(n)]
    df = spark.createDataFrame(table, "p string, sample long, label int, scores array<double>, trace double, note string").repartition(3)
    found = M.smooth_labels(df, KEY, label="label", scores="scores", n_labels=4, least=3, chunk=chunk)
    assert found.schema == df.schema
    got = found.collect()
    assert len(got) == len(table) and all(smooth[r["p"]][r["sample"]] == r["label"] for r in got)
    tops = M.spaced_maxima(df, KEY, value="trace", distance=5, chunk=chunk).collect()
    assert {p: sorted((r["peak_id"], r["sample"], r["trace"]) for r in tops if r["p"] == p) for p in peaks} == peaks


# ---- connectivity


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(90, 5)) + 1000.0
    table[:, 1] += 2 * table[:, 0]
    table[:, 3] = 0.1  # constant
    table[10:30, 4] = np.nan
    table[:, 2] -= np.arange(90) / 10
    long = [("p", t, f"r{c}", None if np.isnan(v) else float(v), t % 3) for t, r in enumerate(table) for c, v in enumerate(r)]
    return table, spark.createDataFrame(long, "p string, sample long, region string, value double, state long").repartition(4).cache()


@pytest.mark.parametrize("chunk", [8, 33, 8192])
def test_connectivity_of_chunks(signals, chunk):
    table, df = signals
    got = {(r["region_a"], r["region_b"]): (r["n_samples"], r["connectivity"]) for r in G.connectivity(df, KEY, chunk=chunk).collect()}
    want = {}
    for a in range(5):
        for b in range(a + 1, 5):
            x = table[:, [a, b]][~np.isnan(table[:, [a, b]]).any(axis=1)]
            if np.ptp(x, axis=0).min() > 0:
                want[f"r{a}", f"r{b}"] = (len(x), abs(np.corrcoef(x.T)[0, 1]))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], atol=1e-9) for k in want)


@pytest.mark.parametrize("chunk", [8, 8192])
def test_connectivity_inside_and_outside(signals, chunk):
    table, df = signals
    found = G.connectivity_on_off(df, KEY, state="state", min_samples=25, chunk=chunk).collect()
    assert found
    for r in found:
        pair = table[:, [int(r["region_a"][1]), int(r["region_b"][1])]]
        inside = np.arange(90) % 3 == r["state"]
        sides = [x[~np.isnan(x).any(axis=1)] for x in (pair[inside], pair[~inside])]
        assert [len(x) for x in sides] == [r["n_state_samples"], r["n_nonstate_samples"]]
        want = [abs(np.corrcoef(x.T)[0, 1]) for x in sides]
        assert np.allclose([r["state_connectivity"], r["off_connectivity"], r["effect_mean_diff"]], [*want, want[0] - want[1]], atol=1e-9)
    few = G.connectivity_on_off(df, KEY, state="state", min_samples=100, chunk=chunk)
    assert few.count() == 0


def test_phase_connectivity(spark):
    rng = np.random.default_rng(4)
    table = rng.normal(size=(64, 4))
    table[:, 3] = 0
    df = spark.createDataFrame([("p", t, c, float(v)) for t, r in enumerate(table) for c, v in enumerate(r)], "p string, sample long, channel long, value double")
    z = K.analytic(table.T)
    for chunk in (10, 8192):
        for r in G.phase_connectivity(df, KEY, chunk=chunk).collect():
            a, b = z[r["region_a"]], z[r["region_b"]]
            assert np.isclose(r["plv"], K.phase_locking(a, b)) and np.isclose(r["wpli"], K.weighted_phase_lag(a, b)) and r["n_samples"] == 64


# ---- nulls


def plain_information(a, b):
    n = len(a)
    table = pd.crosstab(a, b).to_numpy() / n
    h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    x, y = h(table.sum(axis=1)), h(table.sum(axis=0))
    return (x + y - h(table.ravel())) / np.sqrt(x * y) if x > 0 and y > 0 else 0.0


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 120), st.integers(0, 99))
def test_shifts_by_transform(n, seed):
    rng = np.random.default_rng(seed)
    a, b, u, v = rng.integers(0, 3, n), rng.integers(5, 9, n), rng.normal(size=n), rng.normal(size=n) + 100
    shifts = rng.integers(-n, 2 * n, 12)
    counts = K.shifted_counts(a, b - 5, 3, 4, shifts)
    assert all((t == K.crossed(a, np.roll(b, -s) - 5, 3, 4)).all() for t, s in zip(counts, shifts.tolist(), strict=True))
    found = K.shifted_information(a, b, shifts)
    assert found.tolist() == [K.mutual_information(a, np.roll(b, s)) for s in shifts.tolist()]  # bit by bit
    assert np.allclose(found, [plain_information(a, np.roll(b, s)) for s in shifts.tolist()])
    if n >= 3:
        assert np.allclose(K.shifted_correlation(u, v, shifts), [np.corrcoef(u, np.roll(v, s))[0, 1] for s in shifts.tolist()])


def test_lag_grid_and_trajectory_by_definition():
    rng = np.random.default_rng(6)
    a, b, trace = rng.integers(0, 3, 97), rng.integers(0, 4, 97), rng.normal(size=97)
    shifts = K.arithmetic_shifts(97, 20)
    for _, r in K.shifted_lag_grid(a, b, [-5, 0, 4], shifts).iterrows():
        lag = int(r["lag_samples"])
        value = [round(K.mutual_information(a[: 97 - lag], x[lag:]) if lag >= 0 else K.mutual_information(a[-lag:], x[:lag]), 9) for x in (np.roll(b, int(k)) for k in (0, *shifts))]
        assert r["observed_coupling"] == value[0] and r["null_mean_coupling"] == np.mean(value[1:])
    at = np.array([0, 2, 50, 51, 96])
    draws = np.random.default_rng(8)
    for _, r in K.shifted_trajectory(trace, at, 3, 3, 16, 8).iterrows():
        held = at + int(r["offset_samples"])
        held = held[(held >= 0) & (held < 97)]
        null = [trace[(held - k) % 97].mean() for k in draws.integers(1, 97, size=16)]
        assert np.isclose(r["null_mean_coupling"], np.mean(null)) and r["n_events"] == len(held)


def test_awkward_lengths_are_padded():
    assert K.transform_length(45_000) == 45_000 and K.transform_length(1) == 1
    for n in (13, 44_983, 44_987):
        assert 2 * n <= K.transform_length(n) <= 2.7 * n + 4


# ---- clustering


def test_templates_of_all_tasks_equal_one_group(spark):
    rng = np.random.default_rng(9)
    centres = K.unit_rows(rng.normal(size=(4, 12)))
    owners = np.sort(rng.integers(0, 5, 200))
    patterns = K.unit_rows((centres[rng.integers(0, 4, 200)] + 0.35 * rng.normal(size=(200, 12))) * rng.choice([-1, 1], 200)[:, None])
    df = spark.createDataFrame([(f"p{o}", i, p.tolist()) for i, (o, p) in enumerate(zip(owners, patterns, strict=True))], "patient_id string, sample long, pattern array<double>").repartition(5)
    seeds = [42, 43, 1]
    found = L.polarity_templates(df, 4, seeds, ["patient_id"], chunk=13)
    for templates, seed in zip(found, seeds, strict=True):
        assert np.allclose(templates, K.polarity_clusters(patterns, 4, seed)[0])
    assert np.allclose(L.mean_fits(df, found), [np.abs(patterns @ t.T).max(axis=1).mean() for t in found])
    assert np.allclose(L.polarity_templates(df, 1, [3], ["patient_id"])[0], K.polarity_clusters(patterns, 1, 3)[0])
    rows = {r["sample"]: r["row"] for r in L.numbered(df, ["patient_id"], chunk=7).collect()}
    assert rows == {i: i for i in range(200)}
    assert L.polarity_templates(df.where("sample < 0"), 4, [1], ["patient_id"])[0].size == 0


def test_archetypes_equal_one_group(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(4, 9))
    patterns = K.unit_rows(np.concatenate([base + 0.3 * rng.normal(size=(4, 9)) for _ in range(7)]))
    owners = np.repeat(np.arange(7), 4)
    df = spark.createDataFrame([(int(o), i % 4, p.tolist()) for i, (o, p) in enumerate(zip(owners, patterns, strict=True))], "patient_id long, field_state long, pattern array<double>").repartition(3)
    means, assigned, likeness = K.group_archetypes(patterns, owners, 4, 42)
    got = L.archetypes(df, 4, 42, ["patient_id"]).orderBy("patient_id", "field_state").collect()
    assert [r["assigned_archetype"] for r in got] == assigned.tolist() and np.allclose([r["assignment_similarity"] for r in got], likeness)
    assert all(np.allclose(r["archetype"], means[r["assigned_archetype"]]) for r in got)


def test_only_missing_tables_are_left_out(spark):
    from tessera.functions.parameters import RunConfig
    from tessera.plans import exploratory

    assert exploratory.run("all", {}, RunConfig()) == {}
    with pytest.raises(ValueError, match="needs the table"):
        exploratory.run("field-state-archetypes", {}, RunConfig())
    exploratory.ANALYSES["broken"] = lambda tables, config: {}["other"]
    try:
        with pytest.raises(KeyError):
            exploratory.run("all", {}, RunConfig())
    finally:
        del exploratory.ANALYSES["broken"]


def test_direct_states_meet_all_labels(spark):
    from tessera.plans import registry, table_queries

    sf = "/root/testdata/sf0.001"
    found = registry.queries()["direct_state_coupling"](spark, sf).toPandas()
    assert len(found) == 5 and found.n_samples.sum() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert found.p_perm.between(1 / 129, 1).all() and found.observed_coupling.between(0, 1).all()
    assert table_queries.DAY > 0


@pytest.mark.parametrize("chunk", [100, 10**6])
def test_shifted_information_of_chunks(spark, chunk):
    """Two chunks of codes in a task give what a whole sequence in one does; sample numbers have gaps, keys and states may be null."""
    from tessera.operators import coupling as U

    rng = np.random.default_rng(3)
    rows = [(p, int(s), None if rng.random() < 0.05 else int(rng.integers(-1, 3)), int(rng.integers(0, 300))) for p, n in (("a", 257), (None, 90), ("two", 2), ("one", 1)) for s in rng.choice(900, n, replace=False)]
    pairs = spark.createDataFrame(rows, "p string, sample long, x long, y long").repartition(3)
    want = U.lagged(pairs, KEY, "x", "y", lags=[0], surrogates=40, seed=5).toPandas()
    found = U.shifted_information(pairs, KEY, "x", "y", surrogates=40, seed=5, chunk=chunk).toPandas()
    order = lambda df: df.sort_values("n_samples").reset_index(drop=True)
    assert len(want) == 3
    pd.testing.assert_frame_equal(order(found), order(want), check_exact=True)


def test_direct_states_are_coupled_by_chunks(spark, monkeypatch):
    """The query brings no sequence whole to a kernel: with small chunks each kernel sees a chunk of samples at most."""
    from tessera.operators import coupling as U
    from tessera.plans import registry

    sf, grouped, seen = "/root/testdata/sf0.001", K.grouped, []

    def watched(table, keys, schema, kernel):
        seen.append((tuple(keys), tuple(table.columns)))
        return grouped(table, keys, schema, kernel)

    monkeypatch.setattr(K, "grouped", watched)
    monkeypatch.setattr(U.shifted_information, "__kwdefaults__", {**U.shifted_information.__kwdefaults__, "chunk": 50})
    found = registry.queries()["direct_state_coupling"](spark, sf)
    assert not any(keys == ("patient_id",) and {"microstate", "pattern"} & set(columns) for keys, columns in seen)
    monkeypatch.undo()
    want = registry.queries()["direct_state_coupling"](spark, sf).toPandas()
    pd.testing.assert_frame_equal(found.toPandas().sort_values("patient_id", ignore_index=True), want.sort_values("patient_id", ignore_index=True))


def test_component_scores_of_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(p, i, [*rng.normal(size=5).tolist(), 0.1]) for p, n in (("a", 70), (None, 40), ("few", 2)) for i in range(n)]
    table = spark.createDataFrame(rows, "p string, sample long, pattern array<double>").repartition(3)
    found = G.component_scores(table, KEY, 3, chunk=16).toPandas()
    for p, n in (("a", 70), (None, 40), ("few", 2)):
        part = found[found.p.isna() if p is None else found.p == p].sort_values("sample")
        want = K.principal_components(np.array([m[:5] for q, _, m in rows if q == p]), 3)
        assert len(part) == n and np.allclose(np.stack(part["scores"].to_numpy()), want, atol=1e-7)


def test_events_off_the_grid_take_the_nearest_sample(spark):
    from tessera.operators import coupling as U

    trace = spark.createDataFrame([("p", i, i * 0.004, float(i % 7), float(i >= 50)) for i in range(100)], "p string, sample long, time_sec double, gfp double, y double")
    moves = spark.createDataFrame([("p", 50 * 0.004 + 0.0015, 1, 2), ("p", 10.0, 1, 2)], "p string, event_sec double, from_state long, to_state long")
    one = U.controlled_effects(trace, ["p"], events="none", y="y", samples=5, moves=moves).collect()
    assert len(one) == 1 and one[0]["n_samples"] == 10 and np.isclose(one[0]["effect_mean_diff"], 1.0, atol=0.2)
