"""Registered queries take whole tables: expected rows come from DuckDB over every dimension and event."""

import duckdb
import numpy as np
import pytest

from tessera.operators import kernels as K
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
VECTORS = ["gfp_population_std", "channel_zscore", "channel_robust_zscore", "field_metric_trace", "map_pattern_unit_norm", "orient_pattern", "abs_similarity_argmax", "weighted_rms_std", "conditioned_maps", "group_conditioned_maps"]
REGIONS = ["region_mean_coverage", "pairwise_abs_corr", "state_connectivity_profile", "state_on_off_connectivity"]
LABELS = ["runs_contiguous", "state_occupancy_dwell", "transition_table", "transition_profile", "dense_transition_matrix", "event_onset_offset", "switch_indicator", "sample_period", "baseline_dense_states", "windowed_state_metrics", "windowed_region_metrics", "stage_state_metrics", "stage_transitions", "group_transition_summary"]


def rows(df):
    columns = sorted(df.columns)
    # four decimals: sums over 64 channels may differ in the last of the six
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(float, errors="ignore").itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [*VECTORS, *REGIONS, *LABELS])
def test_queries_read_whole_tables(spark, name):
    con = duckdb.connect()
    for table in ("events", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, SF).toPandas()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_pairs_of_all_channels(spark):
    found = registry.queries()["plv_wpli"](spark, SF).toPandas()
    assert set(found.groupby("patient_id").size()) == {2016}


def run(spark, name, sf=SF):
    return registry.queries()[name](spark, sf).toPandas()


def fitted(part=lambda n: slice(0, n)):
    """Four templates of each patient, from all its patterns or a part of them."""
    con = duckdb.connect()
    rows = con.execute(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").df()
    out = {}
    for patient, own in rows.groupby(rows.vec_id % 5):
        m = K.unit_rows(np.stack(own.embedding.to_numpy()).astype(float))
        out[patient] = K.polarity_clusters(m[part(len(m))], 4, 42)[0]
    return out


def test_assignment_of_fitted_halves(spark):
    early, late = fitted(lambda n: slice(0, n // 2)), fitted(lambda n: slice(n // 2, n))
    found = run(spark, "best_unique_assignment").sort_values(["patient_id", "row"])
    for patient, rows in found.groupby("patient_id"):
        assert rows.chosen.tolist() == K.unique_assignment(np.abs(early[patient] @ late[patient].T)).tolist()


def test_common_space_holds_fitted_templates(spark):
    found = run(spark, "project_common_space")
    for patient, templates in fitted().items():
        units = K.unit_rows(np.stack([templates[:, np.arange(64) % 3 == u].mean(axis=1) for u in range(3)], axis=1))
        units *= np.sign(units[np.arange(len(units)), np.abs(units).argmax(axis=1)])[:, None]
        own = found[found.patient_id == patient].pivot(index="field_state", columns="region", values="loading").sort_index()
        assert np.allclose(own[["r0", "r1", "r2"]].to_numpy(), units, atol=2e-6)


def test_similarity_of_fitted_templates(spark):
    made = fitted()
    table = np.stack([np.abs(made[p] @ made[0].T) for p in range(1, 5)])
    found = run(spark, "template_similarity_group").set_index(["archetype", "microstate"]).sort_index()
    assert len(found) == 16 and set(found.n_subjects) == {4}
    assert np.allclose(found.mean_similarity.to_numpy().reshape(4, 4), table.mean(axis=0), atol=2e-6)
    assert np.allclose(found.min_similarity.to_numpy().reshape(4, 4), table.min(axis=0), atol=2e-6)


def test_both_strata_and_all_aliases(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"  # strata of a few subjects drop out below
    for table in ("events", "customer"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    text = registry.oracle_sql()["stratified_delta"]
    want = con.execute(text.replace("SELECT grp, microstate, count", "SELECT grp, microstate, subject % 2 AS stratum, count").replace("WHERE subject % 2 = 0 GROUP BY 1, 2", "GROUP BY 1, 2, 3")).df()
    found = run(spark, "stratified_delta", sf)
    assert rows(found) == rows(want) and set(found.stratum) == {0, 1}
    assert rows(run(spark, "subject_alias", sf)) == rows(con.execute(registry.oracle_sql()["subject_alias"].replace(" WHERE c_nationkey = 3", "")).df())


def test_local_maxima_of_all_events(spark):
    con = duckdb.connect()
    want = con.execute(
        f"""WITH e AS (SELECT 'p' || (user_id % 10) AS patient_id, row_number() OVER w - 1 AS sample, value, lag(value) OVER w AS before, lead(value) OVER w AS after
        FROM '{SF}/events.parquet' WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id)) SELECT patient_id, sample FROM e WHERE value > before AND value > after"""
    ).df()
    assert len(want) > 0 and rows(run(spark, "local_maxima")) == rows(want)
