"""Queries over segments, event stages and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import regions as R
from tessera.operators import stages as T
from tessera.plans.registry import register
from tessera.plans.standins import SQL, aligned, labels, read

IDS = ["patient_id", "stage"]


@register(
    "segments_usable",
    """WITH a AS (SELECT o_orderkey AS patient_id, nullif(o_custkey - 100, 37)::double AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey + o_orderkey % 90)::double END AS e, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 60 - 3)::double END AS d FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
b AS (SELECT patient_id, CASE WHEN s >= 0 THEN s END AS s, CASE WHEN e >= 0 THEN e END AS e, CASE WHEN d >= 0 THEN d END AS d FROM a), c AS (SELECT patient_id, s, coalesce(e, s + d) AS e, coalesce(d, e - s) AS d FROM b), u AS (SELECT *, coalesce(s IS NOT NULL AND e > s AND d > 0, false) AS ok FROM c)
SELECT patient_id, 'F_1-URGENT' AS state, CASE WHEN ok THEN s END AS start_sec, CASE WHEN ok THEN e END AS end_sec, CASE WHEN ok THEN d END AS duration_sec, ok AS usable_segment FROM u""",
)
def segments_usable(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, d, "orders").select(
        k.alias("patient_id"),
        F.col("o_orderstatus").alias("status1"),
        F.col("o_orderpriority").alias("status2"),
        F.nullif(c - 100, F.lit(37)).cast("double").alias("start_sec"),
        F.when(k % 5 != 0, (c + k % 90).cast("double")).alias("end_sec"),
        F.when(k % 7 != 0, (k % 60 - 3).cast("double")).alias("duration_sec"),
    )
    return T.state_segments(rows, status1="F", status2="1-URGENT")


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    bounds = []
    for i, name in enumerate(T.STAGES):
        start = (k % 11 + i * 20).cast("double")
        length = (10 + (k + i) % 17).cast("double")
        told = length + F.when((k + i) % 13 == 0, F.lit(0.0005)).when((k + i) % 29 == 0, F.lit(2.0)).otherwise(F.lit(0.0))
        bounds += [start.alias(f"{name}_start"), (start + length).alias(f"{name}_end"), F.when((k + i) % 31 != 0, told).alias(f"{name}_during")]
    return read(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("SZ"), k).alias("status1"), F.col("o_orderpriority").alias("status2"), *bounds)


_STG = """WITH a AS (SELECT o_custkey AS patient_id, 'SZ' || o_orderkey AS seizure_id, o_orderpriority AS seizure_type, o_orderkey AS k, i, ['pre', 'LVFA', 'SZ', 'post'][i + 1] AS stage, (o_orderkey % 11 + i * 20)::double AS s, (10 + (o_orderkey + i) % 17)::double AS len FROM orders, range(0, 4) r(i)),
b AS (SELECT *, s + len AS e, CASE WHEN (k + i) % 31 <> 0 THEN len + CASE WHEN (k + i) % 13 = 0 THEN 0.0005::double WHEN (k + i) % 29 = 0 THEN 2::double ELSE 0::double END END AS d FROM a),
c AS (SELECT *, abs((e - s) - d) AS off, max(e) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - s AS early, d IS NULL AS miss FROM b),
stg AS (SELECT *, list_filter([CASE WHEN miss THEN 'missing_stage_timing' END, CASE WHEN NOT miss AND off > 0 AND off <= 0.001 THEN 'tolerated_duration_mismatch' END, CASE WHEN NOT miss AND off > 0.001 THEN 'duration_mismatch' END,
 CASE WHEN NOT miss AND early > 0.001 THEN 'stage_order_overlap' END, CASE WHEN NOT miss AND early > 0 AND early <= 0.001 THEN 'tolerated_stage_boundary_mismatch' END], lambda x: x IS NOT NULL) AS rs FROM c),
seg AS (SELECT patient_id, seizure_id, seizure_type, seizure_id || '_' || seizure_type AS recording_state, stage, i::int AS stage_order, s AS start_sec, e AS end_sec, CASE WHEN NOT miss THEN e - s END AS duration_sec, len(list_filter(rs, lambda x: NOT starts_with(x, 'tolerated'))) = 0 AS usable_segment,
 CASE WHEN len(rs) = 0 THEN 'ok' ELSE array_to_string(rs, ';') END AS qc_reason, len(list_filter(rs, lambda x: starts_with(x, 'tolerated'))) > 0 AS timing_tolerance_applied, patient_id || '_' || seizure_id || '_' || seizure_type || '_' || stage AS segment_id FROM stg)
"""


@register("stage_unpivot_qc", _STG + "SELECT * FROM seg")
def stage_unpivot_qc(spark: SparkSession, d: str) -> DataFrame:
    return T.stage_segments(_events(spark, d))


@register("stage_qc_counts", _STG + "SELECT stage, qc_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY stage), 9) AS fraction FROM seg GROUP BY 1, 2")
def stage_qc_counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counted = T.stage_segments(_events(spark, d)).groupBy("stage", "qc_reason").agg(F.count("*").alias("n"))
    return counted.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("stage")), 9))


@register(
    "stage_duration_summary",
    _STG
    + """SELECT stage, seizure_type, count(*) AS n_segments, count(*) FILTER (usable_segment) AS n_usable, round(median(duration_sec), 6) AS median_sec, round(quantile_cont(duration_sec, 0.25), 6) AS q1_sec, round(quantile_cont(duration_sec, 0.75), 6) AS q3_sec, round(avg(duration_sec), 6) AS mean_sec, min(duration_sec) AS min_sec, max(duration_sec) AS max_sec
FROM seg GROUP BY GROUPING SETS ((stage, seizure_type), (stage))""",
)
def stage_duration_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = T.stage_segments(_events(spark, d))
    c = "duration_sec"
    return rows.groupingSets([[F.col("stage"), F.col("seizure_type")], [F.col("stage")]], "stage", "seizure_type").agg(
        F.count("*").alias("n_segments"),
        F.count_if("usable_segment").alias("n_usable"),
        F.round(F.median(c), 6).alias("median_sec"),
        F.round(F.percentile(c, F.lit(0.25)), 6).alias("q1_sec"),
        F.round(F.percentile(c, F.lit(0.75)), 6).alias("q3_sec"),
        F.round(F.avg(c), 6).alias("mean_sec"),
        F.min(c).alias("min_sec"),
        F.max(c).alias("max_sec"),
    )


_RECS = ", rec AS (SELECT DISTINCT o_custkey AS patient_id, 'SZ' || o_orderkey || '_' || o_orderpriority AS recording_state, o_orderkey % 3 <> 0 AS eligible_seeg_stage, o_orderkey % 6 = 1 AS eligible_paired_eeg_seeg FROM orders)"


@register(
    "stage_denominators",
    _STG.rstrip()
    + _RECS
    + """, f AS (SELECT 'seeg' AS metric_family, seg.* FROM seg JOIN rec USING (patient_id, recording_state) WHERE eligible_seeg_stage UNION ALL SELECT 'eeg_microstate', seg.* FROM seg JOIN rec USING (patient_id, recording_state) WHERE eligible_paired_eeg_seeg)
SELECT metric_family, stage, count(DISTINCT patient_id) AS n_patients, count(DISTINCT patient_id || '|' || recording_state) AS n_recordings, count(*) AS n_segments, count(*) FILTER (usable_segment) AS n_usable_segments, count(DISTINCT patient_id) FILTER (usable_segment) AS n_usable_patients FROM f GROUP BY 1, 2""",
)
def stage_denominators(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    recordings = read(spark, d, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.concat(F.lit("SZ"), k, F.lit("_"), "o_orderpriority").alias("recording_state"), (k % 3 != 0).alias("eligible_seeg_stage"), (k % 6 == 1).alias("eligible_paired_eeg_seeg")
    )
    return T.denominators(T.stage_segments(_events(spark, d)), recordings, {"seeg": "eligible_seeg_stage", "eeg_microstate": "eligible_paired_eeg_seeg"})


@register("patient_level_mean", _STG + "SELECT patient_id, stage, round(avg(duration_sec), 9) AS duration_sec, count(DISTINCT recording_state) AS n_recordings FROM seg GROUP BY 1, 2")
def patient_level_mean(spark: SparkSession, d: str) -> DataFrame:
    found = T.patient_means(T.stage_segments(_events(spark, d)), ["patient_id", "stage"], ["duration_sec"], recording="recording_state")
    return found.withColumn("duration_sec", F.round("duration_sec", 9))


@register("event_types_joined", _STG + "SELECT patient_id, string_agg(DISTINCT seizure_type, '+' ORDER BY seizure_type) AS types, count(DISTINCT seizure_id) AS n_events FROM seg GROUP BY 1")
def event_types_joined(spark: SparkSession, d: str) -> DataFrame:
    rows = T.stage_segments(_events(spark, d))
    return rows.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_set("seizure_type")), "+").alias("types"), F.countDistinct("seizure_id").alias("n_events"))


_COH = """WITH rec AS (SELECT c_custkey AS patient_id, 'IDE_A' AS state, c_custkey % 5 <> 0 AS has_eeg, c_custkey % 7 <> 0 AS has_atlas FROM customer),
sg AS (SELECT c_custkey AS patient_id, c_acctbal > 1000 AS usable_segment FROM customer WHERE c_custkey % 11 <> 0), ch AS (SELECT c_custkey AS patient_id, CASE WHEN c_nationkey % 3 = 0 THEN ['C3', 'C4', 'X1'] ELSE ['C3', 'C4', 'Cz'] END AS channels FROM customer WHERE c_custkey % 13 <> 0),
j AS (SELECT rec.*, usable_segment, list_filter(['C3', 'C4', 'Cz'], lambda x: NOT list_contains(coalesce(channels, []), x)) AS lack FROM rec LEFT JOIN sg USING (patient_id) LEFT JOIN ch USING (patient_id)),
r AS (SELECT *, CASE WHEN NOT coalesce(usable_segment, false) THEN 'invalid_ide_a_segment' WHEN NOT (has_eeg AND has_atlas) THEN 'missing_required_assets' WHEN len(lack) > 0 THEN 'missing_standard3_channels' END AS reason FROM j)
SELECT patient_id, state, reason IS NULL AS include_main, reason AS reason_excluded, len(lack) = 0 AS covers_required, array_to_string(lack, ';') AS missing_channels FROM r"""


@register("cohort_decision", _COH)
def cohort_decision(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    recordings = c.select(k.alias("patient_id"), F.lit("IDE_A").alias("state"), (k % 5 != 0).alias("has_eeg"), (k % 7 != 0).alias("has_atlas"))
    none = F.lit(None).cast("double")
    segments = c.where(k % 11 != 0).select(k.alias("patient_id"), F.lit("IDE_A").alias("state"), (F.col("c_acctbal") > 1000).alias("usable_segment"), none.alias("start_sec"), none.alias("end_sec"), none.alias("duration_sec"))
    names = lambda *x: F.array(*map(F.lit, x))
    channels = c.where(k % 13 != 0).select(k.alias("patient_id"), F.when(F.col("c_nationkey") % 3 == 0, names("C3", "C4", "X1")).otherwise(names("C3", "C4", "Cz")).alias("channels"))
    found = T.cohort(recordings, segments, channels, ("C3", "C4", "Cz"))
    return found.select("patient_id", "state", "include_main", "reason_excluded", "covers_required", F.array_join("missing_channels", ";").alias("missing_channels"))


_STA = SQL + ", sl AS (SELECT patient_id, 's' || (sample // 60) AS stage, sample, time_sec, microstate, corr FROM lab)"


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).withColumn("stage", F.concat(F.lit("s"), F.floor(F.col("sample") / 60)))


@register(
    "stage_state_metrics",
    _STA
    + """, i AS (SELECT *, sample - row_number() OVER (PARTITION BY patient_id, stage, microstate ORDER BY sample) AS g FROM sl), c AS (SELECT patient_id, stage, microstate, count(*) AS n, count(DISTINCT g) AS r, avg(corr) AS mc FROM i GROUP BY 1, 2, 3),
p AS (SELECT patient_id, stage, coalesce(median(d), 0) AS period FROM (SELECT *, time_sec - lag(time_sec) OVER (PARTITION BY patient_id, stage ORDER BY sample) AS d FROM sl) GROUP BY 1, 2), x AS (SELECT patient_id, stage, count(*) AS total, max(time_sec) - min(time_sec) AS rng FROM sl GROUP BY 1, 2)
SELECT patient_id, stage, microstate, round(n / total, 9) AS occupancy, round(n / r * period, 6) AS mean_dwell_sec, n AS n_samples, r AS n_runs, round(r * 60.0::double / nullif(greatest(rng, total * period), 0), 9) AS occurrence_per_min, round(mc, 9) AS mean_confidence FROM c JOIN p USING (patient_id, stage) JOIN x USING (patient_id, stage)""",
)
def stage_state_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = T.stage_metrics(_staged(spark, d), IDS)
    r = lambda c, n: F.round(c, n).alias(c)
    return found.select(*IDS, "microstate", r("occupancy", 9), r("mean_dwell_sec", 6), "n_samples", "n_runs", r("occurrence_per_min", 9), r("mean_confidence", 9))


@register(
    "stage_transitions",
    _STA
    + """, t AS (SELECT patient_id, stage, lag(microstate) OVER (PARTITION BY patient_id, stage ORDER BY sample) AS from_state, microstate AS to_state FROM sl)
SELECT patient_id, stage, from_state, to_state, count(*) AS n_transitions, round(count(*) / sum(count(*)) OVER (PARTITION BY patient_id, stage, from_state), 9) AS transition_probability FROM t WHERE from_state <> to_state GROUP BY 1, 2, 3, 4""",
)
def stage_transitions(spark: SparkSession, d: str) -> DataFrame:
    return T.stage_transitions(_staged(spark, d), IDS).select(*IDS, "from_state", "to_state", "n_transitions", F.round("transition_probability", 9).alias("transition_probability"))


@register("stage_gfp", SQL + "SELECT patient_id, 's' || (sample // 60) AS stage, microstate, round(avg(gfp), 9) AS mean_gfp, round(median(gfp), 9) AS median_gfp, max(gfp) AS max_gfp FROM ali GROUP BY 1, 2, 3")
def stage_gfp(spark: SparkSession, d: str) -> DataFrame:
    staged = aligned(spark, d).withColumn("stage", F.concat(F.lit("s"), F.floor(F.col("sample") / 60)))
    return staged.groupBy(*IDS, "microstate").agg(F.round(F.avg("gfp"), 9).alias("mean_gfp"), F.round(F.median("gfp"), 9).alias("median_gfp"), F.max("gfp").alias("max_gfp"))


@register(
    "paired_joint_probabilities",
    SQL
    + """, j AS (SELECT patient_id, microstate, field_state, count(*) AS c FROM ali GROUP BY 1, 2, 3)
SELECT patient_id, microstate, field_state, c AS joint_samples, round(c / sum(c) OVER (PARTITION BY patient_id), 9) AS joint_probability, round(c / sum(c) OVER (PARTITION BY patient_id, microstate), 9) AS p_field_state_given_microstate, round(c / sum(c) OVER (PARTITION BY patient_id, field_state), 9) AS p_microstate_given_field_state FROM j""",
)
def paired_joint_probabilities(spark: SparkSession, d: str) -> DataFrame:
    found = T.joint_probabilities(aligned(spark, d), ["patient_id"], x="microstate", y="field_state")
    return found.select("patient_id", "microstate", "field_state", "joint_samples", *(F.round(c, 9).alias(c) for c in ("joint_probability", "p_field_state_given_microstate", "p_microstate_given_field_state")))


@register(
    "assignment_fallback_join",
    SQL + """, a AS (SELECT 'p' || s_suppkey % 10 AS patient_id, s_nationkey % 4 AS field_state, min(s_nationkey % 7) AS arch FROM supplier WHERE s_nationkey % 4 < 2 GROUP BY 1, 2)
SELECT f.patient_id, f.sample, f.field_state, coalesce(arch, f.field_state)::bigint AS assigned_archetype, arch IS NULL AS is_fallback FROM fld f LEFT JOIN a USING (patient_id, field_state)""",
)
def assignment_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.standins import field

    given = read(spark, d, "supplier").where("s_nationkey % 4 < 2").select(F.concat(F.lit("p"), F.col("s_suppkey") % 10).alias("patient_id"), (F.col("s_nationkey") % 4).cast("long").alias("field_state"), (F.col("s_nationkey") % 7).cast("long").alias("assigned_archetype"))
    found = T.attach_assignments(field(spark, d).select("patient_id", "sample", "field_state"), given, ["patient_id"])
    return found.select("patient_id", "sample", "field_state", "assigned_archetype", "is_fallback")


@register(
    "loading_weighted",
    SQL
    + """, o AS (SELECT patient_id, field_state, count(*) / sum(count(*)) OVER (PARTITION BY patient_id) AS occ FROM fld GROUP BY 1, 2), l AS (SELECT p_size % 4 AS field_state, p_brand AS network, avg(p_retailprice) AS v FROM part GROUP BY 1, 2)
SELECT patient_id, field_state AS assigned_archetype, network, round(occ, 9) AS occupancy, round(v, 6) AS loading_value, round(occ * v, 6) AS weighted_loading FROM o JOIN l USING (field_state)""",
)
def loading_weighted(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from tessera.plans.standins import field

    n = field(spark, d).groupBy("patient_id", F.col("field_state").alias("assigned_archetype")).agg(F.count("*").alias("n"))
    metrics = n.withColumn("occupancy", F.col("n") / F.sum("n").over(Window.partitionBy("patient_id"))).drop("n")
    part = read(spark, d, "part").groupBy((F.col("p_size") % 4).cast("long").alias("assigned_archetype"), "p_brand").agg(F.avg("p_retailprice").alias("v"))
    loadings = part.groupBy("assigned_archetype").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "v"))).alias("loadings"))
    found = T.weighted_loadings(metrics, loadings)
    return found.select("patient_id", "assigned_archetype", "network", F.round("occupancy", 9).alias("occupancy"), F.round("loading_value", 6).alias("loading_value"), F.round("weighted_loading", 6).alias("weighted_loading"))


@register(
    "channel_canonical_coverage",
    """WITH c AS (SELECT c_custkey AS patient_id, ['fp1', ' T3', 'cz', 'O2', 'x9'][c_custkey % 5 + 1] AS raw, ['Fp1', 'T7', 'Cz', 'O2', 'X9'][c_custkey % 5 + 1] AS channel FROM customer)
SELECT raw AS raw_name, channel, count(*) AS n FROM c GROUP BY 1, 2""",
)
def channel_canonical_coverage(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("fp1", " T3", "cz", "O2", "x9"))), (F.col("c_custkey") % 5).cast("int"))
    rows = read(spark, d, "customer").select(raw.alias("raw_name"))
    return rows.groupBy("raw_name", R.canonical_channel(F.col("raw_name")).alias("channel")).agg(F.count("*").alias("n"))
