"""Queries over state-label sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import asof as A
from tessera.operators import kernels as K
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.plans.registry import register
from tessera.plans.standins import PAIRED, SQL, aligned, field, labels, paired_labels

KEY = ["patient_id"]


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


@register("runs_contiguous", SQL + "SELECT patient_id, run_id, microstate, start_sample, n_samples, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM run")
def runs_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return S.runs(labels(spark, d), KEY).select("patient_id", "run_id", "microstate", "start_sample", "n_samples", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@register(
    "state_occupancy_dwell",
    SQL
    + """SELECT patient_id, microstate, sum(n_samples)::bigint AS n_samples, count(*) AS n_runs, round(sum(n_samples) / sum(sum(n_samples)) OVER (PARTITION BY patient_id), 9) AS occupancy,
round(avg(n_samples) * any_value(period), 6) AS mean_dwell_sec FROM run JOIN step USING (patient_id) GROUP BY patient_id, microstate""",
)
def state_occupancy_dwell(spark: SparkSession, d: str) -> DataFrame:
    return S.state_profile(labels(spark, d), KEY).select("patient_id", "microstate", "n_samples", "n_runs", *r9("occupancy"), F.round("mean_dwell_sec", 6).alias("mean_dwell_sec"))


@register("transition_table", SQL + "SELECT *, round(from_end_sec - from_start_sec, 6) AS from_duration_sec, round(to_end_sec - to_start_sec, 6) AS to_duration_sec FROM tra")
def transition_table(spark: SparkSession, d: str) -> DataFrame:
    found = S.transitions(labels(spark, d), KEY)
    return found.withColumns({c: F.round(c, 6) for c in ("from_duration_sec", "to_duration_sec")})


@register(
    "transition_profile",
    SQL + "SELECT patient_id, from_state, to_state, count(*) AS n_transitions, round(count(*) / sum(count(*)) OVER (PARTITION BY patient_id, from_state), 9) AS transition_probability FROM tra GROUP BY 1, 2, 3",
)
def transition_profile(spark: SparkSession, d: str) -> DataFrame:
    return S.transition_profile(labels(spark, d), KEY).select("patient_id", "from_state", "to_state", "n_transitions", *r9("transition_probability"))


@register(
    "dense_transition_matrix",
    SQL
    + """, st AS (SELECT DISTINCT microstate AS s FROM lab), g AS (SELECT DISTINCT patient_id, a.s AS from_state, b.s AS to_state FROM lab, st a, st b),
n AS (SELECT patient_id, from_state, to_state, count(*) AS c FROM tra GROUP BY 1, 2, 3)
SELECT patient_id, from_state, to_state, coalesce(c, 0)::bigint AS n_transitions, round(coalesce(c, 0) / nullif(sum(c) OVER (PARTITION BY patient_id, from_state), 0), 9) AS transition_probability FROM g LEFT JOIN n USING (patient_id, from_state, to_state)""",
)
def dense_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_transition_matrix(labels(spark, d), KEY).select("patient_id", "from_state", "to_state", "n_transitions", *r9("transition_probability"))


@register(
    "event_onset_offset",
    SQL
    + """, w AS (SELECT *, lag(microstate) OVER o AS previous_state, lead(microstate) OVER o AS next_state FROM run WINDOW o AS (PARTITION BY patient_id ORDER BY run_id))
SELECT patient_id, run_id AS event_id, e AS event_type, CASE e WHEN 'onset' THEN start_sec ELSE end_sec END AS event_sec, microstate, previous_state, next_state, start_sec, end_sec, round(end_sec - start_sec, 6) AS duration_sec, n_samples
FROM w, (VALUES ('onset'), ('offset')) v(e)""",
)
def event_onset_offset(spark: SparkSession, d: str) -> DataFrame:
    return S.boundary_events(labels(spark, d), KEY).withColumn("duration_sec", F.round("duration_sec", 6))


@register("switch_indicator", SQL + "SELECT patient_id, sample, coalesce((microstate <> lag(microstate) OVER (PARTITION BY patient_id ORDER BY sample))::int::double, 0) AS switch_indicator FROM lab")
def switch_indicator(spark: SparkSession, d: str) -> DataFrame:
    return S.switch_indicator(labels(spark, d), KEY, state="microstate").select("patient_id", "sample", "switch_indicator")


@register("sample_period", SQL + "SELECT patient_id, round(period, 6) AS sample_period_sec FROM step")
def sample_period(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_period(labels(spark, d), KEY).select("patient_id", F.round("sample_period_sec", 6).alias("sample_period_sec"))


@register(
    "baseline_dense_states",
    SQL
    + """, p AS (SELECT patient_id, microstate, sum(n_samples) AS n, count(*) AS c FROM run GROUP BY 1, 2), t AS (SELECT patient_id, count(*) AS total FROM lab GROUP BY 1)
SELECT t.patient_id, s.i::bigint AS microstate, round(coalesce(n, 0) / total, 9) AS occupancy, round(n / c * period, 6) AS mean_dwell_sec, coalesce(n, 0)::bigint AS n_samples, coalesce(c, 0)::bigint AS n_runs
FROM t CROSS JOIN range(-1, 6) s(i) JOIN step USING (patient_id) LEFT JOIN p ON p.patient_id = t.patient_id AND p.microstate = s.i""",
)
def baseline_dense_states(spark: SparkSession, d: str) -> DataFrame:
    found = S.dense_states(labels(spark, d), KEY, list(range(-1, 6)))
    return found.select("patient_id", F.col("microstate").cast("long").alias("microstate"), *r9("occupancy"), F.round("mean_dwell_sec", 6).alias("mean_dwell_sec"), "n_samples", "n_runs")


_ASOF = """, nb AS (SELECT l.*, r.time_sec AS bt, r.field_state AS bs, r.gfp AS bg FROM lab l ASOF LEFT JOIN fld r ON l.patient_id = r.patient_id AND l.time_sec >= r.time_sec),
nf AS (SELECT l.patient_id, l.sample, r.time_sec AS ft, r.field_state AS fs, r.gfp AS fg FROM lab l ASOF LEFT JOIN fld r ON l.patient_id = r.patient_id AND l.time_sec <= r.time_sec),
near AS (SELECT *, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR time_sec - bt <= ft - time_sec) THEN 'b' ELSE 'f' END AS side FROM nb JOIN nf USING (patient_id, sample)),
aso AS (SELECT patient_id, sample, time_sec, microstate, corr, CASE side WHEN 'b' THEN bs ELSE fs END AS field_state, CASE side WHEN 'b' THEN bg ELSE fg END AS gfp FROM near WHERE abs(time_sec - CASE side WHEN 'b' THEN bt ELSE ft END) <= 300)
"""


def asof(spark: SparkSession, d: str) -> DataFrame:
    return A.asof_nearest(paired_labels(spark, d), field(spark, d).drop("sample"), KEY, tolerance=300.0)


@register("asof_nearest_tolerance", PAIRED + _ASOF + "SELECT patient_id, sample, time_sec, microstate, corr, field_state, gfp FROM aso")
def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return asof(spark, d)


@register(
    "asof_chained",
    PAIRED + _ASOF + "SELECT patient_id, sample, microstate, field_state, gfp, coalesce((field_state <> lag(field_state) OVER w)::int::double, 0) AS field_switch, coalesce((microstate <> lag(microstate) OVER w)::int::double, 0) AS label_switch FROM aso WINDOW w AS (PARTITION BY patient_id ORDER BY sample)",
)
def asof_chained(spark: SparkSession, d: str) -> DataFrame:
    trace = field(spark, d)
    first = A.asof_nearest(paired_labels(spark, d), trace.select("patient_id", "time_sec", "gfp"), KEY, tolerance=300.0)
    both = A.asof_nearest(first, trace.select("patient_id", "time_sec", "field_state"), KEY, tolerance=300.0).dropna(subset=["gfp", "field_state"])
    both = S.switch_indicator(both, KEY, state="field_state", name="field_switch")
    return S.switch_indicator(both, KEY, state="microstate", name="label_switch").select("patient_id", "sample", "microstate", "field_state", "gfp", "field_switch", "label_switch")


@register(
    "asof_left_wide_dropna",
    PAIRED + _ASOF + "SELECT patient_id, sample, c AS region, CASE c WHEN 'corr' THEN corr ELSE gfp END AS value FROM aso, (VALUES ('corr'), ('gfp')) v(c) WHERE field_state > 0",
)
def asof_left_wide_dropna(spark: SparkSession, d: str) -> DataFrame:
    wide = field(spark, d).select("patient_id", "time_sec", "gfp", F.when(F.col("field_state") > 0, F.col("field_state")).alias("field_state"))
    joined = A.asof_nearest(paired_labels(spark, d), wide, KEY, tolerance=300.0).dropna(how="any")
    return joined.unpivot(["patient_id", "sample"], ["corr", "gfp"], "region", "value")


@register(
    "window_response_rate",
    PAIRED
    + """, ftr AS (SELECT patient_id, time_sec AS event_sec FROM (SELECT *, lag(field_state) OVER (PARTITION BY patient_id ORDER BY sample) AS p FROM fld) WHERE field_state <> p)
SELECT patient_id, from_state, to_state, count(*) AS n_events, round(avg(hit), 9) AS rate FROM (
  SELECT t.*, EXISTS (SELECT 1 FROM ftr r WHERE r.patient_id = t.patient_id AND r.event_sec >= t.event_sec AND r.event_sec < t.event_sec + 250)::int AS hit FROM tra t) GROUP BY 1, 2, 3""",
)
def window_response_rate(spark: SparkSession, d: str) -> DataFrame:
    responses = S.transitions(field(spark, d), KEY, state="field_state").select("patient_id", "event_sec")
    events = S.transitions(paired_labels(spark, d), KEY).select("patient_id", "event_sec", "from_state", "to_state")
    hit = A.next_event_within(events, responses, KEY, window=250.0)
    return hit.groupBy("patient_id", "from_state", "to_state").agg(F.count("*").alias("n_events"), F.round(F.avg(F.col("responded").cast("int")), 9).alias("rate"))


@register(
    "destination_response_rate",
    PAIRED
    + """, ftr AS (SELECT patient_id, time_sec AS event_sec, field_state AS dest FROM (SELECT *, lag(field_state) OVER (PARTITION BY patient_id ORDER BY sample) AS p FROM fld) WHERE field_state <> p),
dst AS (SELECT DISTINCT patient_id, dest FROM ftr)
SELECT patient_id, from_state, to_state, dest AS response_state, count(*) AS n_events, round(avg(hit), 9) AS rate FROM (
  SELECT t.*, d.dest, EXISTS (SELECT 1 FROM ftr r WHERE r.patient_id = t.patient_id AND r.dest = d.dest AND r.event_sec >= t.event_sec AND r.event_sec < t.event_sec + 900)::int AS hit FROM tra t JOIN dst d USING (patient_id)) GROUP BY 1, 2, 3, 4""",
)
def destination_response_rate(spark: SparkSession, d: str) -> DataFrame:
    responses = S.transitions(field(spark, d), KEY, state="field_state").select("patient_id", "event_sec", F.col("to_state").alias("response_state"))
    events = S.transitions(paired_labels(spark, d), KEY).select("patient_id", "event_sec", "from_state", "to_state")
    asked = events.join(responses.select("patient_id", "response_state").distinct(), "patient_id")
    hit = A.next_event_within(asked, responses, ["patient_id", "response_state"], window=900.0)
    return hit.groupBy("patient_id", "from_state", "to_state", "response_state").agg(F.count("*").alias("n_events"), F.round(F.avg(F.col("responded").cast("int")), 9).alias("rate"))


@register(
    "pre_post_event_effect",
    PAIRED
    + """, e AS (SELECT t.patient_id, transition_id, to_state, avg(gfp) FILTER (f.time_sec < event_sec) AS pre, avg(gfp) FILTER (f.time_sec >= event_sec) AS post
  FROM tra t JOIN fld f ON f.patient_id = t.patient_id AND f.time_sec >= event_sec - 900 AND f.time_sec < event_sec + 900 GROUP BY 1, 2, 3)
SELECT patient_id, to_state, count(*) AS n_events, round(avg(post - pre), 6) AS effect_mean_diff FROM e WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY 1, 2""",
)
def pre_post_event_effect(spark: SparkSession, d: str) -> DataFrame:
    events = S.transitions(paired_labels(spark, d), KEY).select("patient_id", "transition_id", "to_state", "event_sec", (F.col("event_sec") - 900).alias("lo"), (F.col("event_sec") + 900).alias("hi"))
    held = A.interval_join(field(spark, d), events, KEY, width=1800.0, start="lo", end="hi")
    side = F.col("time_sec") < F.col("event_sec")
    each = held.groupBy("patient_id", "transition_id", "to_state").agg(F.avg(F.when(side, F.col("gfp"))).alias("pre"), F.avg(F.when(~side, F.col("gfp"))).alias("post"))
    return each.dropna().groupBy("patient_id", "to_state").agg(F.count("*").alias("n_events"), F.round(F.avg(F.col("post") - F.col("pre")), 6).alias("effect_mean_diff"))


@register(
    "windowed_state_metrics",
    SQL
    + """, b AS (SELECT patient_id, min(time_sec) AS t0, max(time_sec) AS t1, any_value(period) AS period FROM lab JOIN step USING (patient_id) GROUP BY 1),
w AS (SELECT patient_id, i AS win, t0 + i * 43200.0::double AS ws, period FROM b, range(0, 100000) r(i) WHERE i <= floor((t1 + period - 86400.0::double - t0) / 43200.0::double + 1e-9)),
m AS (SELECT w.patient_id, win, ws, period, sample, microstate FROM w JOIN lab l ON l.patient_id = w.patient_id AND time_sec >= ws AND time_sec < ws + 86400),
i AS (SELECT *, sample - row_number() OVER (PARTITION BY patient_id, win, microstate ORDER BY sample) AS g FROM m),
q AS (SELECT patient_id, win, microstate, count(*) AS n, count(DISTINCT g) AS c FROM i GROUP BY 1, 2, 3),
z AS (SELECT patient_id, win, any_value(ws) AS ws, any_value(period) AS period, count(*) AS n_samples FROM m GROUP BY 1, 2)
SELECT patient_id, win AS "window", round(ws, 6) AS window_start_sec, round(ws + 86400, 6) AS window_end_sec, s.microstate, round(coalesce(n, 0) / n_samples, 9) AS occupancy, round(coalesce(n / c * period, 0), 6) AS mean_dwell_sec, n_samples
FROM z JOIN (SELECT DISTINCT patient_id, microstate FROM lab) s USING (patient_id) LEFT JOIN q USING (patient_id, win, microstate)""",
)
def windowed_state_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = S.windowed_states(labels(spark, d), KEY, width=86400.0, step=43200.0)
    return found.select("patient_id", "window", *(F.round(c, 6).alias(c) for c in ("window_start_sec", "window_end_sec")), "microstate", *r9("occupancy"), F.round("mean_dwell_sec", 6).alias("mean_dwell_sec"), "n_samples")


@register(
    "windowed_region_metrics",
    SQL
    + """, s AS (SELECT patient_id, 'r' || (microstate % 2) AS region, sample, time_sec, corr FROM lab),
p AS (SELECT patient_id, region, coalesce(median(d), 0) AS period FROM (SELECT *, time_sec - lag(time_sec) OVER (PARTITION BY patient_id, region ORDER BY sample) AS d FROM s) GROUP BY 1, 2),
b AS (SELECT patient_id, region, min(time_sec) AS t0, max(time_sec) AS t1, any_value(period) AS period FROM s JOIN p USING (patient_id, region) GROUP BY 1, 2),
w AS (SELECT patient_id, region, i AS win, t0 + i * 86400.0::double AS ws FROM b, range(0, 100000) r(i) WHERE i <= floor((t1 + period - 86400.0::double - t0) / 86400.0::double + 1e-9))
SELECT w.patient_id, w.region, win AS "window", round(any_value(ws), 6) AS window_start_sec, round(avg(corr), 9) AS mean_value, round(stddev_pop(corr), 6) AS std_value, count(*) AS n_samples
FROM w JOIN s ON s.patient_id = w.patient_id AND s.region = w.region AND time_sec >= ws AND time_sec < ws + 86400 GROUP BY 1, 2, 3""",
)
def windowed_region_metrics(spark: SparkSession, d: str) -> DataFrame:
    signals = labels(spark, d).select("patient_id", F.concat(F.lit("r"), F.col("microstate") % 2).alias("region"), "sample", "time_sec", F.col("corr").alias("value"))
    found = S.windowed_values(signals, KEY, width=86400.0)
    return found.select("patient_id", "region", "window", F.round("window_start_sec", 6).alias("window_start_sec"), *r9("mean_value"), F.round("std_value", 6).alias("std_value"), "n_samples")


@register(
    "windowed_slope_corr",
    SQL
    + """, m AS (SELECT patient_id, floor(time_sec / 86400)::bigint AS win, field_state, microstate, gfp FROM ali),
s AS (SELECT patient_id, win, microstate, count(*) / sum(count(*)) OVER (PARTITION BY patient_id, win) AS occ FROM m GROUP BY 1, 2, 3),
r AS (SELECT patient_id, win, field_state, avg(gfp) AS v FROM m GROUP BY 1, 2, 3)
SELECT patient_id, microstate, field_state, count(*) AS n_windows, round(regr_slope(v, occ), 6) AS slope, round(covar_pop(v, occ) / (stddev_pop(v) * stddev_pop(occ)), 6) AS effect_mean_diff
FROM s JOIN r USING (patient_id, win) GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND stddev_pop(v) > 1e-12 AND stddev_pop(occ) > 1e-12""",
)
def windowed_slope_corr(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = aligned(spark, d).withColumn("win", F.floor(F.col("time_sec") / 86400))
    occupancy = m.groupBy("patient_id", "win", "microstate").agg(F.count("*").alias("n")).withColumn("occ", F.col("n") / F.sum("n").over(Window.partitionBy("patient_id", "win")))
    values = m.groupBy("patient_id", "win", "field_state").agg(F.avg("gfp").alias("v"))
    both = occupancy.join(values, ["patient_id", "win"]).groupBy("patient_id", "microstate", "field_state")
    found = both.agg(F.count("*").alias("n_windows"), F.covar_pop("v", "occ").alias("c"), F.stddev_pop("v").alias("sv"), F.stddev_pop("occ").alias("so"))
    found = found.where("n_windows >= 2 AND sv > 1e-12 AND so > 1e-12")
    return found.select("patient_id", "microstate", "field_state", "n_windows", F.round(F.col("c") / (F.col("so") * F.col("so")), 6).alias("slope"), F.round(F.col("c") / (F.col("sv") * F.col("so")), 6).alias("effect_mean_diff"))


_NMI = """SELECT {keys}, sum(c)::bigint AS n_samples, round(CASE WHEN sum(-c / n * ln(x / n)) / 1 IS NULL THEN 0 ELSE sum(c / n * ln(c * n / (x * y))) / sqrt(sum(-c / n * ln(x / n)) * sum(-c / n * ln(y / n))) END, 9) AS nmi
FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS n, sum(c) OVER (PARTITION BY {keys}, a) AS x, sum(c) OVER (PARTITION BY {keys}, b) AS y FROM ({src})) GROUP BY {keys}"""


@register("nmi_zero_lag", SQL + _NMI.format(keys="patient_id", src="SELECT patient_id, microstate AS a, field_state AS b, count(*)::double AS c FROM ali GROUP BY ALL"))
def nmi_zero_lag(spark: SparkSession, d: str) -> DataFrame:
    return C.mutual_information(aligned(spark, d), KEY, "microstate", "field_state").select("patient_id", "n_samples", *r9("nmi"))


LAGS, SHIFTS = list(range(-10, 11)), 128


@register("nmi_lag_grid_arith_surrogates")
def nmi_lag_grid_arith_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """21 lags against 128 shifts over the whole sequence; SQL is too slow for that."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample")
        return K.shifted_lag_grid(part["microstate"].to_numpy(), part["field_state"].to_numpy(), LAGS, K.arithmetic_shifts(len(part), SHIFTS))

    pairs = aligned(spark, d).select("patient_id", "sample", "microstate", "field_state")
    found = K.grouped(pairs, KEY, "lag_samples long, observed_coupling double, null_mean_coupling double, effect_mean_diff double, p_perm double", kernel)
    return found.select("patient_id", "lag_samples", "observed_coupling", *(F.round(c, 8).alias(c) for c in ("null_mean_coupling", "effect_mean_diff")), F.round("p_perm", 9).alias("p_perm"))


@register(
    "pearson_lag_guarded",
    SQL
    + """SELECT a.patient_id, g.l::bigint AS lag_samples, count(*) AS n_samples, round(CASE WHEN count(*) >= 3 AND stddev_pop(a.corr) * stddev_pop(b.gfp) > 0 THEN covar_pop(a.corr, b.gfp) / (stddev_pop(a.corr) * stddev_pop(b.gfp)) ELSE 0 END, 9) AS r
FROM ali a CROSS JOIN (SELECT unnest([-3, 0, 3]) AS l) g JOIN ali b ON b.patient_id = a.patient_id AND b.sample = a.sample + g.l GROUP BY 1, 2""",
)
def pearson_lag_guarded(spark: SparkSession, d: str) -> DataFrame:
    pairs = aligned(spark, d)
    lagged = S.lag_pairs(pairs.select("patient_id", "sample", "corr"), pairs.select("patient_id", "sample", "gfp"), KEY, [-3, 0, 3])
    return lagged.groupBy("patient_id", F.col("lag_samples").cast("long").alias("lag_samples")).agg(F.count("*").alias("n_samples"), F.round(C.pearson("corr", "gfp"), 9).alias("r"))


_PEAKS = ", pk AS (SELECT patient_id, sample FROM (SELECT *, lag(gfp) OVER w AS p, lead(gfp) OVER w AS q FROM ali WINDOW w AS (PARTITION BY patient_id ORDER BY sample)) WHERE gfp > p AND gfp > q)"


@register("local_maxima", SQL + _PEAKS.replace("FROM ali", "FROM lab").replace("gfp", "corr") + " SELECT * FROM pk")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the values of all events."""
    return S.local_maxima(labels(spark, d), KEY, value="corr").select("patient_id", "sample")


@register(
    "peak_centered_trajectory",
    SQL + _PEAKS + " SELECT pk.patient_id, (a.sample - pk.sample)::bigint AS offset_samples, count(*) AS n_events, round(avg(corr), 9) AS mean_value FROM pk JOIN ali a ON a.patient_id = pk.patient_id AND a.sample BETWEEN pk.sample - 5 AND pk.sample + 5 GROUP BY 1, 2",
)
def peak_centered_trajectory(spark: SparkSession, d: str) -> DataFrame:
    trace = aligned(spark, d)
    peaks = S.local_maxima(trace, KEY, value="gfp").select("patient_id", "sample")
    held = S.around_events(peaks, trace.select("patient_id", "sample", "corr"), KEY, before=5, after=5)
    return held.groupBy("patient_id", F.col("offset_samples").cast("long").alias("offset_samples")).agg(F.count("*").alias("n_events"), F.round(F.avg("corr"), 9).alias("mean_value"))


@register(
    "fine_lag_peak_profile",
    SQL
    + """, v AS (SELECT a.patient_id, g.l::bigint AS lag, round(covar_pop(a.corr, b.gfp) / (stddev_pop(a.corr) * stddev_pop(b.gfp)), 9) AS e
FROM ali a CROSS JOIN (SELECT unnest(range(-10, 11)) AS l) g JOIN ali b ON b.patient_id = a.patient_id AND b.sample = a.sample + g.l GROUP BY 1, 2),
p AS (SELECT patient_id, arg_max(lag, (e, -lag)) AS peak, max(e) AS pe, count(*) AS n_lags FROM v GROUP BY 1),
f AS (SELECT v.*, peak, pe, n_lags, e >= CASE WHEN pe > 0 THEN pe * 0.5::double ELSE pe END AS ok FROM v JOIN p USING (patient_id))
SELECT patient_id, any_value(peak) AS peak_lag_samples, any_value(pe) AS peak_effect,
 (coalesce(min(lag) FILTER (lag > peak AND NOT ok), max(lag) + 1) - 1 - (coalesce(max(lag) FILTER (lag < peak AND NOT ok), min(lag) - 1) + 1))::bigint AS peak_width_samples, any_value(n_lags) AS n_lags FROM f GROUP BY 1""",
)
def fine_lag_peak_profile(spark: SparkSession, d: str) -> DataFrame:
    pairs = aligned(spark, d)
    lagged = S.lag_pairs(pairs.select("patient_id", "sample", "corr"), pairs.select("patient_id", "sample", "gfp"), KEY, list(range(-10, 11)))
    value = lagged.groupBy("patient_id", F.col("lag_samples").cast("long").alias("lag")).agg(F.round(C.pearson("corr", "gfp"), 9).alias("e"))
    return C.lag_peak(value, KEY, lag="lag", effect="e")


@register(
    "ancova_adjusted_means",
    SQL
    + """, d AS (SELECT *, coalesce((field_state <> lag(field_state) OVER (PARTITION BY patient_id ORDER BY sample))::int::double, 0) AS y FROM ali),
g AS (SELECT patient_id, microstate, count(*) AS n, avg(y) AS my, avg(gfp) AS mx, count(*) * covar_pop(gfp, y) AS xy, count(*) * var_pop(gfp) AS xx FROM d GROUP BY 1, 2),
b AS (SELECT patient_id, sum(xy) / sum(xx) AS beta, sum(mx * n) / sum(n) AS c FROM g GROUP BY 1)
SELECT patient_id, microstate, round(my - beta * (mx - c), 9) AS adjusted_mean, round(my, 9) AS raw_mean, n AS n_samples, round(mx, 9) AS mean_x, round(beta, 9) AS beta FROM g JOIN b USING (patient_id)""",
)
def ancova_adjusted_means(spark: SparkSession, d: str) -> DataFrame:
    data = S.switch_indicator(aligned(spark, d), KEY, state="field_state", name="y")
    return C.adjusted_means(data, KEY, group="microstate", y="y", x="gfp").select("patient_id", "microstate", *r9("adjusted_mean", "raw_mean"), "n_samples", *r9("mean_x", "beta"))


@register(
    "ancova_transition_effect",
    SQL
    + """, e AS (SELECT patient_id, to_state, sample AS ev FROM (SELECT *, microstate AS to_state, lag(microstate) OVER (PARTITION BY patient_id ORDER BY sample) AS p FROM ali) WHERE microstate <> p),
h AS (SELECT e.patient_id, e.to_state, (a.sample >= ev)::int AS post, a.corr AS y, a.gfp AS x FROM e JOIN ali a ON a.patient_id = e.patient_id AND a.sample BETWEEN ev - 4 AND ev + 3),
g AS (SELECT patient_id, to_state, post, count(*) AS n, avg(y) AS my, avg(x) AS mx, count(*) * covar_pop(x, y) AS xy, count(*) * var_pop(x) AS xx FROM h GROUP BY 1, 2, 3),
b AS (SELECT patient_id, to_state, sum(xy) / sum(xx) AS beta FROM g GROUP BY 1, 2)
SELECT p.patient_id, p.to_state, (p.n + q.n)::bigint AS n_samples, round(p.my, 9) AS pre_value, round(q.my, 9) AS post_value, round((q.my - beta * q.mx) - (p.my - beta * p.mx), 8) AS effect_mean_diff, round(beta, 9) AS gfp_beta
FROM g p JOIN g q ON p.patient_id = q.patient_id AND p.to_state = q.to_state AND p.post = 0 AND q.post = 1 JOIN b ON b.patient_id = p.patient_id AND b.to_state = p.to_state""",
)
def ancova_transition_effect(spark: SparkSession, d: str) -> DataFrame:
    trace = aligned(spark, d)
    events = S.switch_indicator(trace, KEY, state="microstate").where("switch_indicator = 1").select("patient_id", "sample", F.col("microstate").alias("to_state"))
    held = S.around_events(events, trace.select("patient_id", "sample", "corr", "gfp"), KEY, before=4, after=3)
    data = held.select("patient_id", "to_state", (F.col("offset_samples") >= 0).cast("int").alias("post"), "corr", "gfp")
    means = C.adjusted_means(data, ["patient_id", "to_state"], group="post", y="corr", x="gfp")
    side = lambda c, v: F.max(F.when(F.col("post") == v, F.col(c)))
    return means.groupBy("patient_id", "to_state").agg(
        F.sum("n_samples").alias("n_samples"),
        F.round(side("raw_mean", 0), 9).alias("pre_value"),
        F.round(side("raw_mean", 1), 9).alias("post_value"),
        F.round(side("adjusted_mean", 1) - side("adjusted_mean", 0), 8).alias("effect_mean_diff"),
        F.round(F.max("beta"), 9).alias("gfp_beta"),
    )
