"""Report tables, layouts, group statistics and topographies on stand-in tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import parameters as P
from tessera.operators import coupling as U
from tessera.operators import kernels as K
from tessera.operators import reports as O
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.operators import topography as T
from tessera.operators import vectors as V
from tessera.operators.asof import asof_nearest
from tessera.plans.registry import register
from tessera.plans.standins import SQL, aligned, effects, field, numbered_labels, paired_labels, read, vectors

KEY = ["patient_id"]
#: Seconds within which a label takes a patient's nearest vector.
DAY = 86_400.0


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@register(
    "projection_confidence_summary",
    "SELECT l_linestatus, l_returnflag, count(DISTINCT l_suppkey) AS n_patients, round(avg(l_discount), 6) AS mean_confidence, round(stddev_samp(l_discount), 6) AS sd_confidence, round(median(l_discount::double), 6) AS median_confidence, round(quantile_cont(l_discount::double, 0.25), 6) AS q1_confidence, round(quantile_cont(l_discount::double, 0.75), 6) AS q3_confidence, min(l_discount::double) AS min_confidence, max(l_discount::double) AS max_confidence FROM lineitem GROUP BY 1, 2",
)
def projection_confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("value", F.col("l_discount").cast("double"))
    found = O.numbers(rows, ["l_linestatus", "l_returnflag"], value="value", name="confidence", subject="l_suppkey")
    return _round(found, 6, *(f"{k}_confidence" for k in ("mean", "sd", "median", "q1", "q3")))


@register(
    "network_loading_support",
    "SELECT p_brand, p_size % 4 AS archetype, count(p_retailprice) FILTER (p_size <> 8) AS n_support, round(avg(p_retailprice) FILTER (p_size <> 8), 6) AS mean_loading, round(stddev_samp(p_retailprice) FILTER (p_size <> 8), 6) AS sd_loading, round(median(p_retailprice::double) FILTER (p_size <> 8), 6) AS median_loading FROM part GROUP BY 1, 2",
)
def network_loading_support(spark: SparkSession, d: str) -> DataFrame:
    """A size of 8 stands for a loading that isn't finite."""
    price = F.col("p_retailprice").cast("double")
    rows = read(spark, d, "part").select("p_brand", (F.col("p_size") % 4).alias("archetype"), F.when(F.col("p_size") == 8, F.lit(float("nan"))).otherwise(price).alias("loading"))
    return _round(O.loading_support(rows, ["p_brand", "archetype"]), 6, "mean_loading", "sd_loading", "median_loading")


@register(
    "stage_loading_summary",
    "SELECT l_linestatus, l_linenumber, count(DISTINCT l_suppkey) AS n_patients, count(DISTINCT l_orderkey) AS n_segments, round(avg(l_extendedprice), 4) AS mean_loading, round(avg(l_extendedprice * l_discount), 4) AS mean_weighted_loading FROM lineitem GROUP BY 1, 2",
)
def stage_loading_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumns({"loading_value": F.col("l_extendedprice").cast("double"), "weighted_loading": (F.col("l_extendedprice") * F.col("l_discount")).cast("double")})
    return _round(O.stage_loadings(rows, ["l_linestatus", "l_linenumber"], patient="l_suppkey", segment="l_orderkey"), 4, "mean_loading", "mean_weighted_loading")


@register(
    "model_order_group",
    "SELECT l_returnflag, l_linenumber AS n_states, count(DISTINCT l_suppkey) AS n_subjects, round(avg(l_quantity), 6) AS mean_l_quantity, median(l_quantity::double) AS median_l_quantity, round(avg(l_tax), 6) AS mean_l_tax, median(l_tax::double) AS median_l_tax, l_linenumber = 4 AS retained_main_text_default FROM lineitem GROUP BY l_returnflag, l_linenumber",
)
def model_order_group(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("n_states"), F.col("l_suppkey").alias("patient_id"), *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax")))
    return _round(O.model_order_groups(rows, ["l_returnflag"], retained=4, values=["l_quantity", "l_tax"]), 6, "mean_l_quantity", "mean_l_tax")


@register(
    "model_order_long",
    "SELECT c_custkey, 'Template fit' AS metric_label, c_acctbal::double AS value FROM customer UNION ALL SELECT c_custkey, 'Gain', CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey::double END FROM customer WHERE c_nationkey <> 3",
)
def model_order_long(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("fit"), F.nullif(F.col("c_nationkey"), F.lit(3)).cast("double").alias("gain"))
    return O.long_measures(rows, ["c_custkey"], {"fit": "Template fit", "gain": "Gain"}, skip_null=("gain",))


@register(
    "delta_family_union",
    "SELECT 'customer' AS family, c_nationkey AS nation, round(avg(c_acctbal), 6) AS mean_delta, NULL::bigint AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, round(avg(s_acctbal), 6), count(*) FROM supplier GROUP BY 2",
)
def delta_family_union(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias("mean_delta")
    own = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(mean("c_acctbal"))
    other = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(mean("s_acctbal"), F.count("*").alias("n"))
    return O.tagged_union({"customer": own, "supplier": other}).select("family", "nation", "mean_delta", "n")


@register(
    "archetype_support_join",
    "SELECT n.n_nationkey, n.n_name, s.n_name AS n_name_support, s.n FROM nation n LEFT JOIN (SELECT s_nationkey AS n_nationkey, min(s_name) AS n_name, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s USING (n_nationkey)",
)
def archetype_support_join(spark: SparkSession, d: str) -> DataFrame:
    support = read(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("n_name"), F.count("*").alias("n"))
    return O.with_support(read(spark, d, "nation").select("n_nationkey", "n_name"), support, ["n_nationkey"])


@register(
    "group_probability_join",
    SQL + "SELECT g.grp, g.microstate, g.n_subjects, p.mean_value FROM (SELECT grp, microstate, count(*) AS n_subjects FROM eff GROUP BY 1, 2) g LEFT JOIN (SELECT grp, microstate, round(avg(value), 9) AS mean_value FROM eff GROUP BY 1, 2) p USING (grp, microstate)",
)
def group_probability_join(spark: SparkSession, d: str) -> DataFrame:
    rows = effects(spark, d)
    groups = rows.groupBy("grp", "microstate").agg(F.count("*").alias("n_subjects"))
    return _round(O.with_means(groups, rows, ["grp", "microstate"], {"value": "mean_value"}), 9, "mean_value")


@register(
    "transition_display_rows",
    "SELECT from_state, to_state, kind AS response_kind, id FROM (SELECT l_linenumber AS from_state, l_quantity::int % 5 AS to_state, CASE WHEN l_returnflag = 'R' THEN 'Any-Switch ' ELSE 'destination' END AS kind, l_orderkey AS id FROM lineitem) WHERE kind = 'Any-Switch '",
)
def transition_display_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "Any-Switch ").otherwise("destination")
    rows = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("from_state"), (F.col("l_quantity").cast("int") % 5).alias("to_state"), kind.alias("response_kind"), F.col("l_orderkey").alias("id"))
    return O.display_transitions(rows, order=[F.asc("id")])


@register(
    "transition_display_first",
    "SELECT from_state, to_state, min(id) AS id FROM (SELECT l_linenumber AS from_state, l_quantity::int % 5 AS to_state, l_orderkey * 10 + l_linenumber AS id FROM lineitem) GROUP BY 1, 2",
)
def transition_display_first(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("from_state"), (F.col("l_quantity").cast("int") % 5).alias("to_state"), F.lit("destination").alias("response_kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return O.display_transitions(rows, order=[F.asc("id")]).drop("response_kind")


@register("surviving_assignments", "SELECT s_suppkey, s_nationkey AS assigned_archetype FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4500)")
def surviving_assignments(spark: SparkSession, d: str) -> DataFrame:
    archetypes = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("field_state")).agg(F.avg("c_acctbal").alias("m")).where("m > 4500")
    return O.surviving(read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("assigned_archetype")), archetypes)


_ORDER = ("EUROPE", "ASIA", "AMERICA")
_LAYOUT = "lay AS (SELECT n_regionkey AS patient_id, s_name AS bipolar_channel, coalesce(r, 'Unmapped') AS region, r IS NOT NULL AND s_acctbal > 0 AS valid_same_region FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT r_regionkey, r_name AS r FROM region WHERE r_regionkey <> 0) ON r_regionkey = s_suppkey % 5)"
_RANK = "CASE region WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'Unmapped' THEN 4 ELSE 3 END"


def _layout(spark: SparkSession, d: str) -> DataFrame:
    suppliers = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    named = suppliers.select(F.col("n_regionkey").alias("patient_id"), F.col("s_name").alias("bipolar_channel"), (F.col("s_suppkey") % 5).alias("k"), "s_acctbal")
    regions = read(spark, d, "region").where("r_regionkey <> 0").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))
    mapping = named.join(F.broadcast(regions), "k").select("patient_id", "bipolar_channel", "region", (F.col("s_acctbal") > 0).alias("valid_same_region"))
    return O.channel_layout(named.select("patient_id", "bipolar_channel"), mapping, KEY, order=_ORDER)


@register("channel_layout_fill", f"WITH {_LAYOUT} SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_RANK}, region, bipolar_channel) - 1 AS channel_order FROM lay")
def channel_layout_fill(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d)


@register(
    "export_layout_fallback",
    f"WITH {_LAYOUT}, m AS (SELECT *, count(*) FILTER (valid_same_region) OVER (PARTITION BY patient_id) >= 2 AS mapped_only FROM lay) SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_RANK}, region, bipolar_channel) - 1 AS channel_order FROM m WHERE NOT mapped_only OR valid_same_region",
)
def export_layout_fallback(spark: SparkSession, d: str) -> DataFrame:
    return O.exported_layout(_layout(spark, d), KEY)


@register("region_channel_support", f"WITH {_LAYOUT} SELECT region, count(DISTINCT bipolar_channel) AS n_bipolar_channels, count(*) FILTER (valid_same_region) AS n_valid_same_region FROM lay GROUP BY 1")
def region_channel_support(spark: SparkSession, d: str) -> DataFrame:
    return O.region_support(_layout(spark, d), ["region"])


_COVER = _LAYOUT + ", v AS (SELECT patient_id, CASE region WHEN 'Unmapped' THEN NULL ELSE region END AS region, bipolar_channel FROM lay WHERE valid_same_region OR region = 'Unmapped'), c AS (SELECT patient_id, region AS network, count(DISTINCT bipolar_channel) AS n FROM v WHERE region IS NOT NULL GROUP BY 1, 2), r AS (SELECT patient_id, count(*) AS retained_bipolar_channels FROM lay GROUP BY 1), w AS (SELECT unnest(['EUROPE', 'ASIA', 'AMERICA', 'ATLANTIS']) AS network UNION SELECT network FROM c), g AS (SELECT r.patient_id, network, retained_bipolar_channels, coalesce(n, 0)::bigint AS n_bipolar_channels FROM r CROSS JOIN w LEFT JOIN c USING (patient_id, network))"


def _coverage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    layout = _layout(spark, d)
    mapping = layout.withColumn("valid_same_region", F.col("valid_same_region") | (F.col("region") == O.UNMAPPED)).withColumn("region", F.nullif(F.col("region"), F.lit(O.UNMAPPED)))
    return O.coverage_tables(mapping, layout.groupBy("patient_id").agg(F.count("*").alias("retained_bipolar_channels")), (*_ORDER, "ATLANTIS"))


@register("network_coverage_grid", f"WITH {_COVER} SELECT patient_id, network, n_bipolar_channels, round(n_bipolar_channels * 100.0::double / retained_bipolar_channels, 9) AS coverage_pct FROM g")
def network_coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(_coverage(spark, d)[0], 9, "coverage_pct")


@register(
    "network_coverage_summary",
    f"WITH {_COVER} SELECT patient_id, retained_bipolar_channels, (SELECT coalesce(sum(n), 0) FROM c WHERE c.patient_id = r.patient_id)::bigint AS mapped_bipolar_channels, (SELECT count(*) FROM c WHERE c.patient_id = r.patient_id) AS covered_networks, (SELECT count(*) FROM v WHERE v.patient_id = r.patient_id AND region IS NULL) AS background_channels FROM r",
)
def network_coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)[1]


@register(
    "network_coverage_totals",
    f"WITH {_COVER} SELECT network, count(*) FILTER (n_bipolar_channels > 0) AS n_patients_with_coverage, sum(n_bipolar_channels)::bigint AS total_bipolar_channels, round(avg(n_bipolar_channels), 6) AS mean_patient_channels, median(n_bipolar_channels) AS median_patient_channels, max(n_bipolar_channels) AS max_patient_channels FROM g GROUP BY 1",
)
def network_coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    return _round(O.network_totals(_coverage(spark, d)[0]), 6, "mean_patient_channels")


_TOUCH = "t AS (SELECT c_nationkey AS patient_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS network, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'L' END AS hemi FROM customer)"
_SEGMENTS = ("BUILDING", "MACHINERY", "NOWHERE")


def _touch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("patient_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("network"), F.when(F.col("c_custkey") % 5 != 0, "L").alias("hemi"))
    return O.touchpoints(rows, _SEGMENTS)


@register("touchpoint_networks", f"WITH {_TOUCH} SELECT network, coalesce(n_contacts, 0) AS n_contacts, coalesce(n_patients, 0) AS n_patients FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS network) LEFT JOIN (SELECT network, count(*) AS n_contacts, count(DISTINCT patient_id) AS n_patients FROM t WHERE hemi IS NOT NULL GROUP BY 1) USING (network)")
def touchpoint_networks(spark: SparkSession, d: str) -> DataFrame:
    return _touch(spark, d)[0]


@register("touchpoint_patients", f"WITH {_TOUCH} SELECT patient_id, count(*) AS total_contacts, count(*) FILTER (hemi IS NOT NULL AND network IN ('BUILDING', 'MACHINERY', 'NOWHERE')) AS mapped_contacts, round(count(*) FILTER (hemi IS NOT NULL AND network IN ('BUILDING', 'MACHINERY', 'NOWHERE')) / count(*), 9) AS mapped_fraction, count(DISTINCT network) AS n_networks FROM t GROUP BY 1")
def touchpoint_patients(spark: SparkSession, d: str) -> DataFrame:
    return _round(_touch(spark, d)[1], 9, "mapped_fraction")


@register(
    "representative_subjects",
    "WITH m AS (SELECT o_custkey AS patient_id, o_orderpriority AS a, count(*) AS n_samples, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2), p AS (SELECT patient_id, count(*) AS n_archetypes_present, sum(n_samples)::bigint AS total_conditioned_samples, min(n_samples) AS min_conditioned_samples, avg(s) AS sim FROM m GROUP BY 1), r AS (SELECT *, n_archetypes_present = (SELECT count(DISTINCT a) FROM m) AS complete_archetype_panel FROM p), k AS (SELECT *, row_number() OVER (ORDER BY complete_archetype_panel DESC, min_conditioned_samples DESC, sim DESC, total_conditioned_samples DESC, patient_id) AS representative_rank FROM r) SELECT patient_id, n_archetypes_present, total_conditioned_samples, min_conditioned_samples, round(sim, 4) AS mean_assignment_similarity, complete_archetype_panel, representative_rank FROM k WHERE representative_rank <= 8 AND (complete_archetype_panel OR NOT (SELECT bool_or(complete_archetype_panel) FROM k))",
)
def representative_subjects(spark: SparkSession, d: str) -> DataFrame:
    """A top-8 report."""
    maps = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("assigned_archetype")).agg(F.count("*").alias("n_samples"), F.avg(F.col("o_totalprice").cast("double")).alias("assignment_similarity"))
    return _round(O.representatives(maps, 8), 4, "mean_assignment_similarity")


@register(
    "kernel_density_grid",
    "WITH c AS (SELECT round_even((c_acctbal::double - -1000) / (11000 / 119.0::double), 0)::int AS p, round_even((c_nationkey::double * 440 - -1000) / (11000 / 119.0::double), 0)::int AS q, count(*) AS n FROM customer GROUP BY 1, 2 HAVING p BETWEEN 0 AND 119 AND q BETWEEN 0 AND 119), r AS (SELECT i, q, sum(n * exp(-0.5::double * power((i - p) * (11000 / 119.0::double) / 600, 2))) AS n FROM c, range(0, 120) g(i) GROUP BY 1, 2), f AS (SELECT i, j, sum(n * exp(-0.5::double * power((j - q) * (11000 / 119.0::double) / 600, 2))) AS v FROM r, range(0, 120) g(j) GROUP BY 1, 2) SELECT i::int AS i, j::int AS j, round(v / max(v) OVER (), 4) AS density FROM f",
)
def kernel_density_grid(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 440.0).alias("y"))
    return _round(O.density_grid(points, x="x", y="y", width=600.0, low=-1000.0, high=10000.0), 4, "density")


@register(
    "waveform_display",
    SQL + ", q AS (SELECT patient_id, quantile_cont(abs(value), 0.98) AS s FROM vec GROUP BY 1) SELECT patient_id, sample, channel, round(greatest(least(value / CASE WHEN s > 0 THEN s ELSE 1 END, 1.45::double), -1.45::double), 6) AS display_value FROM vec JOIN q USING (patient_id)",
)
def waveform_display(spark: SparkSession, d: str) -> DataFrame:
    return O.scaled_waveforms(vectors(spark, d), KEY).select("patient_id", "sample", "channel", F.round("display_value", 6).alias("display_value"))


@register(
    "segment_matrix",
    SQL + ", s AS (SELECT sample % 3 AS sample, channel, avg(value) AS value FROM vec GROUP BY 1, 2), a AS (SELECT channel::varchar AS row_name, sample, value FROM s UNION ALL SELECT 'spatial_std_raw', sample, stddev_pop(value) FROM s GROUP BY sample UNION ALL SELECT 'rms_raw', sample, sqrt(avg(value * value)) FROM s GROUP BY sample) SELECT row_name, round(max(value) FILTER (sample = 0), 6) AS point_00000, round(max(value) FILTER (sample = 1), 6) AS point_00001, round(max(value) FILTER (sample = 2), 6) AS point_00002 FROM a GROUP BY 1",
)
def segment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The mean course of all samples over a cycle of three, as a matrix."""
    segment = vectors(spark, d).groupBy((F.col("sample") % 3).alias("sample"), "channel").agg(F.avg("value").alias("value"))
    return _round(O.segment_matrix(segment, [0, 1, 2]), 6, "point_00000", "point_00001", "point_00002")


@register("segment_info_rows", "SELECT n_nationkey, 'n_name' AS field, n_name AS content FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::varchar FROM nation")
def segment_info_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.key_values(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@register(
    "label_and_number_formats",
    "SELECT s_suppkey, regexp_replace(regexp_replace('Net_' || (s_suppkey % 9) || CASE WHEN s_suppkey % 2 = 0 THEN ' L' ELSE '' END, ' [LR]$', ''), '_\\d+$', '') AS label, printf('%.3f', s_acctbal::double) AS shown, CASE WHEN abs(s_acctbal::double) / 1e6 < 0.001 THEN '<0.001' ELSE printf('%.3f', abs(s_acctbal::double) / 1e6) END AS p, s_suppkey + 0.5::double AS x, s_nationkey::double AS z FROM supplier",
)
def label_and_number_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").withColumn("balance", F.col("s_acctbal").cast("double"))
    name = F.concat(F.lit("Net_"), F.col("s_suppkey") % 9, F.when(F.col("s_suppkey") % 2 == 0, " L").otherwise(""))
    place = P.coordinates(F.concat(F.lit("["), F.col("s_suppkey"), F.lit(".5, n/a, "), F.col("s_nationkey"), F.lit("]")))
    return rows.select("s_suppkey", P.without_suffix(name).alias("label"), P.shown_number(F.col("balance")).alias("shown"), P.shown_p(F.abs("balance") / 1e6).alias("p"), place["x"].alias("x"), place["z"].alias("z"))


_TOPO = """, ctr AS (SELECT *, value - avg(value) OVER (PARTITION BY patient_id, sample) AS x FROM vec), uni AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY patient_id, sample)) AS v FROM ctr)"""


@register("eeg_topography", SQL + _TOPO + ", sgn AS (SELECT patient_id, sample, arg_max(sign(v), (abs(v), -channel)) AS s FROM uni GROUP BY 1, 2) SELECT patient_id, sample, channel, round(v * s, 6) AS value FROM uni JOIN sgn USING (patient_id, sample)")
def eeg_topography(spark: SparkSession, d: str) -> DataFrame:
    return T.topography(vectors(spark, d), KEY).select("patient_id", "sample", F.posexplode("map").alias("channel", "value")).withColumns({"channel": F.col("channel").cast("long"), "value": F.round("value", 6)})


def _references(spark: SparkSession, d: str) -> np.ndarray:
    """Four fixed reference templates: the first vectors of one patient."""
    rows = vectors(spark, d).where("patient_id = 0 AND sample < 4").toPandas().sort_values(["sample", "channel"])  # 4 x 64 values
    return rows["value"].to_numpy().reshape(4, -1)


@register("template_confidence", SQL + _TOPO + " SELECT p.patient_id, p.sample, t.sample AS microstate, round(abs(sum(p.v * t.v)), 6) AS score FROM uni p JOIN uni t ON p.channel = t.channel AND t.patient_id = 0 AND t.sample < 4 GROUP BY 1, 2, 3")
def template_confidence(spark: SparkSession, d: str) -> DataFrame:
    scored = T.confidence(V.to_arrays(vectors(spark, d), KEY), _references(spark, d))
    return scored.select("patient_id", "sample", F.posexplode("scores").alias("microstate", "score")).withColumns({"microstate": F.col("microstate").cast("long"), "score": F.round("score", 6)})


@register("fixed_template_labels")
def fixed_template_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by four reference templates, runs of under 3 samples smoothed."""
    rows = V.to_arrays(vectors(spark, d), KEY).withColumn("time_sec", F.col("sample") * 0.004)
    return T.label_fixed(rows, _references(spark, d), KEY, least=3)


@register("group_model_templates")
def group_model_templates(spark: SparkSession, d: str) -> DataFrame:
    """Four templates of the pooled patterns, 500 of each patient: a sampling operator and a fit."""
    rows = V.to_arrays(vectors(spark, d), KEY)
    return T.group_model(T.sampled_peaks(rows, KEY, most=500, seed=42), 4, seed=42)


@register(
    "archetype_topography_alignment",
    SQL + """, ass AS (SELECT DISTINCT patient_id, field_state, (field_state * 7) % 5 AS assigned_archetype FROM fld WHERE field_state <> 3), f AS (SELECT patient_id, time_sec, gfp, assigned_archetype FROM fld JOIN ass USING (patient_id, field_state)),
b AS (SELECT l.patient_id, l.sample, l.time_sec, f.time_sec AS t, f.assigned_archetype AS a FROM two l ASOF LEFT JOIN f ON l.patient_id = f.patient_id AND l.time_sec >= f.time_sec), n AS (SELECT l.patient_id, l.sample, f.time_sec AS t, f.assigned_archetype AS a FROM two l ASOF LEFT JOIN f ON l.patient_id = f.patient_id AND l.time_sec <= f.time_sec),
j AS (SELECT b.patient_id, b.sample, b.time_sec, CASE WHEN b.t IS NOT NULL AND (n.t IS NULL OR b.time_sec - b.t <= n.t - b.time_sec) THEN b.t ELSE n.t END AS t, CASE WHEN b.t IS NOT NULL AND (n.t IS NULL OR b.time_sec - b.t <= n.t - b.time_sec) THEN b.a ELSE n.a END AS assigned_archetype FROM b JOIN n USING (patient_id, sample))
SELECT patient_id, sample, assigned_archetype FROM j WHERE abs(time_sec - t) <= 300""",
)
def archetype_topography_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their own topography (here a number) and the nearest archetype."""
    own = paired_labels(spark, d)
    states = field(spark, d).select("patient_id", "time_sec", "field_state")
    assignments = states.select("patient_id", "field_state").distinct().where("field_state <> 3").withColumn("assigned_archetype", (F.col("field_state") * 7) % 5)
    maps = own.select("patient_id", "time_sec", F.array("corr").alias("map"))
    found = T.align_archetypes(own.select("patient_id", "time_sec", "sample", "microstate"), maps, states, assignments, KEY, tolerance=300.0)
    return found.select("patient_id", "sample", "assigned_archetype")


def _switch_effects(spark: SparkSession, d: str, events: str, y: str) -> DataFrame:
    trace = S.switch_indicator(aligned(spark, d), KEY, state=y, name="y")
    return U.controlled_effects(trace, KEY, events=events, y="y", samples=5)


_ANC = SQL + """, tr AS (SELECT *, coalesce(({y} <> lag({y}) OVER (PARTITION BY patient_id ORDER BY sample))::int::double, 0) AS y, lag({e}) OVER (PARTITION BY patient_id ORDER BY sample) AS b FROM ali),
ev AS (SELECT patient_id, sample AS s, b AS from_state, {e} AS to_state FROM tr WHERE b <> {e}), w AS (SELECT e.patient_id, from_state, to_state, (t.sample >= s) AS post, t.y, t.gfp AS x FROM ev e JOIN tr t ON t.patient_id = e.patient_id AND t.sample BETWEEN s - 5 AND s + 4),
g AS (SELECT patient_id, from_state, to_state, post, count(*) AS n, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM w GROUP BY ALL),
p AS (SELECT patient_id, from_state, to_state, sum(n)::bigint AS n_samples, coalesce(sum(sxy) / nullif(sum(sxx), 0), 0) AS beta, sum(n * mx) / sum(n) AS cx, max(my) FILTER (post) AS y1, max(mx) FILTER (post) AS x1, max(my) FILTER (NOT post) AS y0, max(mx) FILTER (NOT post) AS x0, count(*) AS k FROM g GROUP BY 1, 2, 3)
SELECT patient_id, from_state, to_state, n_samples, round(y0 - beta * (x0 - cx), 6) AS pre_value, round(y1 - beta * (x1 - cx), 6) AS post_value, round(y1 - y0 - beta * (x1 - x0), 6) AS effect_mean_diff, round(beta, 6) AS gfp_beta FROM p WHERE k = 2"""


@register("gfp_controlled_field_switch", _ANC.format(y="field_state", e="microstate"))
def gfp_controlled_field_switch(spark: SparkSession, d: str) -> DataFrame:
    """Field switches around label transitions, at equal power."""
    return _round(_switch_effects(spark, d, "microstate", "field_state"), 6, "pre_value", "post_value", "effect_mean_diff", "gfp_beta")


@register("gfp_controlled_label_switch", _ANC.format(y="microstate", e="field_state"))
def gfp_controlled_label_switch(spark: SparkSession, d: str) -> DataFrame:
    """Label switches around field transitions, at equal power."""
    return _round(_switch_effects(spark, d, "field_state", "microstate"), 6, "pre_value", "post_value", "effect_mean_diff", "gfp_beta")


@register("profile_omnibus")
def profile_omnibus(spark: SparkSession, d: str) -> DataFrame:
    """Repeated-measures F by group with a permutation p, its q, and the mean of each state."""
    return C.omnibus(effects(spark, d), ["grp"], subject="subject", state="microstate", value="value", states=[0, 1, 2, 3, 4], seed=42, min_subjects=7)


@register("profile_posthoc")
def profile_posthoc(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences of states by group, with sign-flip p and q."""
    return C.posthoc(effects(spark, d), ["grp"], subject="subject", state="microstate", value="value", seed=42, min_subjects=7)


@register("connectivity_group_statistics")
def connectivity_group_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Group statistics of state connectivity effects, with the means inside and outside the states."""
    signals = vectors(spark, d).groupBy("patient_id", "sample", F.concat(F.lit("r"), F.col("channel") % 3).alias("region")).agg(F.avg("value").alias("value")).withColumn("microstate", F.col("sample") % 4)
    found = V.connectivity_on_off(signals, KEY, state="microstate")
    return C.connectivity_groups(found, ["microstate", "region_a", "region_b"], seed=42, min_subjects=3)


@register("power_lag_surrogates")
def power_lag_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two power traces at each lag against 128 circular shifts."""
    return U.lagged(aligned(spark, d), KEY, "corr", "gfp", lags=list(range(-10, 11)), surrogates=128, seed=42, measure=U.correlation)


@register("direct_state_coupling")
def direct_state_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of labels and directly clustered states, against 128 circular shifts."""
    from tessera.plans.kernel_queries import pca_kmeans_states

    states = pca_kmeans_states(spark, d).withColumn("__n", F.max("sample").over(Window.partitionBy("patient_id")))
    labelled = numbered_labels(spark, d)
    last = labelled.groupBy("patient_id").agg(F.max("time_sec").alias("__t"))
    # A patient's vectors are spread evenly over the time of its labels.
    placed = states.join(last, "patient_id").select("patient_id", (F.col("sample") * F.col("__t") / F.greatest("__n", F.lit(1))).alias("time_sec"), F.col("seeg_state").alias("direct_state"))
    pairs = asof_nearest(labelled.select("patient_id", "sample", "time_sec", "microstate"), placed, KEY, tolerance=DAY, bucket=1)
    return U.shifted_information(pairs, KEY, "microstate", "direct_state", surrogates=128, seed=42)


@register("paired_tests")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """Paired t-tests of states by group, with p and q."""
    return C.paired_tests(effects(spark, d), ["grp"], subject="subject", level="microstate", value="value")


@register("archetype_permutation_null")
def archetype_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of fitted templates to those of the first patient: the best assignment against all others."""
    from tessera.plans.kernel_queries import polarity_kmeans

    fitted = polarity_kmeans(spark, d).select("patient_id", F.col("field_state").cast("long").alias("field_state"), "pattern")
    packed = fitted.where("patient_id = 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("field_state", "pattern"))).alias("t"))  # four templates
    scored = fitted.where("patient_id > 0").crossJoin(F.broadcast(packed)).withColumn("likeness", F.transform("t", lambda x: V.similarity(F.col("pattern"), x["pattern"])))

    def assign(part):
        import pandas as pd

        part = part.sort_values("field_state")
        own = K.unique_assignment(np.stack(part["likeness"].to_numpy()))
        return pd.DataFrame({"field_state": part["field_state"].to_numpy(), "assigned_archetype": own, "likeness": part["likeness"].to_numpy()})

    assigned = K.grouped(scored.select("patient_id", "field_state", "likeness"), KEY, "field_state long, assigned_archetype long, likeness array<double>", assign)
    return C.archetype_null(assigned)[1]
