"""Queries over channel vectors, regions and global power traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import regions as R
from tessera.operators import sequence as S
from tessera.operators import statistics as C
from tessera.operators import vectors as V
from tessera.plans.registry import register
from tessera.plans.standins import SQL, aligned, labels, read, vectors

KEY = ["patient_id"]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@register("gfp_population_std", SQL + "SELECT patient_id, sample, round(stddev_pop(value), 6) AS power, count(*) AS n_channels FROM vec GROUP BY 1, 2")
def gfp_population_std(spark: SparkSession, d: str) -> DataFrame:
    return V.field_power(vectors(spark, d), KEY).select("patient_id", "sample", *r6("power"), "n_channels")


_Z = ", zs AS (SELECT v.patient_id, sample, v.channel, (value - c) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM vec v JOIN (SELECT patient_id, channel, avg(value) AS c, stddev_pop(value) AS s FROM vec GROUP BY 1, 2) m USING (patient_id, channel))"


@register("channel_zscore", SQL + _Z + " SELECT patient_id, sample, channel, round(z, 6) AS value FROM zs")
def channel_zscore(spark: SparkSession, d: str) -> DataFrame:
    return V.normalise_channels(vectors(spark, d), KEY).select("patient_id", "sample", "channel", *r6("value"))


@register(
    "channel_robust_zscore",
    SQL + "SELECT patient_id, sample, channel, round((value - c) / CASE WHEN s = 0 THEN 1 ELSE 1.4826::double * s END, 6) AS value FROM vec JOIN (SELECT patient_id, channel, median(value) AS c, mad(value) AS s FROM vec GROUP BY 1, 2) USING (patient_id, channel)",
)
def channel_robust_zscore(spark: SparkSession, d: str) -> DataFrame:
    return V.normalise_channels(vectors(spark, d), KEY, strategy="robust-zscore").select("patient_id", "sample", "channel", *r6("value"))


@register("field_metric_trace", SQL + _Z + " SELECT patient_id, sample, round(sqrt(avg(z * z)), 6) AS power, count(*) AS n_channels FROM zs GROUP BY 1, 2")
def field_metric_trace(spark: SparkSession, d: str) -> DataFrame:
    normal = V.normalise_channels(V.valid_channels(vectors(spark, d), KEY), KEY)
    return V.field_power(normal, KEY, metric="rms").select("patient_id", "sample", *r6("power"), "n_channels")


_PAT = ", ctr AS (SELECT *, value - avg(value) OVER (PARTITION BY patient_id, sample) AS x FROM vec), pat AS (SELECT patient_id, sample, channel, x / sqrt(sum(x * x) OVER (PARTITION BY patient_id, sample)) AS v FROM ctr)"


def patterns(spark: SparkSession, d: str) -> DataFrame:
    return V.to_arrays(vectors(spark, d), KEY).withColumn("pattern", V.unit_pattern(F.col("pattern")))


def flat(df: DataFrame, column: str = "pattern") -> DataFrame:
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, F.posexplode(column).alias("channel", "value")).select(*keys, F.col("channel").cast("long").alias("channel"), *r6("value"))


@register("map_pattern_unit_norm", SQL + _PAT + " SELECT patient_id, sample, channel, round(v, 6) AS value FROM pat")
def map_pattern_unit_norm(spark: SparkSession, d: str) -> DataFrame:
    return flat(patterns(spark, d))


_ORI = ", big AS (SELECT patient_id, sample, arg_max(sign(v), (abs(v), -channel)) AS s FROM pat GROUP BY 1, 2), ori AS (SELECT patient_id, sample, channel, v * s AS v FROM pat JOIN big USING (patient_id, sample))"


@register("orient_pattern", SQL + _PAT + _ORI + " SELECT patient_id, sample, channel, round(v, 6) AS value FROM ori")
def orient_pattern(spark: SparkSession, d: str) -> DataFrame:
    return flat(patterns(spark, d).withColumn("pattern", V.oriented(F.col("pattern"))))


_TPL = ", tpl AS (SELECT sample AS state, channel, v FROM pat WHERE patient_id = 0 AND sample < 4), sim AS (SELECT p.patient_id, p.sample, t.state, round(abs(sum(p.v * t.v)), 9) AS sim FROM pat p JOIN tpl t USING (channel) GROUP BY 1, 2, 3)"


def templates(spark: SparkSession, d: str) -> DataFrame:
    return patterns(spark, d).where("patient_id = 0 AND sample < 4").select(F.col("sample").alias("state"), F.col("pattern").alias("template"))


@register("abs_similarity_argmax", SQL + _PAT + _TPL + " SELECT patient_id, sample, arg_max(state, (sim, -state)) AS state, round(max(sim), 6) AS corr FROM sim GROUP BY 1, 2")
def abs_similarity_argmax(spark: SparkSession, d: str) -> DataFrame:
    return V.backfit(patterns(spark, d), templates(spark, d), KEY).select("patient_id", "sample", "state", *r6("corr"))


@register(
    "conditioned_maps",
    SQL
    + """, lb AS (SELECT v.*, l.microstate AS st FROM vec v JOIN lab l ON l.patient_id = 'p' || v.patient_id AND l.sample = v.sample),
m AS (SELECT patient_id, st, channel, avg(value) AS value FROM lb GROUP BY 1, 2, 3), c AS (SELECT *, value - avg(value) OVER (PARTITION BY patient_id, st) AS x FROM m),
u AS (SELECT patient_id, st, channel, x / sqrt(sum(x * x) OVER (PARTITION BY patient_id, st)) AS v FROM c), b AS (SELECT patient_id, st, arg_max(sign(v), (abs(v), -channel)) AS s FROM u GROUP BY 1, 2)
SELECT patient_id, st AS microstate, channel, round(v * s, 6) AS value FROM u JOIN b USING (patient_id, st)""",
)
def conditioned_maps(spark: SparkSession, d: str) -> DataFrame:
    return flat(V.mean_pattern(_labelled(spark, d), ["patient_id", "microstate"]).select("patient_id", "microstate", "map"), "map")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).select(F.substring("patient_id", 2, 9).cast("long").alias("patient_id"), "sample", "microstate")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).join(_states(spark, d), ["patient_id", "sample"])


def labelled_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of the labels of the vectors' patients, with sample numbers as times."""
    return S.transitions(_states(spark, d).withColumn("time_sec", F.col("sample").cast("double")), KEY)


@register(
    "group_conditioned_maps",
    SQL
    + """, lb AS (SELECT v.*, l.microstate AS st FROM vec v JOIN lab l ON l.patient_id = 'p' || v.patient_id AND l.sample = v.sample),
m AS (SELECT st, channel, avg(value) AS value, count(DISTINCT patient_id) AS ns, count(*) AS n FROM lb GROUP BY 1, 2), c AS (SELECT *, value - avg(value) OVER (PARTITION BY st) AS x FROM m),
u AS (SELECT st, channel, ns, n, x / sqrt(sum(x * x) OVER (PARTITION BY st)) AS v FROM c), b AS (SELECT st, arg_max(sign(v), (abs(v), -channel)) AS s FROM u GROUP BY 1)
SELECT st AS microstate, ns AS n_subjects, n AS n_samples, channel, round(v * s, 6) AS value FROM u JOIN b USING (st) WHERE ns >= 3""",
)
def group_conditioned_maps(spark: SparkSession, d: str) -> DataFrame:
    return flat(V.mean_pattern(_labelled(spark, d), ["microstate"], min_subjects=3), "map").select("microstate", "n_subjects", "n_samples", "channel", "value")


_SER = ", ser AS (SELECT patient_id, sample, channel, value, sqrt(greatest(channel % 3, 1)::double) AS w FROM vec)"


@register(
    "weighted_rms_std",
    SQL + _SER + " SELECT patient_id, sample, round(sqrt(sum(w * value * value) / sum(w)), 6) AS weighted_rms, round(sqrt(greatest(sum(w * value * value) / sum(w) - power(sum(w * value) / sum(w), 2), 0)), 6) AS weighted_std, count(*) AS n_series FROM ser GROUP BY 1, 2",
)
def weighted_rms_std(spark: SparkSession, d: str) -> DataFrame:
    weighted = vectors(spark, d).withColumn("weight", V.channel_weight(F.col("channel") % 3, "sqrt"))
    return V.weighted_power(weighted, KEY).select("patient_id", "sample", *r6("weighted_rms", "weighted_std"), "n_series")


_REG = ", reg AS (SELECT patient_id, 'r' || (channel % 3) AS region, sample, avg(value) AS value FROM vec GROUP BY 1, 2, 3)"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("patient_id", "channel").distinct()
    return rows.withColumn("region", F.concat(F.lit("r"), F.col("channel") % 3))


def regions(spark: SparkSession, d: str) -> DataFrame:
    return R.region_signals(vectors(spark, d), _mapping(spark, d), KEY)


@register(
    "region_mean_coverage",
    SQL + _REG + ", cov AS (SELECT patient_id, 'r' || (channel % 3) AS region, count(DISTINCT channel) AS n_bipolar_channels FROM vec GROUP BY 1, 2) SELECT patient_id, region, sample, round(value, 6) AS value, n_bipolar_channels FROM reg JOIN cov USING (patient_id, region)",
)
def region_mean_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = regions(spark, d).join(R.region_coverage(_mapping(spark, d), KEY), ["patient_id", "region"])
    return found.select("patient_id", "region", "sample", *r6("value"), "n_bipolar_channels")


_CON = "round(abs(covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value))), 6)"


@register("pairwise_abs_corr", SQL + _REG + f" SELECT a.patient_id, a.region AS region_a, b.region AS region_b, count(*) AS n_samples, {_CON} AS connectivity FROM reg a JOIN reg b ON a.patient_id = b.patient_id AND a.sample = b.sample AND a.region < b.region GROUP BY 1, 2, 3")
def pairwise_abs_corr(spark: SparkSession, d: str) -> DataFrame:
    return V.connectivity(regions(spark, d), KEY).select("patient_id", "region_a", "region_b", "n_samples", *r6("connectivity"))


@register(
    "state_connectivity_profile",
    SQL + _REG + f", s AS (SELECT *, sample % 4 AS st FROM reg) SELECT a.patient_id, a.st AS microstate, a.region AS region_a, b.region AS region_b, count(*) AS n_samples, {_CON} AS connectivity FROM s a JOIN s b ON a.patient_id = b.patient_id AND a.sample = b.sample AND a.region < b.region GROUP BY 1, 2, 3, 4",
)
def state_connectivity_profile(spark: SparkSession, d: str) -> DataFrame:
    states = regions(spark, d).withColumn("microstate", F.col("sample") % 4)
    return V.connectivity(states, ["patient_id", "microstate"]).select("patient_id", "microstate", "region_a", "region_b", "n_samples", *r6("connectivity"))


@register(
    "state_on_off_connectivity",
    SQL
    + _REG
    + f""", s AS (SELECT a.patient_id, a.region AS ra, b.region AS rb, a.sample % 4 AS st, a.value AS x, b.value AS y FROM reg a JOIN reg b ON a.patient_id = b.patient_id AND a.sample = b.sample AND a.region < b.region),
m AS (SELECT DISTINCT st AS k FROM s), e AS (SELECT patient_id, k, ra, rb, st = k AS inside, count(*) AS n, abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))) AS c FROM s, m GROUP BY 1, 2, 3, 4, 5)
SELECT i.patient_id, i.ra AS region_a, i.rb AS region_b, i.k AS microstate, round(i.c, 6) AS state_connectivity, round(o.c, 6) AS off_connectivity, round(i.c - o.c, 6) AS effect_mean_diff, i.n AS n_state_samples, o.n AS n_nonstate_samples
FROM e i JOIN e o USING (patient_id, k, ra, rb) WHERE i.inside AND NOT o.inside""",
)
def state_on_off_connectivity(spark: SparkSession, d: str) -> DataFrame:
    states = regions(spark, d).withColumn("microstate", F.col("sample") % 4)
    found = V.connectivity_on_off(states, KEY, state="microstate")
    return found.select("patient_id", "region_a", "region_b", "microstate", *r6("state_connectivity", "off_connectivity", "effect_mean_diff"), F.col("n_state_samples").cast("long"), F.col("n_nonstate_samples").cast("long"))


@register(
    "same_region_map",
    """WITH p AS (SELECT l_orderkey, l_linenumber, c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT p.a || '-' || p.b AS bipolar_channel, p.a::varchar AS contact_a, p.b::varchar AS contact_b, x.r AS region_a, y.r AS region_b, CASE WHEN x.r = y.r THEN x.r END AS region, coalesce(x.r = y.r, false) AS valid_same_region
FROM (SELECT DISTINCT a, b FROM p) p LEFT JOIN (SELECT n_nationkey AS k, 'REGION' || n_regionkey AS r FROM nation) x ON x.k = a LEFT JOIN (SELECT n_nationkey AS k, 'REGION' || n_regionkey AS r FROM nation) y ON y.k = b""",
)
def same_region_map(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    pairs = line.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.concat_ws("-", "c_nationkey", "s_nationkey").alias("bipolar_channel")).distinct()
    atlas = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("contact"), F.concat(F.lit("REGION"), "n_regionkey").alias("label"), F.col("n_nationkey").alias("position"))
    return R.same_region_map(pairs, atlas, [])


@register("region_mapping_summary", "SELECT 'REGION' || n_regionkey AS region, count(*) AS n_channels FROM nation GROUP BY 1")
def region_mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy(F.concat(F.lit("REGION"), "n_regionkey").alias("region")).agg(F.count("*").alias("n_channels"))


@register("project_common_space")
def project_common_space(spark: SparkSession, d: str) -> DataFrame:
    """Templates fitted to all of a patient's patterns, by region."""
    from tessera.plans.kernel_queries import polarity_kmeans

    wide = polarity_kmeans(spark, d).withColumnRenamed("field_state", "sample")
    long = wide.select("patient_id", "sample", F.posexplode("pattern").alias("channel", "value")).withColumn("channel", F.col("channel").cast("long"))
    units = R.region_signals(long, _mapping(spark, d), KEY)
    arrays = V.to_arrays(units, KEY, channel="region").withColumn("pattern", V.oriented(V.unit_pattern(F.col("pattern"))))
    names = units.groupBy("patient_id", "sample").agg(F.array_sort(F.collect_set("region")).alias("names"))
    rows = arrays.join(names, ["patient_id", "sample"]).select("patient_id", F.col("sample").alias("field_state"), F.explode(F.arrays_zip("names", "pattern")).alias("z"))
    return rows.select("patient_id", "field_state", F.col("z.names").alias("region"), F.round("z.pattern", 6).alias("loading"))


@register(
    "state_on_off_cohens_d",
    SQL
    + """, m AS (SELECT DISTINCT microstate AS k FROM ali), e AS (SELECT patient_id, k, microstate = k AS inside, count(*) AS n, avg(gfp) AS m, var_samp(gfp) AS v FROM ali, m GROUP BY 1, 2, 3)
SELECT i.patient_id, i.k AS microstate, round(i.m - o.m, 6) AS effect_mean_diff, round((i.m - o.m) / sqrt(((i.n - 1) * i.v + (o.n - 1) * o.v) / (i.n + o.n - 2)), 6) AS effect_cohens_d, i.n AS n_state_samples, o.n AS n_nonstate_samples
FROM e i JOIN e o USING (patient_id, k) WHERE i.inside AND NOT o.inside""",
)
def state_on_off_cohens_d(spark: SparkSession, d: str) -> DataFrame:
    found = C.on_off_effect(aligned(spark, d), KEY, state="microstate", value="gfp")
    return found.select("patient_id", "microstate", *r6("effect_mean_diff", "effect_cohens_d"), "n_state_samples", "n_nonstate_samples")


@register("state_profile", SQL + "SELECT patient_id, microstate, round(avg(gfp), 6) AS state_mean, round(stddev_pop(gfp), 6) AS state_std, count(*) AS n_state_samples FROM ali GROUP BY 1, 2")
def state_profile(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).groupBy("patient_id", "microstate").agg(F.round(F.avg("gfp"), 6).alias("state_mean"), F.round(F.stddev_pop("gfp"), 6).alias("state_std"), F.count("*").alias("n_state_samples"))


@register(
    "conditional_vs_baseline_preference",
    SQL
    + """, g AS (SELECT * FROM (SELECT patient_id, field_state, count(*) AS n FROM ali GROUP BY 1, 2) JOIN (SELECT patient_id, microstate, count(*) AS b FROM ali GROUP BY 1, 2) USING (patient_id)), j AS (SELECT patient_id, field_state, microstate, count(*) AS c FROM ali GROUP BY 1, 2, 3), t AS (SELECT patient_id, count(*) AS total FROM ali GROUP BY 1)
SELECT patient_id, field_state, microstate, n AS n_samples, coalesce(c, 0)::bigint AS joint_samples, round(coalesce(c, 0) / n, 9) AS conditional_probability, round(b / total, 9) AS baseline_probability, round(coalesce(c, 0) / n - b / total, 9) AS effect_mean_diff
FROM g JOIN t USING (patient_id) LEFT JOIN j USING (patient_id, field_state, microstate)""",
)
def conditional_vs_baseline_preference(spark: SparkSession, d: str) -> DataFrame:
    found = C.preference(aligned(spark, d), KEY, given="field_state", state="microstate")
    return found.select("patient_id", "field_state", "microstate", "n_samples", "joint_samples", *(F.round(c, 9).alias(c) for c in ("conditional_probability", "baseline_probability", "effect_mean_diff")))
