"""Joins, unions and layout steps of the report layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.plans.registry import register
from tessera.plans.standins import PAIRED, SQL, aligned, effects, field, labels, paired_labels, read, vectors

#: Regions that a global trace may use, here by channel number.
CORE = (0, 1, 2, 3, 5)


@register(
    "segment_recording_join",
    "SELECT o_orderkey, o_custkey, c_nationkey AS nation_asset, c_mktsegment AS segment_asset FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
)
def segment_recording_join(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'")
    assets = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation_asset"), F.col("c_mktsegment").alias("segment_asset"))
    return orders.join(assets, "o_custkey", "left").select("o_orderkey", "o_custkey", "nation_asset", "segment_asset")


@register("gfp_left_join", PAIRED + "SELECT patient_id, sample, microstate, gfp FROM lab LEFT JOIN fld USING (patient_id, sample)")
def gfp_left_join(spark: SparkSession, d: str) -> DataFrame:
    return paired_labels(spark, d).join(field(spark, d).select("patient_id", "sample", "gfp"), ["patient_id", "sample"], "left").select("patient_id", "sample", "microstate", "gfp")


@register(
    "condition_denominators_union",
    PAIRED + "SELECT 'labels' AS family, patient_id, count(*) AS n FROM lab GROUP BY 2 UNION ALL SELECT 'field', patient_id, count(*) FROM fld GROUP BY 2 UNION ALL SELECT 'paired', patient_id, count(*) FROM ali GROUP BY 2",
)
def condition_denominators_union(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, name: df.groupBy("patient_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "patient_id", "n")
    return count(paired_labels(spark, d), "labels").unionByName(count(field(spark, d), "field")).unionByName(count(aligned(spark, d), "paired"))


@register("patient_union_distinct", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
def patient_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    ids = [read(spark, d, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_regionkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@register(
    "network_loading_pivot",
    "PIVOT (SELECT p_brand, p_size % 4 AS arch, p_retailprice FROM part) ON arch IN (0, 1, 2, 3) USING round(avg(p_retailprice), 6) GROUP BY p_brand",
)
def network_loading_pivot(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").withColumn("arch", F.col("p_size") % 4)
    return part.groupBy("p_brand").pivot("arch", [0, 1, 2, 3]).agg(F.round(F.avg("p_retailprice"), 6))


@register("wide_to_long_drop_nulls", "SELECT s_suppkey, k AS metric, CASE k WHEN 'balance' THEN s_acctbal ELSE s_nationkey::double END AS value FROM supplier, (VALUES ('balance'), ('nation')) v(k) WHERE k = 'balance' OR s_nationkey <> 3")
def wide_to_long_drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.nullif(F.col("s_nationkey"), F.lit(3)).cast("double").alias("nation"))
    return wide.unpivot(["s_suppkey"], ["balance", "nation"], "metric", "value").where(F.col("value").isNotNull())


@register(
    "column_zscore",
    "SELECT s_suppkey, round(CASE WHEN stddev_pop(s_acctbal) OVER () > 0 THEN (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () ELSE 0 END, 6) AS z FROM supplier",
)
def column_zscore(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "supplier")
    stats = table.agg(F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("s"))  # one row
    z = F.when(F.col("s") > 0, (F.col("s_acctbal") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0))
    return table.crossJoin(F.broadcast(stats)).select("s_suppkey", F.round(z, 6).alias("z"))


@register("group_transition_summary", SQL + "SELECT from_state, to_state, count(DISTINCT patient_id) AS n_subjects, round(avg(c), 9) AS mean_n, median(c) AS median_n, sum(c)::bigint AS total FROM (SELECT patient_id, from_state, to_state, count(*) AS c FROM tra GROUP BY 1, 2, 3) GROUP BY 1, 2")
def group_transition_summary(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.sequence import transition_profile

    rows = transition_profile(labels(spark, d), ["patient_id"])
    c = "n_transitions"
    return rows.groupBy("from_state", "to_state").agg(F.countDistinct("patient_id").alias("n_subjects"), F.round(F.avg(c), 9).alias("mean_n"), F.median(c).alias("median_n"), F.sum(c).alias("total"))


@register("one_to_one_check", "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) FILTER (c_custkey IS NULL) AS n_missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def one_to_one_check(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"), F.count_if(F.col("c_custkey").isNull()).alias("n_missing"))


@register(
    "repeated_event_sensitivity",
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT 'all' AS subset, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM f GROUP BY 2 UNION ALL SELECT 'first', o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM f WHERE r = 1 GROUP BY 2",
)
def repeated_event_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = read(spark, d, "orders").withColumn("r", F.row_number().over(order))
    rows = ranked.withColumn("subset", F.explode(F.when(F.col("r") == 1, F.array(F.lit("all"), F.lit("first"))).otherwise(F.array(F.lit("all")))))
    return rows.groupBy("subset", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@register("plot_unit_scaling", SQL + "SELECT grp, subject, microstate, round(CASE WHEN microstate = 0 THEN value * 100 WHEN microstate = 1 THEN value * 1000 ELSE value END, 6) AS shown FROM eff")
def plot_unit_scaling(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.when(F.col("microstate") == 0, F.col("value") * 100).when(F.col("microstate") == 1, F.col("value") * 1000).otherwise(F.col("value"))
    return effects(spark, d).select("grp", "subject", "microstate", F.round(scaled, 6).alias("shown"))


@register("eligibility_summary", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_groups, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_eligible FROM customer GROUP BY 1")
def eligibility_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n_groups"), F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_eligible"))


@register("template_similarity_group")
def template_similarity_group(spark: SparkSession, d: str) -> DataFrame:
    """Templates fitted to all patterns of the other patients against those of the first."""
    from tessera.plans.kernel_queries import polarity_kmeans

    fitted = polarity_kmeans(spark, d).select("patient_id", F.col("field_state").alias("archetype"), "pattern")
    templates = fitted.where("patient_id = 0").select(F.col("archetype").alias("microstate"), F.col("pattern").alias("template"))  # four rows
    scored = fitted.where("patient_id > 0").crossJoin(F.broadcast(templates)).withColumn("sim", V.similarity(F.col("pattern"), F.col("template")))
    found = scored.groupBy("archetype", "microstate").agg(
        F.countDistinct("patient_id").alias("n_subjects"), F.round(F.avg("sim"), 6).alias("mean_similarity"), F.round(F.median("sim"), 6).alias("median_similarity"), F.round(F.min("sim"), 6).alias("min_similarity")
    )
    return found.where("n_subjects >= 3")


@register(
    "global_metric_trace",
    SQL
    + """, k AS (SELECT patient_id, sample, channel, value, sqrt(greatest((channel * 3) % 7, 1)::double) AS w FROM vec WHERE channel IN (0, 1, 2, 3, 5)), m AS (SELECT patient_id, channel, avg(value) AS c, stddev_pop(value) AS s FROM k GROUP BY 1, 2),
z AS (SELECT k.patient_id, sample, w, (value - c) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM k JOIN m USING (patient_id, channel)) SELECT patient_id, sample, round(sqrt(sum(w * x * x) / sum(w)), 6) AS global_metric, count(*) AS n_networks_used FROM z GROUP BY 1, 2""",
)
def global_metric_trace(spark: SparkSession, d: str) -> DataFrame:
    core = vectors(spark, d).where(F.col("channel").isin(*CORE))
    weighted = V.normalise_channels(core, ["patient_id"]).withColumn("weight", V.channel_weight((F.col("channel") * 3) % 7, "sqrt"))
    found = V.weighted_power(weighted, ["patient_id"])
    return found.select("patient_id", "sample", F.round("weighted_rms", 6).alias("global_metric"), F.col("n_series").alias("n_networks_used"))


@register(
    "assignment_rank",
    "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS is_first, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey DESC) = 1 AS is_last FROM part",
)
def assignment_rank(spark: SparkSession, d: str) -> DataFrame:
    down = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    rank = F.row_number().over(down)
    placed = read(spark, d, "part").withColumns({"rank": rank.cast("long"), "n": F.count("*").over(Window.partitionBy("p_brand"))})
    return placed.select("p_brand", "p_partkey", "rank", (F.col("rank") == 1).alias("is_first"), (F.col("rank") == F.col("n")).alias("is_last"))


@register("preferred_match", "SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_name <> 'red widget')::int, p_partkey) = 1")
def preferred_match(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy((F.col("p_name") != "red widget").cast("int"), "p_partkey")
    return read(spark, d, "part").withColumn("r", F.row_number().over(order)).where("r = 1").select("p_brand", "p_name", "p_partkey")
