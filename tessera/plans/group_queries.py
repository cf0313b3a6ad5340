"""Queries of group statistics and of the comparison layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compare as Q
from tessera.operators import statistics as C
from tessera.plans.registry import register
from tessera.plans.standins import PAIRED, SQL, effects, read


def r(n: int, *names: str) -> list:
    return [F.round(c, n).alias(c) for c in names]


@register(
    "bh_fdr",
    """WITH p AS (SELECT p_brand AS family, p_partkey AS k, p_partkey % 997 / 997.0::double AS p FROM part), q AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, k) AS x, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rk FROM p)
SELECT family, k, round(p, 9) AS p_perm, round(least(min(x) OVER (PARTITION BY family ORDER BY rk DESC), 1), 9) AS q_fdr FROM q""",
)
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("k"), (F.col("p_partkey") % 997 / F.lit(997.0)).alias("p_perm"))
    return C.benjamini_hochberg(table, ["family"], tie=["k"]).select("family", "k", *r(9, "p_perm", "q_fdr"))


@register("group_scalar_summary", SQL + "SELECT grp, microstate, count(*) AS n_subjects, round(avg(value), 9) AS mean_effect, round(median(value), 9) AS median_effect FROM eff GROUP BY 1, 2 HAVING count(*) >= 7")
def group_scalar_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.group_summary(effects(spark, d), ["grp", "microstate"], value="value", min_subjects=7).select("grp", "microstate", "n_subjects", *r(9, "mean_effect", "median_effect"))


@register("min_support_filter", "SELECT c_nationkey, c_mktsegment, count(*) AS n_subjects FROM customer GROUP BY 1, 2 HAVING count(*) >= 12")
def min_support_filter(spark: SparkSession, d: str) -> DataFrame:
    counted = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_subjects"))
    return counted.where(F.coalesce("n_subjects", F.lit(0)) >= 12)


_FULL = ", fe AS (SELECT * FROM eff QUALIFY count(*) OVER (PARTITION BY grp, subject) = 5)"


@register(
    "rm_f_statistic",
    SQL
    + _FULL
    + """, m AS (SELECT *, avg(value) OVER (PARTITION BY grp) AS g, avg(value) OVER (PARTITION BY grp, subject) AS a, avg(value) OVER (PARTITION BY grp, microstate) AS b FROM fe), s AS (SELECT grp, count(DISTINCT subject) AS n, sum((b - g) * (b - g)) AS ss, sum((value - a - b + g) * (value - a - b + g)) AS se FROM m GROUP BY 1)
SELECT grp, n AS n_subjects, 5::bigint AS n_states, round((ss / 4) / (se / ((n - 1) * 4)), 6) AS statistic FROM s""",
)
def rm_f_statistic(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_measures_f(effects(spark, d), ["grp"], subject="subject", state="microstate", value="value").select("grp", "n_subjects", "n_states", *r(6, "statistic"))


@register(
    "posthoc_pairs_mean_diff",
    SQL + "SELECT a.grp, a.microstate AS state_a, b.microstate AS state_b, count(*) AS n_subjects, round(avg(a.value), 9) AS mean_state_a, round(avg(b.value), 9) AS mean_state_b, round(avg(b.value - a.value), 9) AS mean_effect, round(median(b.value - a.value), 9) AS median_effect FROM eff a JOIN eff b ON a.grp = b.grp AND a.subject = b.subject AND a.microstate < b.microstate GROUP BY 1, 2, 3",
)
def posthoc_pairs_mean_diff(spark: SparkSession, d: str) -> DataFrame:
    found = C.pair_differences(effects(spark, d), ["grp"], subject="subject", state="microstate", value="value")
    return found.select("grp", "state_a", "state_b", "n_subjects", *r(9, "mean_state_a", "mean_state_b", "mean_effect", "median_effect"))


@register(
    "baseline_delta",
    SQL + "SELECT s.grp, s.subject, s.microstate, round(s.value, 9) AS value, round(b.value, 9) AS baseline_value, round(s.value - b.value, 9) AS delta FROM eff s JOIN eff b ON s.grp = b.grp AND s.subject = b.subject AND b.microstate = 0 AND s.microstate > 0",
)
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("grp", "subject", "microstate", *r(9, "value", "baseline_value", "delta"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = effects(spark, d)
    return Q.baseline_delta(rows.where("microstate > 0"), rows.where("microstate = 0").drop("microstate"), ["grp", "subject"])


_DEL = ", dl AS (SELECT s.grp, s.subject, s.microstate, s.value - b.value AS delta FROM eff s JOIN eff b ON s.grp = b.grp AND s.subject = b.subject AND b.microstate = 0 AND s.microstate > 0)"


@register(
    "delta_t_ci",
    SQL
    + _DEL
    + """, z AS (SELECT grp, microstate, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS s FROM dl GROUP BY 1, 2), w AS (SELECT *, 1.959963984540054::double AS z, (n - 1)::double AS df FROM z),
t AS (SELECT *, CASE WHEN df <= """ + str(len(Q.T_975)) + """ THEN """ + str(list(Q.T_975)) + """[df::int]::double ELSE z + (power(z, 3) + z) / 4 / df + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / 96 / (df * df) + (3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / 384 / (df * df * df) END AS q FROM w)
SELECT grp, microstate, n AS n_subjects, round(m, 6) AS mean_delta, round(s, 6) AS sd_delta, round(s / sqrt(n), 6) AS se_delta, round(m - q * s / sqrt(n), 6) AS ci_low, round(m + q * s / sqrt(n), 6) AS ci_high FROM t""",
)
def delta_t_ci(spark: SparkSession, d: str) -> DataFrame:
    return Q.mean_interval(_deltas(spark, d), ["grp", "microstate"], value="delta", subject="subject").select("grp", "microstate", "n_subjects", *r(6, "mean_delta", "sd_delta", "se_delta", "ci_low", "ci_high"))


@register("stratified_delta", SQL + _DEL + " SELECT grp, microstate, subject % 2 AS stratum, count(*) AS n, round(avg(delta), 9) AS mean_delta FROM dl GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def stratified_delta(spark: SparkSession, d: str) -> DataFrame:
    """Of even (stratum 0) and odd subjects (1)."""
    rows = _deltas(spark, d).groupBy("grp", "microstate", (F.col("subject") % 2).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 9).alias("mean_delta"))
    return rows.where("n >= 5")


@register(
    "complete_case_support",
    "WITH s AS (SELECT o_custkey % 7 AS grp, o_custkey AS subject, count(DISTINCT o_orderpriority) AS l FROM orders GROUP BY 1, 2) SELECT grp, count(*) FILTER (l = 5) AS n_complete, count(*) AS n_subjects FROM s GROUP BY 1",
)
def complete_case_support(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "orders").select((F.col("o_custkey") % 7).alias("grp"), F.col("o_custkey").alias("subject"), "o_orderpriority")
    return Q.complete_cases(table, ["grp"], subject="subject", level="o_orderpriority", levels=5)


@register(
    "first_event_semi_join",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)",
)
def first_event_semi_join(spark: SparkSession, d: str) -> DataFrame:
    first = Q.first_per_key(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return read(spark, d, "lineitem").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@register("rank_top1", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def rank_top1(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_per_key(read(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@register("rank_abs_top3", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC NULLS LAST, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def rank_abs_top3(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_n(read(spark, d, "customer"), ["c_nationkey"], [F.abs("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@register(
    "composition_entropy",
    """WITH c AS (SELECT l_suppkey AS k, l_linenumber AS part, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY k) AS p FROM c)
SELECT k, arg_max(part, (p, -part)) AS dominant, round(max(p), 9) AS dominant_share, round(-sum(p * ln(p + 1e-12)) / CASE WHEN count(*) > 1 THEN ln(count(*)) END, 9) AS entropy, count(*) AS n_parts FROM s GROUP BY 1""",
)
def composition_entropy(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("part")).agg(F.sum("l_quantity").alias("v"))
    return Q.composition(cells, ["k"], part="part", value="v").select("k", "dominant", *r(9, "dominant_share", "entropy"), "n_parts")


@register(
    "bin10_counts",
    "SELECT (round_even(c_acctbal / 10, 0) * 10)::bigint AS x, (round_even(c_custkey / 10.0::double, 0) * 10)::bigint AS y, count(*) AS n FROM customer GROUP BY 1, 2",
)
def bin10_counts(spark: SparkSession, d: str) -> DataFrame:
    bin10 = lambda c: (F.rint(c) * 10).cast("long")  # noqa: E731  half to even
    return read(spark, d, "customer").groupBy(bin10(F.col("c_acctbal") / 10).alias("x"), bin10(F.col("c_custkey") / F.lit(10.0)).alias("y")).agg(F.count("*").alias("n"))


@register(
    "paired_contrast_stats",
    SQL + "SELECT a.grp, a.microstate AS level_a, b.microstate AS level_b, count(*) AS n, round(avg(b.value - a.value), 9) AS mean_diff, round(stddev_samp(b.value - a.value), 9) AS sd_diff, round(avg(b.value - a.value) / (stddev_samp(b.value - a.value) / sqrt(count(*))), 6) AS t FROM eff a JOIN eff b ON a.grp = b.grp AND a.subject = b.subject AND a.microstate < b.microstate GROUP BY 1, 2, 3",
)
def paired_contrast_stats(spark: SparkSession, d: str) -> DataFrame:
    found = Q.paired_t(effects(spark, d), ["grp"], subject="subject", level="microstate", value="value")
    return found.select("grp", "level_a", "level_b", "n", *r(9, "mean_diff", "sd_diff"), *r(6, "t"))


@register(
    "metric_unpivot_summary",
    """WITH m AS (SELECT l_returnflag AS grp, k AS metric, CASE k WHEN 'quantity' THEN l_quantity WHEN 'discount' THEN l_discount ELSE l_tax END AS v FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) x(k))
SELECT grp, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, min(v) AS min, max(v) AS max FROM m GROUP BY 1, 2""",
)
def metric_unpivot_summary(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot(["grp"], ["quantity", "discount", "tax"], "metric", "v")
    return Q.summary(long, ["grp", "metric"], value="v").select("grp", "metric", "n", *r(6, "mean", "sd", "q1", "median", "q3"), "min", "max")


@register(
    "coverage_grid_fill",
    "WITH g AS (SELECT n_nationkey, s.seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2) SELECT n_nationkey AS c_nationkey, seg AS c_mktsegment, coalesce(n, 0)::bigint AS n FROM g LEFT JOIN c ON c_nationkey = n_nationkey AND c_mktsegment = seg",
)
def coverage_grid_fill(spark: SparkSession, d: str) -> DataFrame:
    customer = read(spark, d, "customer")
    axes = [read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), customer.select("c_mktsegment").distinct()]
    counted = customer.where("c_acctbal > 8000").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return Q.fill_grid(counted, axes, ["c_nationkey", "c_mktsegment"], value="n").select("c_nationkey", "c_mktsegment", F.col("n").cast("long").alias("n"))


@register("support_quantiles", SQL + "SELECT microstate, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS least FROM eff GROUP BY 1")
def support_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return effects(spark, d).groupBy("microstate").agg(*(F.round(c, 6).alias(n) for c, n in ((q(0.05), "q05"), (q(0.95), "q95"), (F.avg("value"), "mean"), (F.median("value"), "median"), (F.min("value"), "least"))))


@register(
    "eeg_parameter_gev",
    PAIRED
    + """, p AS (SELECT patient_id, microstate, avg(n_samples) AS mean_run, median(n_samples) AS median_run, count(*) AS n_runs FROM run GROUP BY 1, 2), e AS (SELECT patient_id, microstate, count(*) AS n, avg(corr) AS mc, sum(gfp * gfp * corr * corr) AS num FROM ali GROUP BY 1, 2), t AS (SELECT patient_id, sum(gfp * gfp) AS den, count(*) AS total FROM ali GROUP BY 1)
SELECT patient_id, microstate, round(n / total, 9) AS coverage, round(mean_run, 9) AS mean_run, median_run, n_runs, round(mc, 6) AS mean_corr, round(num / den, 6) AS gev FROM e JOIN t USING (patient_id) JOIN p USING (patient_id, microstate)""",
)
def eeg_parameter_gev(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from tessera.operators.sequence import runs
    from tessera.plans.standins import aligned, paired_labels

    length = runs(paired_labels(spark, d), ["patient_id"]).groupBy("patient_id", "microstate").agg(F.avg("n_samples").alias("mean_run"), F.median("n_samples").alias("median_run"), F.count("*").alias("n_runs"))
    w = Window.partitionBy("patient_id")
    square = F.pow(F.col("gfp"), 2)
    part = aligned(spark, d).groupBy("patient_id", "microstate").agg(F.count("*").alias("n"), F.avg("corr").alias("mean_corr"), F.sum(square * F.pow(F.col("corr"), 2)).alias("num"), F.sum(square).alias("own"))
    placed = part.withColumns({"coverage": F.col("n") / F.sum("n").over(w), "gev": F.col("num") / F.sum("own").over(w)}).join(length, ["patient_id", "microstate"])
    return placed.select("patient_id", "microstate", *r(9, "coverage", "mean_run"), "median_run", "n_runs", *r(6, "mean_corr", "gev"))


@register(
    "model_order_fit_gain",
    "WITH f AS (SELECT o_custkey % 20 AS patient_id, l_linenumber AS n_states, avg(l_extendedprice) AS fit FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT patient_id, n_states, round(fit, 4) AS fit, round(fit - lag(fit) OVER (PARTITION BY patient_id ORDER BY n_states), 4) AS gain FROM f",
)
def model_order_fit_gain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    joined = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    fit = joined.groupBy((F.col("o_custkey") % 20).alias("patient_id"), F.col("l_linenumber").alias("n_states")).agg(F.avg("l_extendedprice").alias("fit"))
    gain = F.col("fit") - F.lag("fit").over(Window.partitionBy("patient_id").orderBy("n_states"))
    return fit.select("patient_id", "n_states", F.round("fit", 4).alias("fit"), F.round(gain, 4).alias("gain"))


@register("subject_alias", "SELECT c_custkey, printf('sub-%02d', dense_rank() OVER (ORDER BY c_name)) AS alias FROM customer")
def subject_alias(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    # Names of one head are ranked together, on top of the number of names under lesser heads.
    chosen = read(spark, d, "customer").select("c_custkey", "c_name", F.substring("c_name", 1, 15).alias("head"))
    heads = chosen.groupBy("head").agg(F.countDistinct("c_name").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each head
    rank = F.dense_rank().over(Window.partitionBy("head").orderBy("c_name")) + F.col("before")
    return chosen.join(heads.select("head", before.alias("before")), "head").select("c_custkey", F.format_string("sub-%02d", rank).alias("alias"))
