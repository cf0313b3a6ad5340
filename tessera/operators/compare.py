"""Comparison layer: deltas, intervals, ranks and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)


def t_quantile(df):
    """The 97.5 % quantile for a column of degrees of freedom: from the table, beyond it by the usual expansion."""
    z = 1.959963984540054
    g = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    far = F.lit(g[0]) + F.lit(g[1]) / df + F.lit(g[2]) / (df * df) + F.lit(g[3]) / (df * df * df)
    return F.when(df <= len(T_975), F.get(F.array(*map(F.lit, T_975)), (df - 1).cast("int"))).otherwise(far)


def baseline_delta(stages: DataFrame, baseline: DataFrame, keys: list[str], *, value: str = "value") -> DataFrame:
    """Stage value minus the baseline's of the same keys; what has no baseline drops out."""
    base = baseline.select(*keys, F.col(value).alias("baseline_value"))
    return stages.join(base, keys).withColumn("delta", F.col(value) - F.col("baseline_value"))


def mean_interval(table: DataFrame, keys: list[str], *, value: str, subject: str) -> DataFrame:
    """Subjects, mean, deviation, standard error and 95 % t-interval; without spread for a single row."""
    n = F.count(value)
    out = table.groupBy(*keys).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(subject))).alias("n_subjects"), n.alias("__n"), F.avg(value).alias("mean_delta"), F.stddev_samp(value).alias("sd_delta"))
    se = F.when(F.col("__n") > 1, F.col("sd_delta") / F.sqrt("__n"))
    half = F.when(F.col("__n") > 1, t_quantile(F.greatest(F.col("__n") - 1, F.lit(1)))) * se
    return out.withColumns({"se_delta": se, "ci_low": F.col("mean_delta") - half, "ci_high": F.col("mean_delta") + half}).drop("__n")


def complete_cases(table: DataFrame, keys: list[str], *, subject: str, level: str, levels: int) -> DataFrame:
    """Subjects that have all levels, against all subjects, by key."""
    per = table.groupBy(*keys, subject).agg(F.countDistinct(level).alias("__l"))
    return per.groupBy(*keys).agg(F.count_if(F.col("__l") == levels).alias("n_complete"), F.count("*").alias("n_subjects"))


def first_per_key(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top_n(table: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def composition(table: DataFrame, keys: list[str], *, part: str, value: str) -> DataFrame:
    """Shares within a key, the dominant part (first on ties) and the entropy over the log of the number of parts (null for one)."""
    w = Window.partitionBy(*keys)
    shared = table.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(w)))
    entropy = -F.sum(F.col("share") * F.log(F.col("share") + F.lit(1e-12)))
    return shared.groupBy(*keys).agg(
        F.max_by(part, F.struct("share", -F.col(part))).alias("dominant"), F.max("share").alias("dominant_share"), F.try_divide(entropy, F.when(F.count("*") > 1, F.log(F.count("*").cast("double")))).alias("entropy"), F.count("*").alias("n_parts")
    )


def summary(table: DataFrame, keys: list[str], *, value: str) -> DataFrame:
    """Count, mean, sample deviation, quartiles and range; nulls are left out."""
    q = lambda p: F.percentile(value, F.lit(p))  # noqa: E731  exact, interpolated
    return table.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.25).alias("q1"), F.median(value).alias("median"), q(0.75).alias("q3"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def fill_grid(table: DataFrame, axes: list[DataFrame], keys: list[str], *, value: str, empty=0) -> DataFrame:
    """All combinations of the (small) axes, with ``empty`` where the table has no row."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(F.broadcast(axis))
    return grid.join(table, keys, "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def paired_t(table: DataFrame, keys: list[str], *, subject: str, level: str, value: str) -> DataFrame:
    """t of the differences between each pair of levels within subjects."""
    cells = table.groupBy(*keys, subject, level).agg(F.avg(value).alias("__v"))
    a = cells.select(*keys, subject, F.col(level).alias("level_a"), F.col("__v").alias("__a"))
    b = cells.select(*keys, subject, F.col(level).alias("level_b"), F.col("__v").alias("__b"))
    d = F.col("__b") - F.col("__a")
    out = a.join(b, [*keys, subject]).where("level_a < level_b").groupBy(*keys, "level_a", "level_b").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return out.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n")))
