"""Coupling and group statistics as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators.compare import paired_t


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation as an aggregate; 0 with fewer than ``least`` pairs or where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.when((F.count(F.when(both, 1)) >= least) & (spread > 0), F.try_divide(F.covar_pop(x, y), spread)).otherwise(F.lit(0.0))


def mutual_information(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mutual information of two labels over the root of the product of their entropies; 0 where an entropy is 0."""
    joint = pairs.groupBy(*keys, x, y).agg(F.count("*").alias("__c"))
    by = lambda *c: F.sum("__c").over(Window.partitionBy(*keys, *c))
    parts = joint.withColumns({"__n": by(), "__x": by(x), "__y": by(y)})
    p, px, py = (F.col(c) / F.col("__n") for c in ("__c", "__x", "__y"))
    total = parts.groupBy(*keys).agg(
        F.sum(p * F.log(p / (px * py))).alias("__mi"), F.sum(-p * F.log(px)).alias("__hx"), F.sum(-p * F.log(py)).alias("__hy"), F.sum("__c").alias("n_samples")
    )
    value = F.when((F.col("__hx") > 1e-15) & (F.col("__hy") > 1e-15), F.col("__mi") / F.sqrt(F.greatest(F.col("__hx") * F.col("__hy"), F.lit(1e-300)))).otherwise(F.lit(0.0))
    return total.select(*keys, "n_samples", value.alias("nmi"))


def against_null(values: DataFrame, keys: list[str], *, observed: str, null: str, two_sided: bool = False) -> DataFrame:
    """Observed value, mean of the surrogates, their difference and (count of surrogates at least as large + 1) / (S + 1).

    ``values`` has a row for each key and surrogate, with the observed value in each. Two-sided compares distances to
    the surrogates' mean.
    """
    mean = F.avg(null).over(Window.partitionBy(*keys))
    placed = values.withColumn("__m", mean)
    extreme = F.abs(F.col(null) - F.col("__m")) >= F.abs(F.col(observed) - F.col("__m")) if two_sided else F.col(null) >= F.col(observed)
    return placed.groupBy(*keys).agg(
        F.first(observed).alias("observed_coupling"),
        F.avg(null).alias("null_mean_coupling"),
        (F.first(observed) - F.avg(null)).alias("effect_mean_diff"),
        ((F.sum(extreme.cast("int")) + 1) / (F.count("*") + 1)).alias("p_perm"),
    )


def adjusted_means(samples: DataFrame, keys: list[str], *, group: str, y: str, x: str) -> DataFrame:
    """Group means of y at the key's mean of x, with one slope within groups (analysis of covariance).

    The pooled slope is the sum of the groups' co-moments over that of their squares; 0 where x doesn't vary within
    groups. Keys with a single group drop out. Sums of centred values come from covar_pop and var_pop.
    """
    whole = samples.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    per = whole.groupBy(*keys, group).agg(
        F.count("*").alias("__n"), F.avg(y).alias("raw_mean"), F.avg(x).alias("mean_x"), (F.covar_pop(x, y) * F.count("*")).alias("__xy"), (F.var_pop(x) * F.count("*")).alias("__xx")
    )
    w = Window.partitionBy(*keys)
    n = F.sum("__n").over(w)
    slope = F.coalesce(F.try_divide(F.sum("__xy").over(w), F.when(F.sum("__xx").over(w) > 0, F.sum("__xx").over(w))), F.lit(0.0))
    center = F.sum(F.col("mean_x") * F.col("__n")).over(w) / n
    placed = per.withColumns({"beta": slope, "__center": center, "__groups": F.count("*").over(w)}).where("__groups > 1")
    return placed.select(*keys, group, (F.col("raw_mean") - F.col("beta") * (F.col("mean_x") - F.col("__center"))).alias("adjusted_mean"), "raw_mean", F.col("__n").alias("n_samples"), "mean_x", "beta")


def on_off_effect(samples: DataFrame, keys: list[str], *, state: str, value: str) -> DataFrame:
    """Mean in each state minus the mean outside it, and Cohen's d with pooled sample variances (0 if not defined)."""
    per = samples.where(F.col(value).isNotNull()).groupBy(*keys, state).agg(F.count("*").alias("__n"), F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    w = Window.partitionBy(*keys)
    placed = per.withColumns({f"{c}o": F.sum(c).over(w) - F.col(c) for c in ("__n", "__s", "__q")}).where("__no > 0")
    var = lambda n, s, q: F.try_divide(F.greatest(F.col(q) - F.col(s) * F.col(s) / F.col(n), F.lit(0.0)), F.col(n) - 1)
    diff = F.col("__s") / F.col("__n") - F.col("__so") / F.col("__no")
    pooled = F.try_divide((F.col("__n") - 1) * var("__n", "__s", "__q") + (F.col("__no") - 1) * var("__no", "__so", "__qo"), F.col("__n") + F.col("__no") - 2)
    d = F.when((F.col("__n") > 1) & (F.col("__no") > 1) & (pooled > 0), F.try_divide(diff, F.sqrt(F.greatest(pooled, F.lit(0.0))))).otherwise(F.lit(0.0))
    return placed.select(*keys, state, diff.alias("effect_mean_diff"), d.alias("effect_cohens_d"), F.col("__n").alias("n_state_samples"), F.col("__no").alias("n_nonstate_samples"))


def preference(samples: DataFrame, keys: list[str], *, given: str, state: str) -> DataFrame:
    """Probability of every state under every condition against the state's overall probability, zero counts included."""
    joint = samples.groupBy(*keys, given, state).agg(F.count("*").alias("__j"))
    each = lambda c: joint.groupBy(*keys, c).agg(F.sum("__j").alias(f"__{c}"))
    grid = each(given).join(each(state), keys).join(joint, [*keys, given, state], "left").withColumn("joint_samples", F.coalesce("__j", F.lit(0)).cast("long"))
    total = F.sum("joint_samples").over(Window.partitionBy(*keys))
    return grid.withColumns({"conditional_probability": F.col("joint_samples") / F.col(f"__{given}"), "baseline_probability": F.col(f"__{state}") / total}).select(
        *keys, given, state, F.col(f"__{given}").alias("n_samples"), "joint_samples", "conditional_probability", "baseline_probability", (F.col("conditional_probability") - F.col("baseline_probability")).alias("effect_mean_diff")
    )


def benjamini_hochberg(table: DataFrame, family: list[str], *, p: str = "p_perm", name: str = "q_fdr", tie: list[str] | None = None) -> DataFrame:
    """False-discovery-rate adjusted p-values within each family."""
    w = Window.partitionBy(*family)
    ranked = table.withColumn("__rank", F.row_number().over(w.orderBy(p, *(tie or [])))).withColumn("__n", F.count("*").over(w))
    raised = ranked.withColumn("__q", F.col(p) * F.col("__n") / F.col("__rank"))
    down = w.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raised.withColumn(name, F.least(F.min("__q").over(down), F.lit(1.0))).drop("__rank", "__n", "__q")


def group_summary(table: DataFrame, keys: list[str], *, value: str, min_subjects: int = 1) -> DataFrame:
    """Number of rows, mean and median by key, of keys with enough rows; null values don't count."""
    known = table.where(F.col(value).isNotNull()).dropna(subset=keys)
    return known.groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.avg(value).alias("mean_effect"), F.median(value).alias("median_effect")).where(F.col("n_subjects") >= min_subjects)


def repeated_measures_f(table: DataFrame, keys: list[str], *, subject: str, state: str, value: str) -> DataFrame:
    """F statistic of states within subjects, over subjects that have all states: 0 where degenerate, infinite without error."""
    cells = table.where(F.col(value).isNotNull()).groupBy(*keys, subject, state).agg(F.avg(value).alias("__v"))
    k = cells.groupBy(*keys).agg(F.countDistinct(state).alias("__k"))
    whole = cells.join(k, keys).withColumn("__has", F.count("*").over(Window.partitionBy(*keys, subject))).where("__has = __k")
    mean = lambda *c: F.avg("__v").over(Window.partitionBy(*keys, *c))
    parts = whole.withColumns({"__g": mean(), "__a": mean(subject), "__b": mean(state)})
    sums = parts.groupBy(*keys).agg(
        F.countDistinct(subject).alias("n_subjects"),
        F.first("__k").alias("__k"),
        F.sum(F.pow(F.col("__b") - F.col("__g"), 2)).alias("__ss"),
        F.sum(F.pow(F.col("__v") - F.col("__a") - F.col("__b") + F.col("__g"), 2)).alias("__se"),
    )
    ms = F.try_divide(F.col("__ss"), F.col("__k") - 1)
    me = F.try_divide(F.col("__se"), (F.col("n_subjects") - 1) * (F.col("__k") - 1))
    f = F.when((F.col("n_subjects") < 2) | (F.col("__k") < 2), F.lit(0.0)).when(me == 0, F.when(ms == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(ms, me))
    return sums.select(*keys, "n_subjects", F.col("__k").alias("n_states"), f.alias("statistic"))


def pair_differences(table: DataFrame, keys: list[str], *, subject: str, state: str, value: str) -> DataFrame:
    """Mean and median over subjects of later minus earlier state, for each pair of states of a key."""
    cells = table.where(F.col(value).isNotNull()).groupBy(*keys, subject, state).agg(F.avg(value).alias("__v"))
    a = cells.select(*keys, subject, F.col(state).alias("state_a"), F.col("__v").alias("__va"))
    b = cells.select(*keys, subject, F.col(state).alias("state_b"), F.col("__v").alias("__vb"))
    pairs = a.join(b, [*keys, subject]).where("state_a < state_b")
    diff = F.col("__vb") - F.col("__va")
    return pairs.groupBy(*keys, "state_a", "state_b").agg(
        F.count("*").alias("n_subjects"), F.avg("__va").alias("mean_state_a"), F.avg("__vb").alias("mean_state_b"), F.avg(diff).alias("mean_effect"), F.median(diff).alias("median_effect")
    )


def lag_peak(table: DataFrame, keys: list[str], *, lag: str, effect: str) -> DataFrame:
    """The lag of the largest effect (least on ties), and how far around it effects stay at half of it or more.

    A peak that isn't positive is its own threshold. Lags are taken as consecutive.
    """
    w = Window.partitionBy(*keys)
    peak = F.max(effect).over(w)
    placed = table.withColumn("__pe", peak)
    placed = placed.withColumn("__at", F.min(F.when(F.col(effect) == F.col("__pe"), F.col(lag))).over(w))
    low = F.col(effect) < F.when(F.col("__pe") > 0, F.col("__pe") * 0.5).otherwise(F.col("__pe"))
    right = F.coalesce(F.min(F.when(low & (F.col(lag) > F.col("__at")), F.col(lag))) - 1, F.max(lag))
    left = F.coalesce(F.max(F.when(low & (F.col(lag) < F.col("__at")), F.col(lag))) + 1, F.min(lag))
    return placed.groupBy(*keys).agg(F.first("__at").alias("peak_lag_samples"), F.first("__pe").alias("peak_effect"), (right - left).alias("peak_width_samples"), F.count("*").alias("n_lags"))


def event_adjusted_effect(around: DataFrame, keys: list[str], *, y: str, x: str, offset: str = "offset_samples") -> DataFrame:
    """Mean of ``y`` before and from the event on, at the mean of ``x``: a regression on both, as sums over the two sides."""
    side = around.withColumn("__post", F.col(offset) >= 0).groupBy(*keys, "__post").agg(F.count("*").alias("n"), F.avg(y).alias("y"), F.avg(x).alias("x"), (F.covar_pop(y, x) * F.count("*")).alias("sxy"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    at = lambda c, post: F.max(F.when(F.col("__post") == post, F.col(c)))
    both = side.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"), F.coalesce(F.try_divide(F.sum("sxy"), F.nullif(F.sum("sxx"), F.lit(0.0))), F.lit(0.0)).alias("b"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("c"),
        at("y", False).alias("y0"), at("x", False).alias("x0"), at("y", True).alias("y1"), at("x", True).alias("x1"), F.count("*").alias("k"),
    ).where("k = 2")
    return both.select(*keys, "n_samples", F.expr("y0 - b * (x0 - c)").alias("pre_value"), F.expr("y1 - b * (x1 - c)").alias("post_value"), F.expr("y1 - y0 - b * (x1 - x0)").alias("effect_mean_diff"), F.col("b").alias("gfp_beta"))


def _ordinal(table: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with their place in sorted order, those without enough support included: it is added to the seed."""
    known = table.dropna(subset=keys).select(*keys).distinct()  # group keys: a few rows
    return known.withColumn("__seed", F.row_number().over(Window.orderBy(*keys)) - 1)


def _with_sign_flips(values: DataFrame, keys: list[str], seed: int, min_subjects: int, *, value: str = "value") -> DataFrame:
    """keys, n_subjects, mean_effect, median_effect, p_perm of rows (keys, __seed, __order, value)."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("__order")[value].to_numpy(float)
        if len(x) < min_subjects:
            return pd.DataFrame({"n_subjects": [], "mean_effect": [], "median_effect": [], "p_perm": []})
        return pd.DataFrame({"n_subjects": [len(x)], "mean_effect": [x.mean()], "median_effect": [np.median(x)], "p_perm": [K.sign_flip_p(x, seed + int(part["__seed"].iloc[0]))]})

    return K.grouped(values, keys, "n_subjects long, mean_effect double, median_effect double, p_perm double", kernel)


def posthoc(table: DataFrame, keys: list[str], *, subject: str, state: str, value: str, seed: int, min_subjects: int) -> DataFrame:
    """``pair_differences`` with sign-flip p-values and their q."""
    known = table.where(F.col(value).isNotNull())
    cells = known.groupBy(*keys, subject, state).agg(F.avg(value).alias("__v"))
    a = cells.select(*keys, subject, F.col(state).alias("state_a"), F.col("__v").alias("__va"))
    b = cells.select(*keys, subject, F.col(state).alias("state_b"), F.col("__v").alias("__vb"))
    states = known.select(state).distinct()
    pair = states.select(F.col(state).alias("state_a")).join(F.broadcast(states.select(F.col(state).alias("state_b"))), F.col("state_a") < F.col("state_b"))
    pair = pair.withColumn("__pair", F.row_number().over(Window.orderBy("state_a", "state_b")) - 1)  # pairs of a few states
    rows = a.join(b, [*keys, subject]).where("state_a < state_b").join(F.broadcast(pair), ["state_a", "state_b"]).join(F.broadcast(_ordinal(known, keys)), keys)
    by = [*keys, "state_a", "state_b"]
    values = rows.select(*by, F.col(subject).alias("__order"), (F.col("__seed") * 31 + F.col("__pair")).alias("__seed"), (F.col("__vb") - F.col("__va")).alias("value"))
    means = rows.groupBy(*by).agg(F.avg("__va").alias("mean_state_a"), F.avg("__vb").alias("mean_state_b"))
    return benjamini_hochberg(_with_sign_flips(values, by, seed, min_subjects).join(means, by), [], tie=by)


def omnibus(table: DataFrame, keys: list[str], *, subject: str, state: str, value: str, states: list[int], seed: int, min_subjects: int) -> DataFrame:
    """F of states within subjects that have all states, with a permutation p, the means of the states, and q."""
    cells = table.where(F.col(value).isNotNull()).groupBy(*keys, subject).pivot(state, states).agg(F.avg(value))
    whole = cells.dropna(subset=[str(s) for s in states]).join(F.broadcast(_ordinal(table, keys)), keys)
    names = [f"mean_state_{s}" for s in states]

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        matrix = part.sort_values(subject)[[str(s) for s in states]].to_numpy(float)
        if len(matrix) < min_subjects:
            return pd.DataFrame({c: [] for c in ("n_subjects", "statistic", "p_perm", *names)})
        row = {"n_subjects": len(matrix), "statistic": K.within_f(matrix), "p_perm": K.within_permutation_p(matrix, seed + int(part["__seed"].iloc[0]))}
        return pd.DataFrame([row | dict(zip(names, matrix.mean(axis=0), strict=True))])

    schema = "n_subjects long, statistic double, p_perm double, " + ", ".join(f"{n} double" for n in names)
    return benjamini_hochberg(K.grouped(whole, keys, schema, kernel), [], tie=keys)


def connectivity_groups(effects: DataFrame, keys: list[str], *, seed: int, min_subjects: int, subject: str = "patient_id", value: str = "effect_mean_diff") -> DataFrame:
    """Sign-flip statistics of connectivity effects with the mean connectivity inside and outside the state, and q."""
    known = effects.where(F.col(value).isNotNull())
    values = known.join(F.broadcast(_ordinal(effects, keys)), keys).select(*keys, F.col(subject).alias("__order"), "__seed", F.col(value).alias("value"))
    means = known.groupBy(*keys).agg(F.avg("state_connectivity").alias("mean_state_connectivity"), F.avg("off_connectivity").alias("mean_off_connectivity"))
    return benjamini_hochberg(_with_sign_flips(values, keys, seed, min_subjects).join(means, keys), [], tie=keys)


def paired_tests(table: DataFrame, keys: list[str], *, subject: str, level: str, value: str) -> DataFrame:
    """``compare.paired_t`` with two-sided p-values and their q over all rows."""
    rows = paired_t(table, keys, subject=subject, level=level, value=value)

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([K.t_two_sided(a, int(b) - 1) if pd.notna(a) else None for a, b in zip(t, n, strict=True)], dtype="float64")

    return benjamini_hochberg(rows.withColumn("p_value", p("t", "n")), [], p="p_value", tie=[*keys, "level_a", "level_b"])


def archetype_null(similarity: DataFrame, *, subject: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """Likeness of the observed assignment and of every other one, and their spread by archetype and source.

    ``similarity``: subject, field_state, assigned_archetype, likeness (a value for each archetype); a few states a subject.
    """

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("field_state")
        table, own, states = np.stack(part["likeness"].to_numpy()), part["assigned_archetype"].to_numpy(), part["field_state"].to_numpy()
        null = K.permutation_null(table, own)
        at = np.arange(len(own))
        index = null[:, 0].astype(int)
        return pd.DataFrame({
            "field_state": np.append(states, states[index]), "assigned_archetype": np.append(own, null[:, 1].astype(int)),
            "assignment_similarity": np.append(table[at, own], null[:, 2]), "source": ["observed"] * len(own) + ["null"] * len(null), "permutation_id": np.append(np.full(len(own), -1), null[:, 3].astype(int)),
        })

    long = K.grouped(similarity, [subject], "field_state long, assigned_archetype long, assignment_similarity double, source string, permutation_id long", kernel)
    v = F.col("assignment_similarity")
    made = (F.count("*").alias("n_rows"), F.avg(v).alias("mean_similarity"), F.median(v).alias("median_similarity"), F.percentile(v, 0.05).alias("q05_similarity"), F.percentile(v, 0.95).alias("q95_similarity"))
    return long, long.groupBy("assigned_archetype", "source").agg(*made)
