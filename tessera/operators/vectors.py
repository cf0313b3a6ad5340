"""Channel vectors in long form (keys, sample, channel, value) and as arrays in channel order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.asof import interval_join
from tessera.operators.gram import connectivity, connectivity_on_off  # noqa: F401
from tessera.operators.kernels import pair_connectivity


def field_power(signals: DataFrame, keys: list[str], *, order: str = "sample", metric: str = "spatial-std") -> DataFrame:
    """Power of each sample across channels: population deviation, or root mean square."""
    value = {"spatial-std": F.stddev_pop("value"), "rms": F.sqrt(F.avg(F.col("value") * F.col("value")))}[metric]
    return signals.groupBy(*keys, order).agg(value.alias("power"), F.count("value").alias("n_channels"))


def normalise_channels(signals: DataFrame, keys: list[str], *, strategy: str = "zscore", channel: str = "channel") -> DataFrame:
    """Each channel over time: z-score (population), or median and scaled median absolute deviation.

    A scale of 0 counts as 1, what isn't finite becomes 0. Statistics are aggregates joined back, so a channel's samples
    never meet in one task for the z-score.
    """
    by = [*keys, channel]
    if strategy == "zscore":
        stats = signals.groupBy(*by).agg(F.avg("value").alias("__c"), F.stddev_pop("value").alias("__s"))
    else:
        center = signals.groupBy(*by).agg(F.median("value").alias("__c"))
        spread = signals.join(center, by).groupBy(*by).agg((F.lit(1.4826) * F.median(F.abs(F.col("value") - F.col("__c")))).alias("__s"))
        stats = center.join(spread, by)
    scale = F.when(F.coalesce("__s", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("__s"))
    score = F.coalesce((F.col("value") - F.col("__c")) / scale, F.lit(0.0))
    return signals.join(stats, by).withColumn("value", F.when(F.isnan(score), F.lit(0.0)).otherwise(score)).drop("__c", "__s")


def valid_channels(signals: DataFrame, keys: list[str], *, channel: str = "channel") -> DataFrame:
    """Signals of channels that vary, in keys with at least two such channels."""
    varying = signals.groupBy(*keys, channel).agg(F.stddev_pop("value").alias("__s")).where("__s > 0")
    enough = varying.withColumn("__k", F.count("*").over(Window.partitionBy(*keys))).where("__k >= 2").select(*keys, channel)
    return signals.join(enough, [*keys, channel], "left_semi")


def to_arrays(signals: DataFrame, keys: list[str], *, order: str = "sample", channel: str = "channel", name: str = "pattern") -> DataFrame:
    """One array in channel order for each sample."""
    pairs = F.array_sort(F.collect_list(F.struct(channel, "value")))
    return signals.groupBy(*keys, order).agg(F.transform(pairs, lambda x: x["value"]).alias(name))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def unit_pattern(a: Column) -> Column:
    """The array less its mean, over its norm; all 0 where that is 0."""
    centred = lambda v: let(_sum(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
    scaled = lambda c: let(F.sqrt(dot(c, c)), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return let(a, lambda v: let(centred(v), scaled))


def oriented(a: Column) -> Column:
    """The array with the sign that makes its largest magnitude positive, the first on ties."""

    def turned(v: Column) -> Column:
        sizes = F.transform(v, F.abs)
        sign = let(sizes, lambda m: F.when(F.get(v, F.array_position(m, F.array_max(m)).cast("int") - 1) < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
        return let(sign, lambda s: F.transform(v, lambda x: x * s))

    return let(a, turned)


def similarity(a: Column, b: Column) -> Column:
    """Absolute dot product of two unit patterns."""
    return F.abs(dot(a, b))


def backfit(samples: DataFrame, templates: DataFrame, keys: list[str], *, order: str = "sample") -> DataFrame:
    """The template most like each sample (the first on ties) and the likeness; ``templates``: keys, state, template."""
    on = [c for c in keys if c in templates.columns]
    # A few templates of a key travel as one array: the best is found in a projection, without a row for each pair.
    packed = templates.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("state", "template"))).alias("__t"))
    joined = samples.join(packed, on) if on else samples.crossJoin(F.broadcast(packed))  # one row
    scored = F.transform("__t", lambda t: F.struct(similarity(F.col("pattern"), t["template"]).alias("corr"), (-t["state"]).alias("state")))
    best = joined.select(*keys, order, F.array_max(scored).alias("__best"))
    return best.select(*keys, order, (-F.col("__best.state")).alias("state"), F.col("__best.corr").alias("corr"))


def weighted_power(signals: DataFrame, keys: list[str], *, weight: str = "weight", order: str = "sample") -> DataFrame:
    """Weighted root mean square and weighted deviation across series."""
    w, x = F.col(weight), F.col("value")
    total, mean = F.sum(w), F.sum(w * x) / F.sum(w)
    square = F.sum(w * x * x) / total
    return signals.groupBy(*keys, order).agg(F.sqrt(square).alias("weighted_rms"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("weighted_std"), F.count("*").alias("n_series"))


def channel_weight(count: Column, strategy: str) -> Column:
    """Equal weights, or the root of the channel count (at least 1)."""
    return F.lit(1.0) if strategy == "equal" else F.sqrt(F.greatest(count.cast("double"), F.lit(1.0)))


def mean_pattern(samples: DataFrame, keys: list[str], *, min_subjects: int | None = None, subject: str = "patient_id", channel: str = "channel") -> DataFrame:
    """Mean value by channel, as an oriented unit pattern; with ``min_subjects`` only where so many subjects have samples."""
    per = samples.groupBy(*keys, channel).agg(F.avg("value").alias("value"), F.countDistinct(subject).alias("__s"), F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(channel, "value")))
    made = per.groupBy(*keys).agg(F.transform(pairs, lambda x: x["value"]).alias("__m"), F.max("__s").alias("n_subjects"), F.max("__n").alias("n_samples"))
    if min_subjects is not None:
        made = made.where(F.col("n_subjects") >= min_subjects)
    return made.select(*keys, oriented(unit_pattern(F.col("__m"))).alias("map"), "n_subjects", "n_samples")


def event_locked_connectivity(signals: DataFrame, events: DataFrame, keys: list[str], event_keys: list[str], *, window: float, min_samples: int, method: str = "corr", series: str = "region", time: str = "time_sec", event: str = "event_sec") -> DataFrame:
    """Connectivity in [event, event + window) against [event - window, event), as means over the events of a kind.

    Events with under ``min_samples`` times on a side don't count, nor do pairs not defined on both sides.
    """
    if method not in ("corr", "plv", "wpli"):
        raise ValueError(f"unknown method {method}")
    w = F.lit(float(window))
    asked = events.select(*keys, *event_keys, F.col(event).alias("__at"), (F.col(event) - w).alias("__lo"), (F.col(event) + w).alias("__hi")).withColumn("__event", F.monotonically_increasing_id())
    held = interval_join(signals.select(*keys, F.col(time).alias("__t"), F.col(series).alias("__s"), "value"), asked, keys, width=2 * window, time="__t", start="__lo", end="__hi")
    rows = held.groupBy(*keys, *event_keys, "__event", "__at").agg(F.collect_list("__t").alias("__t"), F.collect_list("__s").alias("__s"), F.collect_list("value").alias("value"))
    names = [*keys, *event_keys]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(parts):
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                given = dict(zip(part.columns, row, strict=True))
                times, i = np.unique(np.asarray(given["__t"], float), return_inverse=True)
                labels, j = np.unique(np.asarray(given["__s"]), return_inverse=True)
                table = np.full((len(times), len(labels)), np.nan)
                table[i, j] = given["value"]
                pre, post = table[times < given["__at"]], table[times >= given["__at"]]
                if min(len(pre), len(post)) < max(2, min_samples):
                    continue
                a, b = pair_connectivity(post, method), pair_connectivity(pre, method)
                out += [(*(given[c] for c in names), labels[x], labels[y], a[x, y], b[x, y], len(post), len(pre)) for x, y in zip(*np.nonzero(~np.isnan(a) & ~np.isnan(b)), strict=True)]
            yield pd.DataFrame(out, columns=[*names, "region_a", "region_b", "__a", "__b", "__na", "__nb"])

    each = rows.mapInPandas(run, f"{head}, region_a string, region_b string, __a double, __b double, __na long, __nb long")
    return each.groupBy(*names, "region_a", "region_b").agg(
        F.count("*").alias("n_events"), F.avg("__a").alias("state_connectivity"), F.avg("__b").alias("off_connectivity"), F.avg(F.col("__a") - F.col("__b")).alias("effect_mean_diff"), F.avg("__na").alias("n_state_samples"), F.avg("__nb").alias("n_nonstate_samples")
    )
