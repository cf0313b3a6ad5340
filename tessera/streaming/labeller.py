"""Live state labelling: an extension, since the batch engine has no streams of its own.

Labelling by fixed templates is a stateless projection, so it runs unchanged on a stream. Counts of states in event-time
windows come with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import similarity


def label_stream(samples: DataFrame, templates: DataFrame) -> DataFrame:
    """Samples (any columns, pattern) with the state of the most similar template and the likeness, without a shuffle.

    ``templates`` (state, template) is a handful of rows and becomes one array that is broadcast.
    """
    every = templates.agg(F.array_sort(F.collect_list(F.struct("state", "template"))).alias("__t"))
    scored = F.transform("__t", lambda t: F.struct(similarity(F.col("pattern"), t["template"]).alias("corr"), (-t["state"]).alias("minus")))
    best = F.array_max(scored)
    return samples.crossJoin(F.broadcast(every)).withColumn("__b", best).select(*samples.columns, (-F.col("__b.minus")).alias("state"), F.col("__b.corr").alias("corr"))


def windowed_counts(labelled: DataFrame, *, ts: str = "ts", keys: list[str], window: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Samples of each state in event-time windows; rows later than ``late`` are left out."""
    return labelled.withWatermark(ts, late).groupBy(*keys, F.window(ts, window), "state").agg(F.count("*").alias("n_samples")).select(*keys, F.col("window.start").alias("window_start"), "state", "n_samples")


