"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, join_classes, materialize


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. ``nodes`` has node, ``links`` a and b.

    Each round gives every node the least label among its neighbours' and its own, then lets labels follow labels.
    Labels only fall; a round without change ends it. Neighbours' labels are combined before each shuffle, and labels of
    many nodes are joined by broadcast.
    """
    links = materialize(links.select("a", "b"))  # read twice below: both directions of the same rows
    both = materialize(links.union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    discard(links)
    label = materialize(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = materialize(label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid")))
        uses = lower.groupBy("mid").agg(F.count("*").alias("uses"))
        jump = materialize(lower.select(F.col("node").alias("mid"), F.col("mid").alias("far")).where("far < mid").join(uses, "mid"))
        far = join_classes(lower, jump, ["mid"], "uses").select("node", F.coalesce("far", "mid").alias("component"), (F.col("old") != F.coalesce("far", "mid")).alias("changed"))
        new = materialize(far)
        discard(label, lower, jump)
        label = new
        if not new.where("changed").limit(1).count():
            discard(both)
            return new.select("node", "component")
