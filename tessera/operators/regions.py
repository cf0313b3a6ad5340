"""Channel names, atlas labels and region aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel names that others replace.
ALIASES = {"FP1": "Fp1", "FP2": "Fp2", "T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
# The channels a recording needs.
STANDARD = ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "Cz")


def canonical_channel(name: Column) -> Column:
    """Trimmed and upper-cased, with aliases; two letters that end in Z are written like Cz."""
    upper = F.upper(F.trim(name))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, upper), F.when(upper.rlike("^[A-Z]{1,2}Z$"), F.initcap(upper)).otherwise(upper))


def coverage(present: Column, required: tuple[str, ...] = STANDARD) -> Column:
    """Present, missing and extra channels of an array, and whether nothing is missing."""
    need = F.array(*map(F.lit, required))
    missing = F.array_except(need, present)
    return F.struct(F.array_intersect(need, present).alias("present"), missing.alias("missing"), F.array_sort(F.array_except(present, need)).alias("extra"), (F.size(missing) == 0).alias("covers"))


def inventory(channels: DataFrame, keys: list[str], *, channel: str = "channel", required: tuple[str, ...] = STANDARD) -> DataFrame:
    """Canonical channels of each recording, those required that are missing, others, and whether all required are there."""
    named = channels.select(*keys, canonical_channel(F.col(channel)).alias("__c"))
    held = named.groupBy(*keys).agg(F.array_sort(F.collect_set("__c")).alias("channels"))
    return held.select("*", coverage(F.col("channels"), required).alias("coverage"))


def picked(signals: DataFrame, order: tuple[str, ...], *, channel: str = "channel") -> DataFrame:
    """Signals of the listed channels, with their place in the list."""
    name = canonical_channel(F.col(channel))
    at = F.array_position(F.array(*map(F.lit, order)), name)
    return signals.withColumns({channel: name, "channel_order": (at - 1).cast("int")}).where("channel_order >= 0")


def clean_label(label: Column, parcellation: str) -> Column:
    """Null for missing labels; for network parcellations the part before the first space and underscore."""
    known = F.when(F.upper(F.trim(label)).isin("", "N/A"), None).otherwise(F.trim(label))
    return F.split_part(F.split_part(known, F.lit(" "), F.lit(1)), F.lit("_"), F.lit(1)) if parcellation in ("yeo7", "yeo17") else known


def contacts(channel: Column) -> Column:
    """The two contacts of a bipolar name, split at the first hyphen; null without one."""
    at = F.instr(channel, "-")
    return F.when(at > 0, F.struct(F.trim(F.substring_index(channel, "-", 1)).alias("a"), F.trim(F.substring(channel, at + 1, F.length(channel))).alias("b")))


def same_region_map(channels: DataFrame, atlas: DataFrame, keys: list[str], *, parcellation: str = "aal3") -> DataFrame:
    """Region of each bipolar channel: that of both contacts, where they agree. Of repeated atlas contacts the last counts.

    ``channels``: keys, bipolar_channel; ``atlas``: keys, contact, label, position.
    """
    last = Window.partitionBy(*keys, "contact").orderBy(F.desc("position"))
    lookup = atlas.withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*keys, "contact", clean_label(F.col("label"), parcellation).alias("region"))
    side = lambda s: lookup.select(*keys, F.col("contact").alias(f"contact_{s}"), F.col("region").alias(f"region_{s}"))
    split = channels.withColumn("__c", contacts(F.col("bipolar_channel"))).where(F.col("__c").isNotNull())
    split = split.select(*keys, "bipolar_channel", F.col("__c.a").alias("contact_a"), F.col("__c.b").alias("contact_b"))
    found = split.join(side("a"), [*keys, "contact_a"], "left").join(side("b"), [*keys, "contact_b"], "left")
    valid = F.coalesce(F.col("region_a") == F.col("region_b"), F.lit(False))
    return found.select(*keys, "bipolar_channel", "contact_a", "contact_b", "region_a", "region_b", F.when(valid, F.col("region_a")).alias("region"), valid.alias("valid_same_region"))


def region_signals(signals: DataFrame, mapping: DataFrame, keys: list[str], *, channel: str = "channel", order: str = "sample") -> DataFrame:
    """Mean of a region's valid channels at each sample; nulls are left out."""
    valid = mapping.where(F.col("region").isNotNull()).select(*[k for k in keys if k in mapping.columns], channel, "region").distinct()
    return signals.join(valid, [*[k for k in keys if k in mapping.columns], channel]).groupBy(*keys, "region", order).agg(F.avg("value").alias("value"))


def region_coverage(mapping: DataFrame, keys: list[str], *, channel: str = "channel") -> DataFrame:
    """Distinct channels of each region."""
    return mapping.where(F.col("region").isNotNull()).groupBy(*keys, "region").agg(F.countDistinct(channel).alias("n_bipolar_channels"))
