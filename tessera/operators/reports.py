"""Tables of the report layer: summaries with their support, layouts, unions and display rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The networks of a report, in the order in which it shows them.
YEO17_ORDER = (
    "VisCent", "VisPeri", "SomMotA", "SomMotB", "DorsAttnA", "DorsAttnB", "SalVentAttnA", "SalVentAttnB", "LimbicA", "LimbicB", "ContA", "ContB", "ContC", "DefaultA", "DefaultB", "DefaultC", "TempPar",
)
UNMAPPED = "Unmapped"
#: Rows that one sheet of a workbook holds.
SHEET_ROWS = 1_048_576


def finite(value: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def numbers(table: DataFrame, keys: list[str], *, value: str, name: str, subject: str) -> DataFrame:
    """Subjects and mean, deviation, median, quartiles, least and greatest value by key; what isn't finite doesn't count."""
    v = finite(F.col(value))
    made = (("mean", F.avg(v)), ("sd", F.stddev_samp(v)), ("median", F.median(v)), ("q1", F.percentile(v, 0.25)), ("q3", F.percentile(v, 0.75)), ("min", F.min(v)), ("max", F.max(v)))
    return table.groupBy(*keys).agg(F.countDistinct(subject).alias("n_patients"), *(c.alias(f"{kind}_{name}") for kind, c in made))


def loading_support(loadings: DataFrame, keys: list[str], *, value: str = "loading") -> DataFrame:
    """Support, mean, deviation (of two values at least) and median of the finite loadings; keys without any stay."""
    v = finite(F.col(value))
    return loadings.groupBy(*keys).agg(F.count(v).alias("n_support"), F.avg(v).alias("mean_loading"), F.stddev_samp(v).alias("sd_loading"), F.median(v).alias("median_loading"))


def stage_loadings(loadings: DataFrame, keys: list[str], *, patient: str = "patient_id", segment: str = "segment_id") -> DataFrame:
    """Patients, segments, and the mean loading and weighted loading by key."""
    return loadings.groupBy(*keys).agg(F.countDistinct(patient).alias("n_patients"), F.countDistinct(segment).alias("n_segments"), F.avg(finite(F.col("loading_value"))).alias("mean_loading"), F.avg(finite(F.col("weighted_loading"))).alias("mean_weighted_loading"))


def model_order_groups(subjects: DataFrame, keys: list[str], *, retained: int, values: list[str], states: str = "n_states", subject: str = "patient_id") -> DataFrame:
    """Mean and median of each measure over subjects, by parameters; null and NaN don't count, and a measure without values is null."""
    v = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    aggregates = [f(v(c)).alias(f"{kind}_{c}") for c in values for kind, f in (("mean", F.avg), ("median", F.median))]
    return subjects.groupBy(*keys, states).agg(F.countDistinct(subject).alias("n_subjects"), *aggregates).withColumn("retained_main_text_default", F.col(states) == retained)


def long_measures(table: DataFrame, keys: list[str], labels: dict[str, str], *, skip_null: tuple[str, ...] = ()) -> DataFrame:
    """A row for each measure (column: label) of each row; nulls of the measures in ``skip_null`` drop out."""
    long = table.unpivot(keys, list(labels), "__measure", "value")
    named = F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col("__measure"))
    return long.where(F.col("value").isNotNull() | ~F.col("__measure").isin(*skip_null)).select(*keys, named.alias("metric_label"), "value")


def tagged_union(families: dict[str, DataFrame], *, tag: str = "family") -> DataFrame:
    """All rows of several tables, with their family's name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in families.items()))


def with_support(table: DataFrame, support: DataFrame, keys: list[str], *, suffix: str = "_support") -> DataFrame:
    """Rows with those of a support table (null without one); its columns that the table has already get a suffix."""
    renamed = support.select(*keys, *(F.col(c).alias(c + suffix if c in table.columns else c) for c in support.columns if c not in keys))
    return table.join(renamed, keys, "left")


def with_means(groups: DataFrame, subjects: DataFrame, keys: list[str], means: dict[str, str]) -> DataFrame:
    """Group rows with the means over subjects of some columns (column: name of its mean)."""
    return groups.join(subjects.groupBy(*keys).agg(*(F.avg(c).alias(name) for c, name in means.items())), keys, "left")


def display_transitions(table: DataFrame, *, order: list[Column], kind: str = "response_kind") -> DataFrame:
    """The any-switch rows of a table that has some; of one without, the first row of each pair of states."""
    plain = F.lower(F.btrim(F.col(kind))) == "any-switch"
    any_switch = table.agg(F.coalesce(F.bool_or(plain), F.lit(False)).alias("__any"))  # one row
    first = F.row_number().over(Window.partitionBy("from_state", "to_state").orderBy(*order))
    marked = table.crossJoin(F.broadcast(any_switch)).withColumn("__first", first)
    return marked.where(F.when(F.col("__any"), plain).otherwise(F.col("__first") == 1)).drop("__any", "__first")


def surviving(assignments: DataFrame, archetypes: DataFrame, *, state: str = "field_state", assigned: str = "assigned_archetype") -> DataFrame:
    """Assignments to archetypes that the support filter left."""
    kept = archetypes.select(F.col(state).alias("__kept")).distinct()
    return assignments.join(kept, F.col(assigned) == F.col("__kept"), "left_semi")


def network_rank(region: Column, order: tuple[str, ...] = YEO17_ORDER) -> Column:
    """Place in the order; networks that it lacks follow, unmapped ones come last."""
    at = F.array_position(F.array(*map(F.lit, order)), region)
    return F.when(region == UNMAPPED, F.lit(len(order) + 1)).when(at > 0, (at - 1).cast("int")).otherwise(F.lit(len(order)))


def channel_layout(channels: DataFrame, mapping: DataFrame, keys: list[str], *, channel: str = "bipolar_channel", order: tuple[str, ...] = YEO17_ORDER) -> DataFrame:
    """Every channel with its region, in display order; without one it is unmapped and not valid."""
    joined = channels.join(mapping.select(*keys, channel, "region", "valid_same_region"), [*keys, channel], "left")
    filled = joined.withColumns({"region": F.coalesce("region", F.lit(UNMAPPED)), "valid_same_region": F.coalesce("valid_same_region", F.lit(False))})
    place = Window.partitionBy(*keys).orderBy(network_rank(F.col("region"), order), "region", channel)
    return filled.withColumn("channel_order", F.row_number().over(place) - 1)


def exported_layout(layout: DataFrame, keys: list[str]) -> DataFrame:
    """The channels with a region if a key has two or more of them, else all of its channels; renumbered, and which it was."""
    mapped = F.count_if("valid_same_region").over(Window.partitionBy(*keys)) >= 2
    kept = layout.withColumn("mapped_only", mapped).where(~F.col("mapped_only") | F.col("valid_same_region"))
    return kept.withColumn("channel_order", F.row_number().over(Window.partitionBy(*keys).orderBy("channel_order")) - 1)


def coverage_tables(mapping: DataFrame, retained: DataFrame, order: tuple[str, ...], *, patient: str = "patient_id", channel: str = "bipolar_channel") -> tuple[DataFrame, DataFrame]:
    """Channels of each network by patient (0 where it has none) with their share in per cent; and a summary by patient.

    ``mapping``: patient, channel, region, valid_same_region; ``retained``: patient, retained_bipolar_channels. A network
    of the data that ``order`` lacks is added to the grid.
    """
    valid = mapping.where("valid_same_region")
    counts = valid.where("region IS NOT NULL").groupBy(patient, F.col("region").alias("network")).agg(F.countDistinct(channel).alias("n_bipolar_channels"))
    known = mapping.sparkSession.createDataFrame([(n,) for n in order], "network string")
    networks = known.union(counts.select("network")).distinct()  # the names of an atlas
    grid = retained.crossJoin(F.broadcast(networks)).join(counts, [patient, "network"], "left")
    n = F.coalesce(F.col("n_bipolar_channels"), F.lit(0))
    long = grid.select(patient, "network", n.cast("long").alias("n_bipolar_channels"), F.try_divide(n * 100.0, "retained_bipolar_channels").alias("coverage_pct"))
    background = valid.groupBy(patient).agg(F.count_if(F.col("region").isNull()).alias("__b"))
    totals = counts.groupBy(patient).agg(F.sum("n_bipolar_channels").alias("__m"), F.count("*").alias("__c"))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    summary = retained.join(totals, patient, "left").join(background, patient, "left").select(*retained.columns, zero("__m", "mapped_bipolar_channels"), zero("__c", "covered_networks"), zero("__b", "background_channels"))
    return long, summary


def network_totals(coverage: DataFrame, *, network: str = "network", count: str = "n_bipolar_channels") -> DataFrame:
    """Patients with coverage, and total, mean, median and greatest channel count of each network."""
    n = F.col(count)
    return coverage.groupBy(network).agg(F.count_if(n > 0).alias("n_patients_with_coverage"), F.sum(n).alias("total_bipolar_channels"), F.avg(n).alias("mean_patient_channels"), F.median(n).alias("median_patient_channels"), F.max(n).alias("max_patient_channels"))


def region_support(layout: DataFrame, keys: list[str], *, channel: str = "bipolar_channel") -> DataFrame:
    """Distinct channels and rows with a valid region, by region."""
    return layout.groupBy(*keys).agg(F.countDistinct(channel).alias("n_bipolar_channels"), F.count_if("valid_same_region").alias("n_valid_same_region"))


def touchpoints(contacts: DataFrame, networks: tuple[str, ...], *, patient: str = "patient_id", network: str = "network", side: str = "hemi") -> tuple[DataFrame, DataFrame]:
    """Contacts and patients of every listed network (0 where none); and contacts, mapped share and networks of each patient."""
    mapped = F.col(network).isin(*networks) & F.col(side).isNotNull()
    names = contacts.sparkSession.createDataFrame([(n,) for n in networks], f"{network} string")
    found = contacts.where(mapped).groupBy(network).agg(F.count("*").alias("n_contacts"), F.countDistinct(patient).alias("n_patients"))
    by_network = names.join(found, network, "left").fillna(0, ["n_contacts", "n_patients"])
    n, m = F.count("*"), F.count_if(F.coalesce(mapped, F.lit(False)))
    by_patient = contacts.groupBy(patient).agg(n.alias("total_contacts"), m.alias("mapped_contacts"), (m / n).alias("mapped_fraction"), F.countDistinct(network).alias("n_networks"))
    return by_network, by_patient


def representatives(maps: DataFrame, n: int, *, state: str = "assigned_archetype", patient: str = "patient_id") -> DataFrame:
    """The first ``n`` patients with a map of every state, by least and mean support; of all patients if none has every."""
    expected = maps.agg(F.countDistinct(state).alias("__expected"))  # one row
    per = maps.groupBy(patient).agg(F.countDistinct(state).alias("n_archetypes_present"), F.sum("n_samples").alias("total_conditioned_samples"), F.min("n_samples").alias("min_conditioned_samples"), F.avg("assignment_similarity").alias("mean_assignment_similarity"))
    marked = per.crossJoin(F.broadcast(expected)).withColumn("complete_archetype_panel", F.col("n_archetypes_present") == F.col("__expected")).drop("__expected")
    best = [F.desc(c) for c in ("complete_archetype_panel", "min_conditioned_samples", "mean_assignment_similarity", "total_conditioned_samples")] + [F.asc(patient)]
    top = marked.orderBy(*best).limit(n)  # complete patients sort first: the first n hold any that there are
    first = Window.orderBy(*best)  # over those n rows
    ranked = top.withColumns({"representative_rank": F.row_number().over(first), "__any": F.max("complete_archetype_panel").over(Window.partitionBy(F.lit(0)))})
    return ranked.where(F.col("complete_archetype_panel") | ~F.col("__any")).drop("__any")


def density_grid(points: DataFrame, *, x: str, y: str, width: float, low: float, high: float, cells: int = 120) -> DataFrame:
    """Gaussian density of points on a square grid, over its maximum: (i, j, density).

    Points are first counted in the grid's cells, so what is joined with the grid is bounded by it, not by the points.
    """
    step = (high - low) / (cells - 1)
    near = lambda c: F.rint((F.col(c) - F.lit(low)) / F.lit(step)).cast("int")
    counted = points.select(near(x).alias("p"), near(y).alias("q")).where(f"p BETWEEN 0 AND {cells - 1} AND q BETWEEN 0 AND {cells - 1}").groupBy("p", "q").agg(F.count("*").alias("n"))
    weight = lambda a, b: F.exp(-0.5 * F.pow((F.col(a) - F.col(b)) * F.lit(step / width), 2))
    spread = lambda a: F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(a)
    # The kernel is a product: one axis after the other.
    rows = counted.select("*", spread("i")).groupBy("i", "q").agg(F.sum(F.col("n") * weight("i", "p")).alias("n"))
    grid = rows.select("*", spread("j")).groupBy("i", "j").agg(F.sum(F.col("n") * weight("j", "q")).alias("density"))
    return grid.crossJoin(F.broadcast(grid.agg(F.max("density").alias("__m")))).select("i", "j", (F.col("density") / F.col("__m")).alias("density"))


def scaled_waveforms(signals: DataFrame, keys: list[str], *, value: str = "value", quantile: float = 0.98, most: float = 1.45) -> DataFrame:
    """Values over the quantile of their magnitudes by key (1 where that is 0), clipped."""
    scale = signals.groupBy(*keys).agg(F.percentile(F.abs(value), quantile).alias("__s"))
    shown = F.col(value) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(1.0))
    return signals.join(scale, keys).withColumn("display_value", F.greatest(F.least(shown, F.lit(most)), F.lit(-most))).drop("__s")


def segment_matrix(signals: DataFrame, samples: list[int], *, channel: str = "channel", value: str = "value", order: str = "sample") -> DataFrame:
    """A row for each channel and for the spread and root mean square over channels; a column for each sample."""
    rows = signals.select(F.col(channel).cast("string").alias("row_name"), order, value)
    across = signals.groupBy(order).agg(F.stddev_pop(value).alias("spatial_std_raw"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms_raw")).unpivot([order], ["spatial_std_raw", "rms_raw"], "row_name", value)
    wide = rows.unionByName(across).groupBy("row_name").pivot(order, samples).agg(F.first(value))
    return wide.select("row_name", *(F.col(str(s)).alias(f"point_{i:05d}") for i, s in enumerate(samples)))


def key_values(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, content): the other columns as rows of text."""
    rest = [c for c in table.columns if c not in keys]
    return table.select(*keys, *(F.col(c).cast("string").alias(c) for c in rest)).unpivot(keys, rest, "field", "content")


def for_output(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in their declared order, for the sink only."""
    return table.orderBy(*keys)


def check_sheet(table: DataFrame, name: str, most: int = SHEET_ROWS) -> DataFrame:
    """The table, if a sheet can hold it with its header; else ValueError. Counts no further than that."""
    if table.limit(most).count() >= most:
        raise ValueError(f"{name} has more rows than a sheet holds ({most - 1})")
    return table
