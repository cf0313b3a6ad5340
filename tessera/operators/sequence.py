"""Runs, events, transitions, occupancy and windows of labelled sequences.

Sequences are tables with key columns (patient, segment, parameters), a sample number, a time and a state. All functions
take every key at once. Runs are found in two levels, so that one long sequence is sorted by many tasks: first within
chunks of samples, then over the few rows that the chunks leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunks import CHUNK, chunk_of, edge_window, exact_median, neighbours


def runs(labels: DataFrame, keys: list[str], *, state: str = "microstate", order: str = "sample", time: str = "time_sec", chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of equal states: keys, run_id (0-based), state, start_sample, n_samples, start_sec, end_sec.

    ``order`` should be dense within a key for ``end_sec`` and chunks to mean what they say; null states are a state.
    Runs are found within chunks; the first and last ones of all chunks then tell how many runs begin before a chunk
    and whether its first one continues another.
    """
    cut = labels.select(*keys, F.col(order).alias("__o"), F.col(time).alias("__t"), F.col(state).alias("__s"), chunk_of(order, chunk).alias("__chunk"))
    local = Window.partitionBy(*keys, "__chunk").orderBy("__o")
    new = F.coalesce((~F.col("__s").eqNullSafe(F.lag("__s").over(local))).cast("int"), F.lit(0))
    first = F.row_number().over(local) == 1
    pieces = (
        cut.withColumn("__p", F.sum(F.when(first, 1).otherwise(new)).over(local))
        .groupBy(*keys, "__chunk", "__p")
        .agg(F.first("__s").alias("__s"), F.min("__o").alias("__o"), F.count("*").alias("__n"), F.min("__t").alias("__t0"), F.max("__t").alias("__t1"))
    )
    whole = Window.partitionBy(*keys, "__chunk")
    sized = pieces.withColumn("__m", F.max("__p").over(whole))
    head, tail = F.col("__p") == 1, F.col("__p") == F.col("__m")
    across = edge_window(keys, head | tail, "__chunk", "__o")
    # Only rows of the edge window count: the first piece of a chunk may continue the last one of the chunk before.
    joined = F.when(head & F.lag("__m").over(across).isNotNull() & F.col("__s").eqNullSafe(F.lag("__s").over(across)), 1).otherwise(0)
    placed = sized.withColumn("__joined", joined)
    begun = F.when(tail, F.col("__m")).otherwise(0) - F.col("__joined")
    before = F.coalesce(F.sum(begun).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__offset", F.when(head, before - F.col("__joined")))
    numbered = placed.withColumn("__offset", F.max("__offset").over(whole))
    return (
        numbered.withColumn("run_id", F.col("__offset") + F.col("__p") - 1)
        .groupBy(*keys, "run_id")
        .agg(F.first("__s").alias(state), F.min("__o").alias("start_sample"), F.sum("__n").alias("n_samples"), F.min("__t0").alias("start_sec"), F.max("__t1").alias("end_sec"))
    )


def sample_period(labels: DataFrame, keys: list[str], *, order: str = "sample", time: str = "time_sec", chunk: int = CHUNK) -> DataFrame:
    """Median of the first differences of time by key; 0 with fewer than two samples."""
    beside = neighbours(labels.select(*keys, F.col(order).alias("__at"), F.col(time).alias("__time")), keys, ["__time"], order="__at", chunk=chunk)
    steps = beside.select(*keys, (F.col("__time") - F.col("__time__before")).alias("__step"))
    return exact_median(steps, keys, "__step", "sample_period_sec", default=0.0)


def state_profile(labels: DataFrame, keys: list[str], *, state: str = "microstate", **options) -> DataFrame:
    """Occupancy, mean dwell (mean run length times period), samples and runs of each state."""
    period = sample_period(labels, keys, **{k: v for k, v in options.items() if k in ("order", "time")})
    per_state = runs(labels, keys, state=state, **options).groupBy(*keys, state).agg(F.sum("n_samples").alias("n_samples"), F.count("*").alias("n_runs"))
    total = F.sum("n_samples").over(Window.partitionBy(*keys))
    return (
        per_state.withColumn("occupancy", F.col("n_samples") / total)
        .join(period, keys)
        .withColumn("mean_dwell_sec", F.col("n_samples") / F.col("n_runs") * F.col("sample_period_sec"))
        .drop("sample_period_sec")
    )


def transitions(labels: DataFrame, keys: list[str], *, state: str = "microstate", **options) -> DataFrame:
    """One row for each pair of neighbouring runs; the event is the start of the later. Durations are last minus first time."""
    found = neighbours(runs(labels, keys, state=state, **options), keys, [state, "start_sec", "end_sec"], order="run_id")
    before = lambda c: F.col(f"{c}__before")
    return (
        found.withColumns({"from_state": before(state), "from_start_sec": before("start_sec"), "from_end_sec": before("end_sec")})
        .where(F.col("run_id") > 0)
        .select(
            *keys,
            (F.col("run_id") - 1).alias("transition_id"),
            F.col("start_sec").alias("event_sec"),
            "from_state",
            F.col(state).alias("to_state"),
            "from_start_sec",
            "from_end_sec",
            F.col("start_sec").alias("to_start_sec"),
            F.col("end_sec").alias("to_end_sec"),
            (F.col("from_end_sec") - F.col("from_start_sec")).alias("from_duration_sec"),
            (F.col("end_sec") - F.col("start_sec")).alias("to_duration_sec"),
        )
    )


def transition_profile(labels: DataFrame, keys: list[str], **options) -> DataFrame:
    """Counts of transitions and their shares among those that leave the same state."""
    counted = transitions(labels, keys, **options).groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("n_transitions"))
    leaving = F.sum("n_transitions").over(Window.partitionBy(*keys, "from_state"))
    return counted.withColumn("transition_probability", F.col("n_transitions") / leaving)


def dense_transition_matrix(labels: DataFrame, keys: list[str], *, state: str = "microstate", **options) -> DataFrame:
    """All pairs of states that occur, with zero counts; the probability is null where nothing leaves the state."""
    states = labels.select(state).distinct()
    grid = labels.select(*keys).distinct().crossJoin(F.broadcast(states.select(F.col(state).alias("from_state")))).crossJoin(F.broadcast(states.select(F.col(state).alias("to_state"))))
    counted = transitions(labels, keys, state=state, **options).groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("__n"))
    filled = grid.join(counted, [*keys, "from_state", "to_state"], "left").withColumn("n_transitions", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")
    leaving = F.sum("n_transitions").over(Window.partitionBy(*keys, "from_state"))
    return filled.withColumn("transition_probability", F.try_divide(F.col("n_transitions").cast("double"), leaving))


def boundary_events(labels: DataFrame, keys: list[str], *, state: str = "microstate", **options) -> DataFrame:
    """An onset and an offset row for each run, with the states before and after."""
    found = neighbours(runs(labels, keys, state=state, **options), keys, [state], order="run_id")
    wide = found.withColumns({"previous_state": F.col(f"{state}__before"), "next_state": F.col(f"{state}__after"), "duration_sec": F.col("end_sec") - F.col("start_sec")})
    both = F.explode(F.array(F.struct(F.lit("onset").alias("event_type"), F.col("start_sec").alias("event_sec")), F.struct(F.lit("offset").alias("event_type"), F.col("end_sec").alias("event_sec"))))
    return wide.withColumn("__e", both).select(*keys, F.col("run_id").alias("event_id"), "__e.event_type", "__e.event_sec", state, "previous_state", "next_state", "start_sec", "end_sec", "duration_sec", "n_samples")


def switch_indicator(labels: DataFrame, keys: list[str], *, state: str, order: str = "sample", name: str = "switch_indicator", chunk: int = CHUNK) -> DataFrame:
    """1.0 where the state differs from the sample before, else 0.0; the first sample has 0.0."""
    beside = neighbours(labels, keys, [state], order=order, chunk=chunk)
    return beside.select(*(c for c in labels.columns if c != name), F.coalesce((F.col(state) != F.col(f"{state}__before")).cast("double"), F.lit(0.0)).alias(name))


def dense_states(labels: DataFrame, keys: list[str], states: list[int], **options) -> DataFrame:
    """``state_profile`` with a row for every listed state; dwell is null where the state is absent."""
    state = options.get("state", "microstate")
    grid = labels.select(*keys).distinct().withColumn(state, F.explode(F.array(*map(F.lit, states))))
    profile = state_profile(labels, keys, **options)
    found = grid.join(profile, [*keys, state], "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return found.select(*keys, state, zero("occupancy", "double"), "mean_dwell_sec", zero("n_samples", "long"), zero("n_runs", "long"))


def _windows(table: DataFrame, keys: list[str], width: float, step: float | None, order: str, time: str) -> DataFrame:
    """Each sample with the windows that hold it: window (number), window_start_sec, window_end_sec, period.

    Window i starts at min + i * step and must end by max + period; starts are inclusive, ends exclusive. Only the
    windows that can hold a sample are made for it, so nothing is joined.
    """
    step = step or width
    bounds = table.groupBy(*keys).agg(F.min(time).alias("__min"), F.max(time).alias("__max")).join(sample_period(table, keys, order=order, time=time), keys)
    last = F.floor((F.col("__max") + F.col("sample_period_sec") - F.lit(width) - F.col("__min")) / F.lit(step) + F.lit(1e-9))
    at = F.col(time) - F.col("__min")
    lo = F.greatest(F.floor((at - F.lit(width)) / F.lit(step)), F.lit(0))
    hi = F.least(F.floor(at / F.lit(step)) + 1, last)
    start = F.col("__min") + F.col("window") * F.lit(step)
    return (
        table.join(bounds, keys)
        .withColumn("window", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        .withColumns({"window_start_sec": start, "window_end_sec": start + F.lit(width)})
        .where((F.col(time) >= F.col("window_start_sec")) & (F.col(time) < F.col("window_end_sec")))
    )


def windowed_states(labels: DataFrame, keys: list[str], *, width: float, step: float | None = None, state: str = "microstate", order: str = "sample", time: str = "time_sec") -> DataFrame:
    """Occupancy and dwell of every state of a key in every window that has samples."""
    held = _windows(labels, keys, width, step, order, time)
    found = runs(held, [*keys, "window"], state=state, order=order, time=time).groupBy(*keys, "window", state).agg(F.sum("n_samples").alias("__n"), F.count("*").alias("__runs"))
    sizes = held.groupBy(*keys, "window").agg(F.count("*").alias("n_samples"), F.first("window_start_sec").alias("window_start_sec"), F.first("window_end_sec").alias("window_end_sec"), F.first("sample_period_sec").alias("__period"))
    grid = sizes.join(labels.select(*keys, state).distinct(), keys)
    dwell = F.coalesce(F.col("__n") / F.col("__runs") * F.col("__period"), F.lit(0.0))
    return grid.join(found, [*keys, "window", state], "left").select(
        *keys, "window", "window_start_sec", "window_end_sec", state, (F.coalesce("__n", F.lit(0)) / F.col("n_samples")).alias("occupancy"), dwell.alias("mean_dwell_sec"), "n_samples"
    )


def windowed_values(signals: DataFrame, keys: list[str], *, width: float, step: float | None = None, series: str = "region", order: str = "sample", time: str = "time_sec") -> DataFrame:
    """Mean and population deviation of each series in every window."""
    held = _windows(signals, [*keys, series], width, step, order, time)
    return held.groupBy(*keys, series, "window").agg(
        F.first("window_start_sec").alias("window_start_sec"), F.first("window_end_sec").alias("window_end_sec"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"), F.count("value").alias("n_samples")
    )


def circular_shift(labels: DataFrame, keys: list[str], shifts: DataFrame, *, state: str, order: str = "sample", name: str = "shifted") -> DataFrame:
    """Each row with the state ``shift`` samples before it, around the end, for every row of ``shifts`` (keys or none, shift).

    The result has a row for each sample and shift; ``shifts`` must be small.
    """
    sized = labels.join(labels.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    on = [c for c in keys if c in shifts.columns]
    spread = sized.join(F.broadcast(shifts), on) if on else sized.crossJoin(F.broadcast(shifts))
    asked = spread.withColumn("__from", F.pmod(F.col(order) - F.col("shift"), F.col("__n")))
    given = labels.select(*keys, F.col(order).alias("__from"), F.col(state).alias(name))
    return asked.join(given, [*keys, "__from"]).drop("__n", "__from")


def lag_pairs(left: DataFrame, right: DataFrame, keys: list[str], lags: list[int], *, order: str = "sample") -> DataFrame:
    """Left samples with the right ones ``lag`` samples later, for each lag; what has no partner drops out."""
    spread = left.withColumn("lag_samples", F.explode(F.array(*map(F.lit, sorted(set(lags)))))).withColumn("__to", F.col(order) + F.col("lag_samples"))
    given = right.withColumnRenamed(order, "__to")
    return spread.join(given, [*keys, "__to"]).drop("__to")


def local_maxima(trace: DataFrame, keys: list[str], *, value: str, order: str = "sample", chunk: int = CHUNK) -> DataFrame:
    """Samples above both neighbours."""
    beside = neighbours(trace, keys, [value], order=order, chunk=chunk)
    return beside.where((F.col(value) > F.col(f"{value}__before")) & (F.col(value) > F.col(f"{value}__after"))).select(*trace.columns)


def around_events(events: DataFrame, samples: DataFrame, keys: list[str], *, before: int, after: int, order: str = "sample") -> DataFrame:
    """Samples from ``before`` before each event's sample to ``after`` after it, with their offset; clipped at the ends."""
    spread = events.withColumn("offset_samples", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("__to", F.col(order) + F.col("offset_samples")).drop(order)
    return spread.join(samples.withColumnRenamed(order, "__to"), [*keys, "__to"]).withColumnRenamed("__to", order)


def seconds(column: str) -> Column:
    """Seconds since the epoch of a timestamp, as a double."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)
