"""Sequence tables made from the driver's tables, in Spark and as DuckDB views for the SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types in the order of their state numbers.
STATES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str, patient: Column | None = None) -> DataFrame:
    events = read(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type")) - 1
    return events.select(
        (F.concat(F.lit("p"), F.col("user_id") % 10) if patient is None else patient).alias("patient_id"),
        "event_id",
        ((micros - F.lit(1704067200000000)) / F.lit(1e6)).alias("time_sec"),
        state.cast("long").alias("microstate"),
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
    )


def _numbered(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("patient_id").orderBy("time_sec", "event_id")
    return df.withColumn("sample", (F.row_number().over(order) - 1).cast("long"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, sample, time_sec, microstate, corr: all events."""
    return _labels(_base(spark, sf_dir))


def numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as labels of the five patients of ``vectors``."""
    return _labels(_base(spark, sf_dir, F.col("user_id") % 5))


def paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of events with even ids only, for queries that also read ``field``: its rows are the others."""
    return _labels(_base(spark, sf_dir).where("event_id % 2 = 0"))


def _labels(base: DataFrame) -> DataFrame:
    return _numbered(base).select("patient_id", "sample", "time_sec", "microstate", F.col("value").alias("corr"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, sample, time_sec, field_state, gfp: events with odd ids."""
    return _numbered(_base(spark, sf_dir).where("event_id % 2 = 1")).select("patient_id", "sample", "time_sec", (F.col("k") % 4).alias("field_state"), F.col("value").alias("gfp"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sequences by sample number: patient_id, sample, time_sec, microstate, corr, field_state, gfp."""
    return paired_labels(spark, sf_dir).join(field(spark, sf_dir).drop("time_sec"), ["patient_id", "sample"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, sample, channel, value: all dimensions of the embeddings."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("patient_id"), F.floor(F.col("vec_id") / 5).alias("sample"), F.posexplode("embedding").alias("channel", "value"))
    return rows.select("patient_id", "sample", F.col("channel").cast("long").alias("channel"), F.col("value").cast("double").alias("value"))


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, subject, microstate, value: mean value by user and event type."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), F.col("user_id").alias("subject"), (F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type")) - 1).cast("long").alias("microstate"), "value")
    return rows.groupBy("grp", "subject", "microstate").agg(F.avg("value").alias("value"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATES)) + " END::bigint"

_SQL = f"""
WITH base AS (SELECT 'p' || (user_id % 10) AS patient_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6::double AS time_sec, {_CASE} AS microstate, value, regexp_extract(props, '(\\d+)', 1)::bigint AS k FROM events),
lab AS (SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY time_sec, event_id) - 1 AS sample, time_sec, microstate, value AS corr FROM base [even]),
fld AS (SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY time_sec, event_id) - 1 AS sample, time_sec, k % 4 AS field_state, value AS gfp FROM base WHERE event_id % 2 = 1),
two AS (SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY time_sec, event_id) - 1 AS sample, time_sec, microstate, value AS corr FROM base WHERE event_id % 2 = 0),
ali AS (SELECT two.*, field_state, gfp FROM two JOIN fld USING (patient_id, sample)),
vec AS (SELECT vec_id % 5 AS patient_id, vec_id // 5 AS sample, i - 1 AS channel, embedding[i]::double AS value FROM embeddings, range(1, 65) r(i)),
eff AS (SELECT user_id % 3 AS grp, user_id AS subject, {_CASE} AS microstate, avg(value) AS value FROM events GROUP BY ALL),
step AS (SELECT patient_id, coalesce(median(d), 0) AS period FROM (SELECT patient_id, time_sec - lag(time_sec) OVER (PARTITION BY patient_id ORDER BY sample) AS d FROM lab) GROUP BY 1),
isl AS (SELECT *, sample - row_number() OVER (PARTITION BY patient_id, microstate ORDER BY sample) AS g FROM lab),
run AS (SELECT patient_id, microstate, min(sample) AS start_sample, count(*) AS n_samples, min(time_sec) AS start_sec, max(time_sec) AS end_sec,
  row_number() OVER (PARTITION BY patient_id ORDER BY min(sample)) - 1 AS run_id FROM isl GROUP BY patient_id, microstate, g),
tra AS (SELECT patient_id, run_id - 1 AS transition_id, start_sec AS event_sec, lag(microstate) OVER w AS from_state, microstate AS to_state, lag(start_sec) OVER w AS from_start_sec,
  lag(end_sec) OVER w AS from_end_sec, start_sec AS to_start_sec, end_sec AS to_end_sec FROM run WINDOW w AS (PARTITION BY patient_id ORDER BY run_id) QUALIFY run_id > 0)
"""

#: Common table expressions with the same tables, to put before a query; in the second ``lab`` and what follows from it
#: are the paired labels.
SQL = _SQL.replace("[even]", "")
PAIRED = _SQL.replace("[even]", "WHERE event_id % 2 = 0")
