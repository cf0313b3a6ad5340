"""Sources: recording catalogs, annotation and atlas tables, long signals; sinks for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Long signals: one row for each sample and channel. The boundary to formats that need other libraries.
SIGNALS = "patient_id string, recording_state string, modality string, sample long, time_sec double, channel string, value double"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(patient_id, folder, name, path) of the files under ``root/<patient>/``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    tail = F.regexp_extract("path", r".*?" + root.rstrip("/").rsplit("/", 1)[-1] + r"/(.*)$", 1)
    return found.select(F.split_part(tail, F.lit("/"), F.lit(1)).alias("patient_id"), F.regexp_extract(tail, r"^[^/]+/(?:(.*)/)?[^/]+$", 1).alias("folder"), F.element_at(F.split(tail, "/"), -1).alias("name"), "path")


def preferred(files: DataFrame, keys: list[str], exact: str) -> DataFrame:
    """One path for each key: the file with the exact name, else the first by path."""
    order = Window.partitionBy(*keys).orderBy((F.col("name") != exact).cast("int"), "path")
    return files.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def recording_index(spark: SparkSession, root: str, state: str, suffix: str = "fif") -> DataFrame:
    """Assets of each patient for one state, with a flag for each: scalp, reference and bipolar signals, atlas."""
    files = list_files(spark, root).where(~F.col("name").startswith("."))
    eeg, seeg = f"{state}_eeg.{suffix}", f"{state}_seeg.{suffix}"
    like = (F.col("name").startswith(f"{state}_seeg")) & F.col("name").endswith(f".{suffix}")
    parts = {
        "eeg_ref_path": files.where((F.col("folder") == "ref") & (F.col("name") == eeg)),
        "seeg_ref_path": preferred(files.where((F.col("folder") == "ref") & like), ["patient_id"], seeg),
        "seeg_bipolar_path": preferred(files.where((F.col("folder") == "bipolar") & like), ["patient_id"], seeg),
        "atlas_path": files.where((F.col("folder") == "MNI") & (F.col("name") == "Atlas.tsv")),
    }
    out = files.select("patient_id").distinct().withColumn("state", F.lit(state))
    for name, part in parts.items():
        out = out.join(part.select("patient_id", F.col("path").alias(name)), "patient_id", "left")
    flags = {"has_eeg": "eeg_ref_path", "has_ref_seeg": "seeg_ref_path", "has_bipolar": "seeg_bipolar_path", "has_atlas": "atlas_path"}
    return out.withColumns({flag: F.col(path).isNotNull() for flag, path in flags.items()})


def eligibility(index: DataFrame) -> DataFrame:
    """What a recording can be used for, and the assets it lacks."""
    names = {"has_eeg": "eeg", "has_ref_seeg": "ref_seeg", "has_bipolar": "bipolar_seeg", "has_atlas": "atlas"}
    seeg = F.col("has_ref_seeg") & F.col("has_bipolar") & F.col("has_atlas")
    lacking = F.filter(F.array(*(F.when(~F.col(flag), F.lit(name)) for flag, name in names.items())), lambda x: x.isNotNull())
    return index.withColumns(
        {"eligible_seeg_stage": seeg, "eligible_paired_eeg_seeg": seeg & F.col("has_eeg"), "missing_assets": F.when(F.size(lacking) == 0, "none").otherwise(F.array_join(lacking, ";"))}
    )


def read_atlas(spark: SparkSession, paths: str | list[str], label: str = "AAL3") -> DataFrame:
    """(patient_id, contact, label, position) of atlas tables; the patient is the folder two levels up."""
    raw = spark.read.csv(paths, sep="\t", header=True)
    row = F.monotonically_increasing_id()
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1).alias("patient_id"), F.col("Channel").alias("contact"), F.col(label).alias("label"), row.alias("position"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation sheets, as CSV or Parquet twins of a workbook's sheets."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Long signals; filters and columns reach the files."""
    return spark.read.schema(SIGNALS).parquet(path)


def crop(signals: DataFrame, start_sec: float, end_sec: float) -> DataFrame:
    """Samples in [start, end), with time and sample counted from the start of what is left."""
    kept = signals.where((F.col("time_sec") >= max(0.0, start_sec)) & (F.col("time_sec") < end_sec))
    keys = [c for c in ("patient_id", "recording_state", "modality") if c in signals.columns]
    first = kept.groupBy(*keys).agg(F.min("sample").alias("__s"), F.min("time_sec").alias("__t"))
    return kept.join(first, keys).withColumns({"sample": F.col("sample") - F.col("__s"), "time_sec": F.col("time_sec") - F.col("__t")}).drop("__s", "__t")


def write_signals(signals: DataFrame, path: str) -> None:
    """Signals by patient and state, so that both prune reads."""
    signals.repartition("patient_id", "recording_state").sortWithinPartitions("channel", "sample").write.mode("overwrite").partitionBy("patient_id", "recording_state").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
